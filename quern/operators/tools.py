"""Lookup of entities and announcements; identifiers compare without zero padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.dates import date_ticks, printed_date
from quern.functions.html import infobox_value
from quern.functions.text import col, digits, norm_text, same_number
from quern.operators import phrases
from quern.tables import stored


def entity_index(profiles: DataFrame, decisions: DataFrame) -> DataFrame:
    """(number, id, name, has_profile, n_decisions): one row an entity; the profile's name wins."""
    p = profiles.select(same_number("id").alias("number"), "id", "name", F.lit(1).alias("p"), F.lit(0).alias("d"))
    d = decisions.select(same_number("id").alias("number"), "id", "name", F.lit(0).alias("p"), F.lit(1).alias("d"))
    both = p.unionByName(d).where("number <> ''")
    return both.groupBy("number").agg(F.max_by("id", F.struct("p", "id")).alias("id"), F.max_by("name", F.struct("p", "name")).alias("name"), (F.max("p") == 1).alias("has_profile"), F.sum("d").alias("n_decisions"))


def _told(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def _named(rows: DataFrame, name_col: str, id_col: str) -> DataFrame:
    return rows.withColumns({"_low": norm_text(name_col), "_number": same_number(id_col)})


def _met(named: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows with _low and _number, joined with the criteria (by_id, by_name) they fit; each query is met by its identifier, else by its name.

    Equal names are searched once.
    """
    by_number = named.join(asked.where(_told("by_id")).withColumn("_number", same_number("by_id")), "_number").where(~_told("by_name") | F.contains("_low", F.col("by_name")))
    rest = asked.where(~_told("by_id") & _told("by_name"))
    names = named.select("_low").repartition(2 * named.sparkSession.sparkContext.defaultParallelism, "_low").distinct()
    hits = phrases.find(names, rest, "_low", "by_name", ("_low",), "anywhere").select("_low", F.col("name").alias("by_name")).distinct()
    by_name = named.join(hits.join(rest, "by_name"), "_low")
    return by_number.unionByName(by_name.select(by_number.columns))


def entity_search(entities: DataFrame, queries: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """(query_id, entity's columns): criteria (by_id, by_name) are joined by and; empty ones don't count.

    At least one must be given.
    """
    asked = stored(queries.select("query_id", F.col("by_id"), norm_text("by_name").alias("by_name")), "asked")
    return _met(stored(_named(entities, name_col, id_col), "rows"), asked).select(*entities.columns, "query_id")


def announcement_search(decisions: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, decision's columns): by id, name, type and one of the printed dates, joined by and.

    At least one must be given.  The first of identifier, name, date and type that a
    query has is what it is looked up by, date and type together if it has both.
    Dates and types are read once a decision, not once a pair.
    """
    asked = stored(queries.select("query_id", "by_id", norm_text("by_name").alias("by_name"), norm_text("by_type").alias("by_type"), printed_date("by_date").alias("by_date"), _told("by_date").alias("dated")), "asked")
    read = {"_type": norm_text("doc_type"), "_days": F.array_distinct(F.transform("dates", lambda d: printed_date(d)))}
    rows = stored(_named(decisions, "name", "id").withColumns(read), "rows")
    out = [*decisions.columns, "query_id"]
    fits = (~F.col("dated") | F.array_contains("_days", F.col("by_date"))) & (~_told("by_type") | (F.col("_type") == F.col("by_type")))
    met = _met(rows, asked).where(fits).select(out)
    rest = asked.where(~_told("by_id") & ~_told("by_name"))
    days = rows.withColumn("by_date", F.explode("_days")).withColumnRenamed("_type", "by_type")
    dated = days.drop("by_type").join(rest.where(F.col("dated") & ~_told("by_type")), "by_date").select(out)
    both = days.join(rest.where(F.col("dated") & _told("by_type")), ["by_date", "by_type"]).select(out)
    typed = rows.withColumnRenamed("_type", "by_type").join(rest.where(~F.col("dated") & _told("by_type")), "by_type").select(out)
    return met.unionByName(dated).unionByName(both).unionByName(typed)


def argument_problems(number: Column | str | None = None, case_number: Column | str | None = None, day: Column | str | None = None) -> Column:
    """What is wrong with a call's arguments: 7 or 8 digits, 14 digits, dd.mm.yyyy."""
    rules = [(number, r"^\p{Nd}{7,8}$", "identifier"), (case_number, r"^\p{Nd}{14}$", "case number"), (day, r"^\d{2}\.\d{2}\.\d{4}$", "date")]
    told = [F.when(~F.coalesce(col(c).rlike(p), F.lit(False)), F.lit(what)) for c, p, what in rules if c is not None]
    return F.filter(F.array(*told), lambda x: x.isNotNull())


def profile_problems(profile: DataFrame, asked: str) -> Column:
    """Whether a read profile is the one asked for and has the right shapes."""
    return F.filter(
        F.array(
            F.when(same_number("id") != same_number(asked), F.lit("another entity")),
            F.when(~F.coalesce(F.col("tax_id").rlike(r"^\d{13}$"), F.lit(False)), F.lit("tax id")),
            F.when(printed_date("founded").isNull(), F.lit("date")),
        ),
        lambda x: x.isNotNull(),
    )


def citable(columns: dict[str, Column | str], key: Column) -> Column:
    """A tool's result as a document: id under tool:, labelled lines; empty values are left out."""
    lines = [F.when(F.coalesce(col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), col(c).cast("string"))) for label, c in columns.items()]
    return F.struct(F.concat(F.lit("tool:"), key).alias("chunk_id"), F.concat_ws("\n", *lines).alias("content"))


def decision_index(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions that open by their own number and pass the checks, the others with why).

    decisions are (number, printed, id, date): the number they are filed under, and
    what was read from them.
    """
    told = [
        F.when(digits("printed") != F.col("number"), F.lit("another number")),
        F.when(~F.coalesce(F.col("id").rlike(r"^\p{Nd}{7,8}$"), F.lit(False)), F.lit("identifier")),
        F.when(~F.coalesce(F.col("date").rlike(r"^\d{2}\.\d{2}\.\d{4}$") & F.to_date(F.try_to_timestamp("date", F.lit("dd.MM.yyyy"))).isNotNull(), F.lit(False)), F.lit("date")),
    ]
    first = F.when(told[0].isNotNull(), told[0]).otherwise(F.concat_ws("; ", *told[1:]))
    marked = decisions.withColumn("why", F.nullif(first, F.lit("")))
    return marked.where("why IS NULL").drop("why"), marked.where("why IS NOT NULL")


def looked_up(asked: DataFrame, rows: DataFrame, key: str, id_col: str, labels: dict[str, str]) -> DataFrame:
    """asked with available and doc, a citable document: what is not there is a row too, and says so."""
    own = rows.select(F.col(id_col).alias("quern_key"), F.struct(*[F.col(c) for c in labels.values()]).alias("quern_row"))
    met = asked.join(own, F.col(key) == F.col("quern_key"), "left")
    found = F.col("quern_key").isNotNull()
    there = citable({label: F.col("quern_row")[c] for label, c in labels.items()}, F.col(key))
    missing = F.struct(F.concat(F.lit("tool:"), F.col(key)).alias("chunk_id"), F.lit("unavailable").alias("content"))
    return met.withColumn("available", found).withColumn("doc", F.when(found, there).otherwise(missing)).drop("quern_key", "quern_row")


# Codes of the registry's search form, and the size classes it prints.
DOC_TYPE_CODES = {100: "основање", 130: "промена", 160: "бришење", 200: "стечај", 201: "ликвидација"}
KNOWN_SIZES = ("среден", "микро", "голем", "мал")


def search_payload(number: str, name: str, doc_type: str, day: str) -> Column:
    """The body of a registry search: empty criteria are null, and so is the code of an unknown type."""
    told = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    code = F.lit(None).cast("int")
    for n, label in DOC_TYPE_CODES.items():
        code = F.when(norm_text(doc_type) == label, n).otherwise(code)
    ticks = F.when(told(day).isNotNull(), date_ticks(printed_date(day)))
    return F.struct(told(number).cast("long").alias("LEID"), told(name).alias("partOfName"), code.alias("docTypeID"), ticks.alias("announcementDateTicks"), F.lit(False).alias("ut"))


#: Other spellings of the fields of a saved status.
SPELLINGS = {"entity_title": "title", "publication_date": "publishDate", "document_description": "documentDescription"}


def saved_status(saved: Column, labels: dict[str, str]) -> Column:
    """Fields of a saved status: JSON with either spelling, else a page whose infobox has the labels."""
    t = F.trim(F.regexp_replace(saved, r"^\s+|\s+$", ""))
    names = [*labels, *SPELLINGS.values()]
    data = F.from_json(F.when(t.startswith("{"), t), ", ".join(f"{n} string" for n in names))
    told = lambda n: F.nullif(data[n], F.lit("")) if n else F.lit(None).cast("string")
    return F.struct(*[F.when(t.startswith("{"), F.coalesce(told(n), told(SPELLINGS.get(n)), F.lit(""))).otherwise(infobox_value(t, label)).alias(n) for n, label in labels.items()])


def entity_size(page: Column, span_id: str) -> Column:
    """(read, size, message) of a result page: the class is one that the message states as a word, else null, never guessed.

    A page without the result's span was not read, which is not the same as not found.
    """
    pattern = rf'(?is)<span[^>]*\bid="{span_id}"[^>]*>(.*?)</span>'
    message = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(page, pattern, 1), r"<[^>]*>", " "), r"(?U)\s+", " "))
    size = F.lit(None).cast("string")
    for name in reversed(KNOWN_SIZES):
        size = F.when(F.lower(message).rlike(rf"(?U)(?<!\w){name}(?!\w)"), name).otherwise(size)
    read = page.rlike(pattern)
    return F.struct(read.alias("read"), F.when(read, size).alias("size"), F.when(read, message).alias("message"))
