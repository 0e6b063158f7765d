"""Context assembly: hits become documents in reading order, without copies, with coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import row_signature, xml_attribute, xml_text
from quern.profile import MACEDONIAN, Profile

RESERVE = 3


def with_rows(hits: DataFrame, rows: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Hits with their rows; unknown ids are dropped."""
    return hits.join(rows, hits["id"] == rows[id_col]).drop(id_col)


def unknown_hits(hits: DataFrame, rows: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Hits whose id is no row's: an evaluation refuses to run while there are any."""
    return hits.join(rows.select(F.col(id_col).alias("id")), "id", "left_anti")


def without_copies(docs: DataFrame, content: str = "content", owner: str = "id_service", by: str = "query_id") -> DataFrame:
    """Of equal contents the best rank; also_in lists the other owners in order of appearance.

    injected stays true only if all copies were injected.  Contents are told apart
    by SHA-256 and counted by owner, so no copies are gathered and texts don't move
    but for the join with the one row that stays.
    """
    told = docs.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))
    owned = told.groupBy(by, "digest", F.col(owner).alias("o")).agg(F.min(F.struct("rank", "id")).alias("at"), *([F.bool_and("injected").alias("injected")] if "injected" in docs.columns else []))
    owners = F.transform(F.array_sort(F.collect_list(F.struct(F.col("at.rank").alias("rank"), F.col("o")))), lambda x: x["o"])
    one = owned.groupBy(by, "digest").agg(F.min("at").alias("at"), owners.alias("owners"), *([F.bool_and("injected").alias("all_injected")] if "injected" in docs.columns else []))
    one = one.select(F.col(by).alias("one_by"), F.col("at.rank").alias("one_rank"), F.col("at.id").alias("one_id"), "owners", *(["all_injected"] if "injected" in docs.columns else []))
    kept = docs.join(one, (F.col(by) == F.col("one_by")) & (F.col("rank") == F.col("one_rank")) & (F.col("id") == F.col("one_id"))).withColumn("also_in", F.array_except("owners", F.array(owner)))
    if "injected" in docs.columns:
        kept = kept.withColumn("injected", F.col("all_injected")).drop("all_injected")
    return kept.drop("one_by", "one_rank", "one_id", "owners")


def trimmed(docs: DataFrame, k: int, pinned: str = "pinned", by: str = "query_id") -> DataFrame:
    """Cut to k: at most max(1, k - 3) pinned rows first, the rest by rank.  Fewer than k rows all stay."""
    quota = max(1, k - RESERVE)
    own = Window.partitionBy(by, pinned).orderBy("rank", "id")
    first = docs.withColumn("p", F.when(F.col(pinned) & (F.row_number().over(own) <= quota), 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy(by).orderBy("p", "rank", "id"))
    return first.withColumn("place", place).where(F.col("place") <= k).drop("p", "place")


def reading_order(docs: DataFrame, section: list[str], row: str = "row", by: str = "query_id") -> DataFrame:
    """position: sections by their best rank, rows within a section by number, then rank."""
    best = F.min("rank").over(Window.partitionBy(by, *section))
    order = Window.partitionBy(by).orderBy("section_rank", *section, F.coalesce(F.col(row), F.lit(0)), "rank", "id")
    return docs.withColumn("section_rank", best).withColumn("position", F.row_number().over(order)).drop("section_rank")


def section_coverage(docs: DataFrame, rows: DataFrame, key: list[str], by: str = "query_id", kind: str = "type", profile: Profile | None = MACEDONIAN) -> DataFrame:
    """(query, key, present, total) of list-shaped sections with more than one row in all."""
    listed = (lambda df: df.where(F.col(kind).isin(list(profile.list_sections)))) if profile else (lambda df: df)
    present = listed(docs).groupBy(by, *key).agg(F.count("*").alias("present"))
    total = listed(rows).groupBy(*key).agg(F.count("*").alias("total")).where("total > 1")
    return present.join(total, key)


def answer_coverage(docs: DataFrame, blocks: DataFrame, by: str = "query_id", profile: Profile = MACEDONIAN) -> DataFrame:
    """(query, type, variant, present, total) of the list-shaped sections in a context.

    Both tables have (id_service, id_variation, type, variation_short_name).  The
    shared rows of a service, those without a variation, are a section of their own.
    """
    key = ["id_service", "id_variation", "type"]
    listed = F.col("type").isin(list(profile.list_sections))
    present = docs.where(listed).groupBy(by, *key).agg(F.max("variation_short_name").alias("variant"), F.count("*").alias("present"))
    total = blocks.where(listed).groupBy(*key).agg(F.count("*").alias("total")).where("total > 1").select(*[F.col(c).alias(f"{c}_") for c in key], "total")
    same = (F.col("id_service") == F.col("id_service_")) & (F.col("type") == F.col("type_")) & F.col("id_variation").eqNullSafe(F.col("id_variation_"))
    return present.join(total, same).select(by, "type", "variant", "present", "total")


COMPLETE_NOTE = "COMPLETE: all rows of the section are here; give them as the full list."
PARTIAL_NOTE = "PARTIAL: rows are missing; never give these as the full list."
COUNTS_NOTE = "The counts are for you alone; don't repeat them to the user."


def rendered_coverage(covered: DataFrame, asked: DataFrame, by: str = "query_id", notes: tuple[str, str, str] = (COMPLETE_NOTE, PARTIAL_NOTE, COUNTS_NOTE)) -> DataFrame:
    """(query, coverage): a line for each section asked about, (query, intents); for all where no intent is known."""
    met = covered.join(asked.select(by, "intents"), by, "left").where("intents IS NULL OR size(intents) = 0 OR array_contains(intents, type)")
    full = F.col("present") >= F.col("total")
    where = F.when(F.coalesce(F.col("variant"), F.lit("")) != "", F.concat(F.lit(" ("), xml_text("variant"), F.lit(")"))).otherwise("")
    state = F.when(full, F.lit("COMPLETE")).otherwise(F.format_string("PARTIAL -- %d row(s) of this section are not here", F.col("total") - F.col("present")))
    line = F.concat(F.lit("  "), "type", where, F.format_string(": %d of %d rows -- ", "present", "total"), state)
    every = met.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("type", "variant", "present", "total", line.alias("line")))).alias("ls"), F.bool_or(full).alias("some"), F.bool_or(~full).alias("part"))
    said = F.concat(F.transform("ls", lambda x: x["line"]), F.filter(F.array(F.when(F.col("some"), F.lit(notes[0])), F.when(F.col("part"), F.lit(notes[1])), F.lit(notes[2])), lambda n: n.isNotNull()))
    return every.select(by, F.concat(F.lit("<coverage>\n"), F.array_join(said, "\n"), F.lit("\n</coverage>")).alias("coverage"))


OPEN_NOTE = "The question leaves the variant open: ask which one is meant, and answer for none of them."


def rendered_ambiguity(found: DataFrame, by: str = "query_id", note: str = OPEN_NOTE) -> DataFrame:
    """(query, ambiguity): the variants (label, id_variation) of (service_name, section_types, variations, source) to choose from.

    Found by structure alone, their rows may be missing from the documents, which the block says.
    """
    options = F.array_join(F.transform("variations", lambda v: F.format_string("  - %s (id_variation=%s)", xml_text(v["label"]), v["id_variation"].cast("string"))), "\n")
    seen = F.when(F.col("source") == "structure", F.lit("The documents may hold none or only one of them.\n")).otherwise("")
    lead = F.format_string('"%s" has %d variants with different %s:', xml_text("service_name"), F.size("variations"), F.array_join("section_types", ", "))
    return found.select(by, F.concat(F.lit("<ambiguity>\n"), lead, F.lit("\n"), options, F.lit("\n"), seen, F.lit(note), F.lit("\n</ambiguity>")).alias("ambiguity"))


def full_context(documents: DataFrame, coverage: DataFrame, ambiguity: DataFrame, by: str = "query_id") -> DataFrame:
    """(query, context): the documents, then what is known of their coverage and of open choices."""
    both = documents.join(coverage, by, "left").join(ambiguity, by, "left")
    return both.select(by, F.concat_ws("\n", "context", "coverage", "ambiguity").alias("context"))


def differing_sections(rows: DataFrame, service: str, variation: str, kind: str, content: str) -> DataFrame:
    """(service, type) whose variations hold different multisets of row signatures."""
    signed = rows.where(F.col(variation).isNotNull()).withColumn("signature", row_signature(kind, content))
    sets = signed.groupBy(service, kind, variation).agg(F.array_sort(F.collect_list("signature")).alias("rows"))
    return sets.groupBy(service, kind).agg(F.count_distinct("rows").alias("n_kinds"), F.count("*").alias("n_variations")).where("n_kinds >= 2")


def universal_rows(rows: DataFrame, service: str, variation: str, kind: str, content: str) -> DataFrame:
    """(service, type, content) that every variation with the type holds, where there are at least two."""
    own = rows.where(F.col(variation).isNotNull())
    having = own.groupBy(service, kind).agg(F.count_distinct(variation).alias("n_all")).where("n_all >= 2")
    held = own.groupBy(service, kind, content).agg(F.count_distinct(variation).alias("n_held"))
    return held.join(having, [service, kind]).where("n_held = n_all")


def identical(rows: DataFrame, id_col: str, content: str) -> DataFrame:
    """(id, copies): how many rows have the same content; the ids by a join on the digest."""
    digest = rows.select(F.col(id_col).alias("id"), F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    groups = digest.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
    return digest.join(groups, "digest").select("id", "digest", "copies", "first_id")


def rendered(docs: DataFrame, by: str = "query_id", id_col: str = "id", content: str = "content", attributes: tuple[str, ...] = ()) -> DataFrame:
    """(query, context): one XML element a document, in reading order; every value is escaped."""

    def attribute(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.concat(F.lit(f' {name}="'), xml_attribute(F.col(name).cast("string")), F.lit('"'))).otherwise("")

    head = F.concat(F.lit('<document id="'), xml_attribute(F.col(id_col).cast("string")), F.lit('"'), *map(attribute, attributes), F.lit(">\n"))
    element = F.concat(head, xml_text(content), F.lit("\n</document>"))
    listed = docs.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("position", element.alias("e")))).alias("es"))
    return listed.select(by, F.concat(F.lit("<documents>\n"), F.array_join(F.transform("es", lambda x: x["e"]), "\n"), F.lit("\n</documents>")).alias("context"))
