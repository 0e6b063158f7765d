"""From raw service payloads to checked blocks: the files are grouped by service, shared parts are told once.

files are (path, text).  A payload without a variation is its service's base; a
service with variations gives shared blocks, from its base or else its first
variation, and blocks of each variation; a service without gives all under v0.
Of several files for a variation the first by path counts, of several bases the last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.html import fix_links, html_to_text
from quern.functions.text import once
from quern.profile import MACEDONIAN, Profile
from quern.sources.payloads import SHARED_SECTIONS, VARIATION_SECTIONS, classified, cleaned, decoded, row_text
from quern.tables import stored

NAMED = "array<struct<name:string,shortName:string,selected:boolean>>"
#: Sections are read as text: a table may come as JSON or as a string that holds JSON.
PAYLOAD = ", ".join([
    "idService long, idServiceVariation long, serviceName string, serviceShortName string, variationName string, variationShortName string, url string, urlPrefix string, keywords string, serviceDescription string, isOnline boolean, onlineURL string",
    *(f"{c} {NAMED}" for c in ("tags", "paymentMethods", "otherOffices", "connected", "registries", "institutions")),
    *(f"{c} string" for c in (*SHARED_SECTIONS, *VARIATION_SECTIONS)),
    "faQs array<struct<question:string,answer:string,orderQ:double>>, variations array<struct<idServiceVariation:long,shortName:string>>",
])
TEXT_SECTION = "legalBasis"
BLOCK_COLUMNS = ("chunk_id", "scope", "type", "row", "id_service", "id_variation", "applies_to_variations", "service_name", "variation_short_name", "is_online", "online_url", "context", "content", "embedding_text")


def keywords(value: Column) -> Column:
    """Words between white space, commas and semicolons."""
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"(?U)[\s,;]+"), lambda w: w != "")


def _told(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def _names(list_: Column) -> Column:
    return F.transform(F.coalesce(list_, F.array().cast(NAMED)), lambda x: _told(x["name"]))


def accepted(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of service payloads, the skip report: path and why) of rows with their file's kind."""
    return kinds.where("kind = 'ok'").drop("kind"), kinds.where("kind <> 'ok'").select("path", "kind")


def parse_service(files: DataFrame) -> DataFrame:
    """One record a file, with its kind if files have one; tables stay JSON.

    Names come from the service's and variation's own fields, never from a field called name.
    """
    begun = once(cleaned("text"), lambda t: F.when(F.substring(t, 1, 1) == "{", t).otherwise(F.concat(F.lit("{"), t)))
    own = ["path", *(["kind"] if "kind" in files.columns else [])]
    d = files.select(*own, F.from_json(begun, PAYLOAD).alias("d")).select(*own, "d.*")
    text = lambda c: fix_links(html_to_text(F.col(c)))
    asked = F.filter(F.coalesce("faQs", F.array().cast("array<struct<question:string,answer:string,orderQ:double>>")), lambda f: (_told(f["question"]) != "") | (_told(f["answer"]) != ""))
    placed = F.transform(asked, lambda f, i: F.struct(F.coalesce(f["orderQ"], F.lit(0.0)).alias("order"), i.alias("i"), f["question"].alias("question"), f["answer"].alias("answer")))
    return d.select(
        *own, F.col("idService").alias("id_service"), F.coalesce("idServiceVariation", F.lit(0)).alias("id_variation"),
        _told(F.col("serviceName")).alias("service_name"), _told(F.col("serviceShortName")).alias("service_short_name"), _told(F.col("variationName")).alias("variation_name"), _told(F.col("variationShortName")).alias("variation_short_name"),
        (F.coalesce("idServiceVariation", F.lit(0)) != 0).alias("is_variation"), "url", F.col("urlPrefix").alias("url_prefix"), keywords(F.col("keywords")).alias("keywords"), _names(F.col("tags")).alias("tags"),
        text("serviceDescription").alias("service_description"), F.coalesce("isOnline", F.lit(False)).alias("is_online"), F.nullif(_told(F.col("onlineURL")), F.lit("")).alias("online_url"),
        _names(F.col("paymentMethods")).alias("payment_methods"), _names(F.col("otherOffices")).alias("other_offices"),
        F.transform(F.coalesce("connected", F.array().cast(NAMED)), lambda c: F.coalesce(F.nullif(c["shortName"], F.lit("")), c["name"])).alias("connected_services"), _names(F.col("registries")).alias("registries"),
        F.transform(F.filter(F.coalesce("institutions", F.array().cast(NAMED)), lambda i: F.coalesce(i["selected"], F.lit(False))), lambda i: _told(i["name"])).alias("institutions"),
        text(TEXT_SECTION).alias(TEXT_SECTION), *[s for s in (*SHARED_SECTIONS, *VARIATION_SECTIONS) if s != TEXT_SECTION], F.array_sort(placed).alias("faqs"),
        F.transform(F.filter(F.coalesce("variations", F.array().cast("array<struct<idServiceVariation:long,shortName:string>>")), lambda v: F.coalesce(v["idServiceVariation"], F.lit(0)) != 0), lambda v: F.struct(v["idServiceVariation"].alias("id_variation"), _told(v["shortName"]).alias("short_name"))).alias("variations"),
    )


def display_name(of_variation: bool) -> Column:
    """The service's name, with the variation's unless it is in it already."""
    number = F.concat(F.lit("услуга "), F.col("id_service").cast("string"))
    base = F.coalesce(F.nullif("service_name", F.lit("")), F.nullif("service_short_name", F.lit("")), number)
    v = F.col("variation_short_name")
    both = F.when((v != "") & ~F.contains(F.lower(base), F.lower(v)), F.concat_ws(" — ", base, v)).otherwise(base)
    return F.when(F.col("is_variation"), both).otherwise(base) if of_variation else base


def access_text() -> Column:
    """How the service is reached and paid for: up to three lines; their leads are fixed values."""
    line = lambda lead, names: F.when(F.size(names) > 0, F.concat(F.lit(lead), F.array_join(names, "; ")))
    online = F.when(F.col("is_online") & F.col("online_url").isNotNull(), F.concat(F.lit("Услугата е достапна онлајн: "), F.col("online_url"))).when(F.col("is_online"), "Услугата е достапна онлајн.")
    return F.concat_ws("\n", online, line("Начини на плаќање: ", "payment_methods"), line("Начини на пристап: ", "other_offices"))


def _parts(sections: tuple[str, ...], profile: Profile, access: bool, told: bool) -> Column:
    """(suffix, type, label, row, content) of a record, in order; empty ones are left out."""
    empty = F.array().cast("array<struct<suffix:string,type:string,label:string,row:int,content:string>>")

    def part(suffix: Column, kind: str, label: str, row: Column, content: Column) -> Column:
        return F.struct(suffix.alias("suffix"), F.lit(kind).alias("type"), F.lit(label).alias("label"), row.cast("int").alias("row"), content.alias("content"))

    def rows(section: str) -> Column:
        one = lambda cells, i: part(F.concat(F.lit(f"{section}_"), (i + 1).cast("string")), section, profile.labels.get(section, section), i + 1, row_text(cells))
        return F.coalesce(F.transform(decoded(section), one), empty)

    none = F.lit(None).cast("int")
    found = []
    if told:
        found.append(F.array(part(F.lit("description"), "description", "Опис на услугата", none, F.col("service_description"))))
    if access:
        found.append(F.array(part(F.lit("access"), "access", "Пристап и плаќање", none, access_text())))
    found += [F.array(part(F.lit(s), s, profile.labels.get(s, s), none, F.col(s))) if s == TEXT_SECTION else rows(s) for s in sections]
    if told:
        body = lambda f: F.concat(F.lit("Прашање: "), F.coalesce(f["question"], F.lit("")), F.lit("\nОдговор: "), F.coalesce(f["answer"], F.lit("")))
        found.append(F.transform("faqs", lambda f, i: part(F.concat(F.lit("faq_"), (i + 1).cast("string")), "faq", "Често поставувани прашања", i + 1, body(f))))
    return F.filter(F.concat(*found), lambda p: F.coalesce(p["content"], F.lit("")) != "")


def _blocks(records: DataFrame, parts: Column, shared: bool) -> DataFrame:
    mark = F.lit("_shared_") if shared else F.concat(F.lit("_v"), F.col("id_variation").cast("string"), F.lit("_"))
    name = display_name(not shared)
    own = records.select("*", name.alias("shown"), F.explode(parts).alias("p"))
    context = F.concat(F.lit("Услуга: "), F.col("shown"), F.lit(" | "), F.col("p.label"))
    applies = F.col("siblings") if shared else F.lit(None).cast("array<bigint>")
    return own.select(
        F.concat(F.lit("srv_"), F.col("id_service").cast("string"), mark, F.col("p.suffix")).alias("chunk_id"), F.lit("service" if shared else "variation").alias("scope"), F.col("p.type").alias("type"), F.col("p.row").alias("row"),
        "id_service", (F.lit(None).cast("long") if shared else F.col("id_variation")).alias("id_variation"), applies.alias("applies_to_variations"), "service_name",
        (F.lit(None).cast("string") if shared else F.nullif("variation_short_name", F.lit(""))).alias("variation_short_name"), (F.lit(None).cast("boolean") if shared else F.col("is_online")).alias("is_online"),
        F.when(F.col("p.type") == "access", F.col("online_url")).alias("online_url"), context.alias("context"), F.col("p.content").alias("content"), F.concat_ws("\n", context, F.col("p.content")).alias("embedding_text"),
    )


def _texts_read(records: DataFrame) -> DataFrame:
    """Questions and answers as text; one row a question goes through the parser, so none is collected."""
    asked = records.select("path", F.posexplode("faqs").alias("at", "f")).select("path", "at", fix_links(html_to_text(F.col("f.question"))).alias("question"), fix_links(html_to_text(F.col("f.answer"))).alias("answer"))
    read = asked.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "question", "answer"))).alias("faqs"))
    none = F.array().cast("array<struct<at:int,question:string,answer:string>>")
    some = F.coalesce(F.size("faqs") > 0, F.lit(False))
    told = records.where(some).drop("faqs").join(read, "path", "left").withColumn("faqs", F.coalesce("faqs", none))
    return told.unionByName(records.where(~some).withColumn("faqs", none))


def build_corpus(files: DataFrame, profile: Profile = MACEDONIAN) -> tuple[DataFrame, DataFrame]:
    """(blocks, the skip report)."""
    good, skipped = accepted(stored(parse_service(files.withColumn("kind", classified("text"))), "records"))
    records = stored(_texts_read(good), "records")
    of_variation = Window.partitionBy("id_service", "id_variation").orderBy("path")
    variations = records.where("is_variation").withColumn("n", F.row_number().over(of_variation)).where("n = 1").drop("n")
    last = Window.partitionBy("id_service").orderBy(F.desc("path"))
    bases = records.where("NOT is_variation").withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")
    siblings = variations.groupBy("id_service").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "id_variation"))), lambda x: x["id_variation"]).alias("siblings"), F.min("path").alias("first_path"))
    led = bases.join(siblings, "id_service")
    orphans = variations.join(siblings, "id_service").where("path = first_path").join(bases.select("id_service"), "id_service", "left_anti")
    shared = led.unionByName(orphans)
    alone = bases.join(siblings, "id_service", "left_anti")
    every = (*VARIATION_SECTIONS[:6], "terminology", *VARIATION_SECTIONS[6:], TEXT_SECTION)
    parts = [
        _blocks(shared, _parts(SHARED_SECTIONS, profile, access=False, told=True), True),
        _blocks(variations, _parts(VARIATION_SECTIONS, profile, access=True, told=False), False),
        _blocks(alone, _parts(every, profile, access=True, told=True), False),
    ]
    return reduce(DataFrame.unionByName, parts), skipped


def summary(blocks: DataFrame, skipped: DataFrame) -> DataFrame:
    """(measure, key, n): blocks by scope and by type, services, variations, variations named like their service, and what was skipped.

    The blocks are read once, into counts by variation and type, which give all measures.
    """
    same = F.coalesce(F.lower(F.trim("variation_short_name")) == F.lower(F.trim("service_name")), F.lit(False))
    counts = stored(blocks.groupBy("scope", "type", "id_service", "id_variation").agg(F.count("*").alias("rows"), F.count_if(same).alias("same")), "counts")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    by = [counts.groupBy(F.lit(c).alias("measure"), F.col(c).alias("key")).agg(total("rows").alias("n")) for c in ("scope", "type")]
    one = lambda name, rows, n: rows.agg(n.alias("n")).select(F.lit(name).alias("measure"), F.lit("").alias("key"), "n")
    whole = [one("blocks", counts, total("rows")), one("services", counts, F.count_distinct("id_service")), one("variations", counts.where("id_variation > 0"), F.count_distinct("id_service", "id_variation")), one("single form", counts, total("same"))]
    return reduce(DataFrame.unionByName, [*by, *whole, skipped.groupBy(F.lit("skipped").alias("measure"), F.col("kind").alias("key")).agg(F.count("*").alias("n"))])


def newest(files: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """(prefix, path): of the files whose name begins with each prefix, the greatest name."""
    name = F.element_at(F.split("path", "/"), -1)
    known = F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(name, p))
    return files.select("path", name.alias("name"), F.explode(known).alias("prefix")).groupBy("prefix").agg(F.max_by("path", "name").alias("path"))
