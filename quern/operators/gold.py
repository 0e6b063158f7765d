"""Gold cases made from the corpus itself: families with known answers, capped evenly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Caps of the families.
CAPS = {"faq": 80, "terminology": 60, "service_lookup": 112, "intent": 120, "variation": 140}


def round_robin(rows: DataFrame, key: str, item: str, cap: int | None = None, seed: int = 20260728) -> DataFrame:
    """rows with place: one item of each key a pass, keys and items in hash order."""
    mixed = lambda c: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(c).cast("string")).cast("binary"))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(mixed(item), item))
    placed = rows.withColumn("turn", turn).withColumn("key_hash", mixed(key))
    return placed.orderBy("turn", "key_hash", key).limit(cap) if cap is not None else placed


def _question_family(blocks: DataFrame, kind: str, pattern: str, least: int, most: int, family: str, template: str = "%s") -> DataFrame:
    """Cases of one text pattern; all blocks with an equal question are primary."""
    own = blocks.where(F.col("type") == kind).withColumn("q", F.trim(F.regexp_extract("content", pattern, 1)))
    own = own.where((F.char_length("q") >= least) & (F.char_length("q") <= most))
    one = own.groupBy("q").agg(F.min("pos").alias("pos"), F.min("id_service").alias("expect_service"), F.map_from_entries(F.collect_set(F.struct("chunk_id", F.lit(2)))).alias("gold"))
    return one.select(F.concat(F.lit(f"{family}_"), F.substring(F.sha1(F.col("q").cast("binary")), 1, 10)).alias("case_id"), F.format_string(template, "q").alias("query"), F.lit(family).alias("family"), "gold", "expect_service", F.lit(None).cast("int").alias("expect_variation"))


def faq(blocks: DataFrame) -> DataFrame:
    return _question_family(blocks, "faq", r"(?s)^Прашање:\s*(.+?)\nОдговор:", 12, 10_000, "faq")


def terminology(blocks: DataFrame) -> DataFrame:
    return _question_family(blocks, "terminology", r"(?s)^Термин:\s*(.+?)\s*\|", 3, 60, "terminology", "Што значи %s?")


def _supported(cases: DataFrame, blocks: DataFrame) -> DataFrame:
    """cases with gold: their ids are primary; shared rows and, of a target variation or without one, its others support."""
    others = blocks.groupBy("id_service", "id_variation").agg(F.collect_set("chunk_id").alias("all"))
    target = F.col("expect_variation")
    met = cases.join(others, (F.col("expect_service") == F.col("id_service")) & (F.col("id_variation").isNull() | target.isNull() | (F.col("id_variation") == target)))
    every = met.groupBy("case_id").agg(F.flatten(F.collect_list("all")).alias("all"))
    grade = lambda ids, g: F.map_from_entries(F.transform(ids, lambda i: F.struct(i, F.lit(g))))
    both = cases.join(every, "case_id")
    return both.withColumn("gold", F.map_concat(grade(F.col("ids"), 2), grade(F.array_except("all", "ids"), 1))).select("case_id", "query", "family", "gold", "expect_service", "expect_variation")


def service_lookup(blocks: DataFrame) -> DataFrame:
    """The service's name asks for its description; its other rows support."""
    names = blocks.where("service_name <> ''").groupBy("id_service").agg(F.min_by("service_name", "pos").alias("query"))
    own = blocks.where("type = 'description'").groupBy("id_service").agg(F.collect_set("chunk_id").alias("ids")).join(names, "id_service")
    cases = own.select(F.concat(F.lit("svc_"), F.col("id_service").cast("string")).alias("case_id"), "query", F.lit("service_lookup").alias("family"), "ids", F.col("id_service").alias("expect_service"), F.lit(None).cast("long").alias("expect_variation"))
    return _supported(cases, blocks)


def intent(blocks: DataFrame, templates: dict[str, tuple[str, ...]], most: int = 90, seed: int = 20260728) -> DataFrame:
    """Each section of a service with at most one variation and a short name, asked for in one of the section's templates."""
    names = blocks.where("service_name <> ''").groupBy("id_service").agg(F.min_by("service_name", "pos").alias("name"), F.count_distinct("id_variation").alias("n")).where((F.col("n") <= 1) & (F.char_length("name") <= most))
    own = blocks.where(F.col("type").isin(list(templates))).groupBy("id_service", "type").agg(F.collect_set("chunk_id").alias("ids")).join(names, "id_service")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id_service").cast("string"), "type").cast("binary")), 1, 8), 16, 10).cast("long")
    query = F.lit(None).cast("string")
    for kind, asked in templates.items():
        one = F.element_at(F.array(*[F.format_string(t, "name") for t in asked]), (draw % len(asked) + 1).cast("int"))
        query = F.when(F.col("type") == kind, one).otherwise(query)
    key = F.concat_ws("_", F.lit("intent"), F.col("id_service").cast("string"), "type")
    cases = own.select(key.alias("case_id"), query.alias("query"), F.concat(F.lit("intent_"), "type").alias("family"), "ids", F.col("id_service").alias("expect_service"), F.lit(None).cast("long").alias("expect_variation"))
    return _supported(cases, blocks)


def variation(blocks: DataFrame, templates: dict[str, str]) -> DataFrame:
    """One case a (service, variation, section): its rows are primary, shared rows and its other rows support, siblings are none."""
    own = blocks.where("id_variation IS NOT NULL AND variation_short_name IS NOT NULL").where(F.col("type").isin(list(templates)))
    rows = own.groupBy("id_service", "id_variation", "type").agg(F.min("service_name").alias("service_name"), F.min("variation_short_name").alias("label"), F.collect_set("chunk_id").alias("ids"))
    text = reduce(lambda c, kv: F.when(F.col("type") == kv[0], F.format_string(kv[1], "service_name", "label")).otherwise(c), templates.items(), F.lit(None).cast("string"))
    key = F.concat_ws("_", F.lit("variation"), "id_service", "id_variation", "type")
    return _supported(rows.select(key.alias("case_id"), text.alias("query"), F.lit("variation").alias("family"), "ids", F.col("id_service").alias("expect_service"), F.col("id_variation").alias("expect_variation")), blocks)


def selected(cases: DataFrame, families: tuple[str, ...] = (), leaky: tuple[str, ...] = (), limit: int | None = None, keep_ungraded: bool = False) -> DataFrame:
    """Cases of the wanted families, without leaky ones and those without a primary row; the first by id up to a limit."""
    if families:
        cases = cases.where(F.col("family").isin(*families))
    if leaky:
        cases = cases.where(~F.col("family").isin(*leaky))
    if not keep_ungraded:
        cases = cases.where(F.exists(F.map_values("gold"), lambda g: g >= 2))
    return cases.orderBy("case_id").limit(limit) if limit is not None else cases


def generate(families: list[DataFrame], caps: dict[str, int] = CAPS) -> DataFrame:
    """The union of the families, each cut to its cap evenly over the services."""
    return reduce(DataFrame.unionByName, [round_robin(f, "expect_service", "case_id", cap).drop("turn", "key_hash") for f, cap in zip(families, [caps.get(n, 100) for n in _names(families)])])


def _names(families: list[DataFrame]) -> list[str]:
    return [(f.select("family").first() or ["other"])[0] for f in families]


def graded(cases: DataFrame) -> DataFrame:
    """(case_id, id, grade) of the cases' gold maps."""
    return cases.select("case_id", F.explode("gold").alias("id", "grade"))


# Sections whose equal texts are the same fact, wherever they stand.
COPY_TOLERANT = ("terminology", "faq", "legalBasis")


def _resolved(wanted: DataFrame, found: DataFrame, key: list[str], what: str) -> DataFrame:
    """found, which must have a row for each key of wanted."""
    lost = [r.asDict() for r in wanted.select(*key).join(found.select(*key), key, "left_anti").limit(5).collect()]
    if lost:
        raise ValueError(f"rules whose {what} name no rows: {lost}")
    return found.select("case_id", "chunk_id")


def curated(specs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(case_id, id, grade) of hand-written rules; 2 is primary, 1 supports.

    specs are (case_id, id_service, id_variation, targets, ids, places, pinned,
    also_services): targets (id_service, id_variation, types) name sections, ids
    rows, places (municipality, list_key) parts of a directory, of any list where
    that is null.  Unless a rule is pinned, equal texts in sections that tolerate
    copies are primary too.  Rows of the rule's service that are shared or of its
    variation support, and all rows of also_services.  A part of a rule that names
    no rows raises, and so does a rule without parts: leave out cases that expect
    no answer.  blocks are (chunk_id, id_service, id_variation, type, content,
    municipality, list_key).
    """
    rows = blocks.select("chunk_id", F.col("id_service").alias("s"), F.col("id_variation").alias("v"), F.col("type").alias("t"), F.col("municipality").alias("m"), F.col("list_key").alias("l"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    typed = specs.select("case_id", F.posexplode("targets").alias("n", "x")).select("case_id", "n", "x.id_service", "x.id_variation", F.explode("x.types").alias("type"))
    by_type = typed.join(rows, (F.col("id_service") == F.col("s")) & (F.col("type") == F.col("t")) & (F.col("id_variation").isNull() | (F.col("id_variation") == F.col("v"))))
    named = specs.select("case_id", F.explode("ids").alias("chunk_id"))
    placed = specs.select("case_id", F.posexplode("places").alias("n", "x")).select("case_id", "n", "x.municipality", "x.list_key")
    by_place = placed.join(rows, (F.col("municipality") == F.col("m")) & (F.col("list_key").isNull() | (F.col("list_key") == F.col("l"))))
    first = _resolved(typed, by_type, ["case_id", "n", "type"], "sections")
    first = first.unionByName(_resolved(named, named.join(rows, "chunk_id", "left_semi"), ["case_id", "chunk_id"], "ids"))
    first = first.unionByName(_resolved(placed, by_place, ["case_id", "n"], "places")).distinct()
    _resolved(specs, first, ["case_id"], "parts")
    free = specs.where("NOT coalesce(pinned, false)").select("case_id")
    wanted = first.join(free, "case_id", "left_semi").join(rows.where(F.col("t").isin(*COPY_TOLERANT)).select("chunk_id", "digest"), "chunk_id").select("case_id", "digest").distinct()
    primary = first.unionByName(wanted.join(rows, "digest").select("case_id", "chunk_id"))
    near = specs.join(rows, (F.col("id_service") == F.col("s")) & (F.col("v").isNull() | F.col("id_variation").isNull() | (F.col("id_variation") == F.col("v")))).select("case_id", "chunk_id")
    also = specs.select("case_id", F.explode("also_services").alias("s")).join(rows, "s").select("case_id", "chunk_id")
    every = primary.withColumn("grade", F.lit(2)).unionByName(near.unionByName(also).withColumn("grade", F.lit(1)))
    return every.groupBy("case_id", F.col("chunk_id").alias("id")).agg(F.max("grade").alias("grade"))
