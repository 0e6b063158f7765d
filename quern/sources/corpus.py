"""Corpus, case, answer and report files; the strict gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The block types that the gate lets pass.
TYPES = ("description", "access", "process", "documents", "forms", "tariffs", "deadlines", "documentsLocations", "instructions", "discounts", "terminology", "legalBasis", "faq", "agents")
SCOPES = ("variation", "service", "directory")
METADATA = "scope string, type string, id_service int, id_variation int, service_name string, variation_short_name string, is_online boolean, row int, online_url string, applies_to_variations array<int>, list string, municipality string, n_agents int, part int, n_parts int, source_file string, updated string"
BLOCK = f"chunk_id string, context string, content string, embedding_text string, metadata struct<{','.join(x.replace(' ', ':', 1) for x in METADATA.split(', '))}>"
CASE = "case_id string, query string, family string, source string, gold map<string,int>, expect_service int, expect_variation int, expect_types array<string>, difficulty string, notes string, expect_behavior string, live_tool boolean, expect_values array<string>, forbid_values array<string>, turns array<string>, expect_turn_behaviors array<string>"
ANSWER = "case_id string, query string, text string, citations array<string>, stale_citations array<string>, invalid_citations array<string>, docs array<string>, asked_clarification boolean, ambiguity_source string, model string, prompt_tokens long, completion_tokens long, cost_usd double, retrieval_ms double, generation_ms double, error string, live_docs map<string,string>, turns array<struct<query:string,text:string,citations:array<string>,docs:array<string>,asked_clarification:boolean>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lineno, value): lines numbered within each file, in file order."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    from pyspark.sql.window import Window

    return lines.withColumn("lineno", F.row_number().over(Window.partitionBy("file").orderBy("block", "at"))).select("file", "lineno", "value")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with their metadata flat and pos, the order of the file."""
    raw = spark.read.schema(BLOCK).json(path).withColumn("pos", F.monotonically_increasing_id())
    return raw.select("chunk_id", "context", "content", "embedding_text", "metadata.*", "pos").withColumnRenamed("list", "list_key")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def unique(rows: DataFrame, key: str) -> DataFrame:
    """rows, if their key is unique; else ValueError names some."""
    bad = [r[0] for r in duplicate_keys(rows, key).orderBy(key).limit(5).collect()]
    if bad:
        raise ValueError(f"{key} repeats: {bad}")
    return rows


def block_problems(blocks: DataFrame) -> DataFrame:
    """(chunk_id, pos, problem): every broken rule of every block; the first aborts a build."""
    has = lambda c: F.col(c).isNotNull()
    rules: list[tuple[str, Column]] = [
        ("missing field", ~(has("chunk_id") & has("content") & has("embedding_text") & has("type"))),
        ("unknown scope", ~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False))),
        ("unknown type", ~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))),
        ("no service id", (F.col("scope") != "directory") & ~has("id_service")),
        ("id not in key", (F.col("scope") != "directory") & ~F.contains("chunk_id", F.concat(F.lit("srv_"), F.col("id_service").cast("string"), F.lit("_")))),
        ("no variation", (F.col("scope") == "variation") & ~has("id_variation")),
        ("variation of shared", (F.col("scope") == "service") & has("id_variation")),
        ("part beyond parts", (F.col("scope") == "directory") & ~F.coalesce(F.col("part") <= F.col("n_parts"), F.lit(False))),
        ("content not embedded", ~F.contains("embedding_text", F.col("content"))),
    ]
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules]), lambda x: x.isNotNull())
    own = blocks.select("chunk_id", "pos", F.explode(broken).alias("problem"))
    twice = blocks.join(duplicate_keys(blocks, "chunk_id").select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "pos", F.lit("key repeats").alias("problem"))
    return own.unionByName(twice)


def gate(blocks: DataFrame) -> DataFrame:
    """blocks, if no rule is broken; else ValueError with the first problem in file order."""
    first = block_problems(blocks).orderBy("pos", "problem").first()
    if first:
        raise ValueError(f"{first['chunk_id']}: {first['problem']}")
    return blocks


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases with line numbers; blank and // lines are skipped; bad lines and unknown fields raise."""
    known = [x.split()[0] for x in CASE.split(", ")]
    lines = numbered_lines(spark, path).where("trim(value) <> '' AND NOT startswith(trim(value), '//')")
    extra = F.array_except(F.coalesce(F.json_object_keys("value"), F.array(F.lit("not JSON"))), F.array(*map(F.lit, known)))
    bad = lines.withColumn("extra", extra).where(F.size("extra") > 0).orderBy("file", "lineno").first()
    if bad:
        raise ValueError(f"line {bad['lineno']}: {bad['extra']}")
    return lines.select("lineno", F.from_json("value", CASE).alias("c")).select("lineno", "c.*")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Saved answers; unknown fields are ignored, missing ones null."""
    return spark.read.schema(ANSWER).json(path)


def write_lines(rows: DataFrame, path: str, order: str) -> None:
    """JSON lines, sorted; several files that sort by name, so nothing passes through one task."""
    rows.orderBy(order).write.mode("overwrite").json(path)


def case_problems(cases: DataFrame, blocks: DataFrame) -> DataFrame:
    """(case_id, problem) of a gold table: repeats, empty queries, no primary, stale ids, grades, turns."""
    rules = [
        ("empty query", F.trim(F.coalesce("query", F.lit(""))) == ""),
        ("no primary", ~F.exists(F.map_values(F.coalesce("gold", F.create_map().cast("map<string,int>"))), lambda g: g == 2) & F.col("expect_behavior").isNull()),
        ("bad grade", F.exists(F.map_values(F.coalesce("gold", F.create_map().cast("map<string,int>"))), lambda g: ~g.isin(1, 2))),
        ("turns don't match", (F.size(F.coalesce("expect_turn_behaviors", F.array().cast("array<string>"))) > 0) & (F.size("expect_turn_behaviors") != F.size(F.coalesce("turns", F.array().cast("array<string>"))) + 1)),
    ]
    own = [cases.where(c).select("case_id", F.lit(name).alias("problem")) for name, c in rules]
    own.append(duplicate_keys(cases, "case_id").select("case_id", F.lit("id repeats").alias("problem")))
    ids = cases.select("case_id", F.explode(F.map_keys("gold")).alias("chunk_id"))
    own.append(ids.join(blocks.select("chunk_id"), "chunk_id", "left_anti").select("case_id", F.lit("stale id").alias("problem")))
    return reduce(DataFrame.unionByName, own)


def digest(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(n, digest), one row: equal for equal corpora in any order and partitioning.

    The eight words of each row's SHA-256 are summed exactly, so that every task adds
    up its own rows and no rows meet; the digest is that of the count and the sums.
    Repeated rows count; nulls are told apart from empty texts.
    """
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    own = rows.select(F.sha2(F.concat(F.char_length(told(key)).cast("string"), F.lit(":"), told(key), told(content)).cast("binary"), 256).alias("sha"))
    words = [F.conv(F.substring("sha", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = [F.coalesce(F.sum(w), F.lit(0)).cast("string") for w in words]
    return own.agg(F.count("*").alias("n"), F.array(*sums).alias("sums")).select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.array_join("sums", ":")).cast("binary"), 256).alias("digest"))
