"""Index upkeep: only what changed is embedded again, what left the corpus is pruned."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import embedding_input, embedding_key
from quern.tables import stored


def keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("sha"))


def difference(index: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, action): unchanged, updated, added or pruned, by id and digest of the text."""
    old, new = keyed(index, id_col, text_col).withColumnRenamed("sha", "old"), keyed(rows, id_col, text_col).withColumnRenamed("sha", "new")
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "pruned").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return old.join(new, "id", "full").select("id", action.alias("action"))


def payload(blocks: DataFrame, text_col: str = "embedding_text") -> DataFrame:
    """blocks with variation_scope, the variations they hold for, and the text's digest."""
    scope = F.when(F.col("scope") == "service", F.coalesce("applies_to_variations", F.array().cast("array<int>"))).when(F.col("id_variation").isNotNull(), F.array(F.col("id_variation").cast("int"))).otherwise(F.array().cast("array<int>"))
    return blocks.withColumn("variation_scope", scope).withColumn("text_sha256", F.sha2(F.col(text_col).cast("binary"), 256))


def batches_of(texts: list[str], most: int = 256, characters: int = 200_000) -> Iterator[tuple[int, int]]:
    """Slices of at most so many texts and characters; one longer text stands alone."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and (i - begin >= most or size + len(t) > characters):
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


class Refused(Exception):
    """What an encoder raises when it may accept the same texts later."""


def patient(encode: Callable[[list[str]], list[list[float]]], tries: int = 6, budget: int = 20, first: float = 0.5, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[list[float] | None]]:
    """encode with waits: after each refusal twice as long, at most `most` seconds, times a draw between a half and one.

    Texts are refused for good, with None each, after so many tries, or when the
    waits of the whole partition have used up its budget.  The draws depend on the
    texts, so a task that runs again waits alike.
    """
    left = [budget]

    def run(texts: list[str]) -> list[list[float] | None]:
        draw = random.Random(texts[0] if texts else "")
        for n in range(tries):
            try:
                return encode(texts)
            except Refused:
                if n == tries - 1 or left[0] <= 0:
                    break
                left[0] -= 1
                sleep(min(most, first * 2**n) * draw.uniform(0.5, 1))
        return [None] * len(texts)

    return run


def encoded(rows: DataFrame, encode: Callable[[list[str]], list[list[float]]], id_col: str, text_col: str, batch: int = 256, **how) -> tuple[DataFrame, DataFrame]:
    """(id, vector) of texts that were encoded, and (id) of those that were not: a refusal costs its rows, not the job.

    encode is pickled to the tasks; how is for patient().  A row's batch is its own
    task's, so the waits of one partition don't hold up another.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tried = patient(encode, **how)
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            for a, b in batches_of(texts, batch):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, b - a), pa.array(tried(texts[a:b]), pa.list_(pa.float32()))], ["id", "vector"])

    done = stored(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, vector array<float>"), "encoded")
    return done.where("vector IS NOT NULL"), done.where("vector IS NULL").select("id")


def embedded(rows: DataFrame, cache: DataFrame, encode: Callable[[list[str]], list[list[float]]], model: str, dims: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, key, vector) of all rows, and what is new for the cache (key, vector).

    Each missing text is encoded once, in bounded batches inside the tasks; the
    caller appends the second table to the cache.  encode is the model's seam; a
    batch that it refuses is halved until single texts are left.
    """
    own = rows.select(F.col(id_col).alias("id"), embedding_input(text_col).alias("text")).withColumn("key", embedding_key(model, dims, "text"))
    missing = own.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def tried(texts: list[str]) -> list[list[float]]:
        try:
            return encode(texts)
        except ValueError:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return tried(texts[:half]) + tried(texts[half:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in batches_of(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(tried(texts[a:b]), pa.list_(pa.float32()))], ["key", "vector"])

    new = missing.mapInArrow(run, "key string, vector array<float>")
    return own.select("id", "key").join(cache.select("key", "vector").unionByName(new), "key"), new


def needs_rebuild(manifest: dict | None, model: str, dims: int, field: str) -> bool:
    """Another model, size or field makes every vector stale."""
    return manifest is None or (manifest.get("model"), manifest.get("dims"), manifest.get("embed_field")) != (model, dims, field)


def write_manifest(spark, path: str, **values) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark, path: str) -> dict | None:
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(path).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return json.loads(rows[0][0]) if rows else None


def estimate(rows: DataFrame, text_col: str, characters_a_token: float = 2.0, price: float = 0.02) -> DataFrame:
    """(rows, characters, tokens, cost): what embedding all rows would take; price is for a million tokens."""
    size = F.sum(F.char_length(F.coalesce(F.col(text_col), F.lit("")))).alias("characters")
    return rows.agg(F.count("*").alias("rows"), size).withColumn("tokens", F.col("characters") / characters_a_token).withColumn("cost", F.col("tokens") * price / 1e6)


def statistics(done: DataFrame) -> DataFrame:
    """(added, updated, unchanged, pruned, total) of a difference's actions, in one row; total is what the index holds then."""
    kinds = ("added", "updated", "unchanged", "pruned")
    return done.agg(*[F.count_if(F.col("action") == k).alias(k) for k in kinds], F.count_if(F.col("action") != "pruned").alias("total"))
