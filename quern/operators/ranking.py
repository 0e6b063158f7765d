"""Ranked lists: (query_id, id, score, rank) with rank from 1; ties go to the smaller id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.tables import stored

RRF_K = 60
#: Rows of a query batch that may be sent to every task.
BATCH_ROWS = 10_000


def batch(queries: DataFrame, most: int = BATCH_ROWS) -> DataFrame:
    """Broadcast a query batch of checked size; a larger one is left to Spark's own choice."""
    return F.broadcast(queries) if queries.limit(most + 1).count() <= most else queries


def top(scored: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), id_col: str = "id", score: str = "score", digits: int | None = None) -> DataFrame:
    """The k best of each group; with digits, scores are rounded before they are compared."""
    if digits is not None:
        scored = scored.withColumn(score, F.round(score, digits))
    window = Window.partitionBy(*by).orderBy(F.desc(score), id_col)
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """rows with their number in the group, from 1, where a group may be too large for one task.

    Ranges of (group, order) are numbered apart, and each starts after the rows of
    its group in the ranges before it.  Rows should be narrow: they are written once.
    """
    ranges = stored(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_at"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), by, F.col("_range") == F.col("_at"))
    return ranges.withColumn(name, own).join(starts, same).select(*rows.columns, (F.col(name) + F.col("_before")).alias(name))


def normalized_hits(hits: DataFrame, k: int) -> DataFrame:
    """Each id once, at its best rank, ranks made dense again, cut to k."""
    first = hits.groupBy("query_id", "id").agg(F.min("rank").alias("was"), F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("was", "id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def rrf(arms: list[tuple[DataFrame, float]], k: int, constant: int = RRF_K, digits: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion: a union and one sum stand for the full outer join of the lists."""
    parts = [df.select("query_id", "id", (F.lit(float(w)) / (constant + F.col("rank"))).alias("part")) for df, w in arms]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("part").alias("score"))
    return top(fused, k, digits=digits)


def payload_filter(filters: dict, columns: dict[str, str] | None = None, arrays: tuple[str, ...] = ()) -> Column:
    """All fields must fit: a value equals, a list holds any of; array columns overlap.

    form_scope keeps rows of the named form and rows without a form.
    """
    columns = {"service_scope": "id_service"} | (columns or {})
    out = F.lit(True)
    for name, value in filters.items():
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        column = F.col(columns.get(name, name))
        if name == "form_scope":
            form = F.col(columns.get(name, "variation_short_name"))
            out &= form.isNull() | (form == "") | form.isin(values)
        elif name in arrays:
            out &= F.arrays_overlap(column, F.array(*map(F.lit, values)))
        else:
            out &= column.isin(values)
    return out


def filtered(hits: DataFrame, rows: DataFrame, condition: Column, k: int, id_col: str = "id") -> DataFrame:
    """Filter after the cut, as the arms are cut first; then ranks close up and k stay."""
    kept = hits.join(rows.where(condition).select(F.col(id_col).alias("id")), "id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def random_floor(queries: DataFrame, rows: DataFrame, k: int, id_col: str, seed: int = 7) -> DataFrame:
    """k rows of hash order for each query: one draw of the rows, turned by the query's hash."""
    drawn = rows.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h")).orderBy("h", "id").limit(k)
    scored = drawn.join(batch(queries.select("query_id")), F.lit(True)).withColumn("score", F.pmod(F.xxhash64("id", "query_id", F.lit(seed)), F.lit(1_000_000)) / 1e6)
    return top(scored.select("query_id", "id", "score"), k)


def oracle_ceiling(gold: DataFrame, k: int) -> DataFrame:
    """The gold itself, best grades first."""
    return top(gold.select(F.col("case_id").alias("query_id"), "id", F.col("grade").cast("double").alias("score")), k)
