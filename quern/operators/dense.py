"""Exact cosine search: query batches in blocks against all rows, no pairs are kept."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.ranking import top


def _matrix(column: pa.Array) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in column.to_pylist()])
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best finite scores of each line, ties to the smaller id; only what ties with the k-th or better is sorted."""
    if k < score.shape[1]:
        least = np.partition(score, -k, axis=1)[:, -k, None]
        i, j = np.nonzero((score >= least) & (score > -np.inf))
    else:
        i, j = np.nonzero(score > -np.inf)
    order = np.lexsort((ids[j], -score[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]


def search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str | None = None, threshold: float | None = None, exclude_self: bool = False, block: int = 4096, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank); queries are (query_id, embedding[, group]).

    With group_col a row must be of the query's group.  Each task keeps k rows a
    query of every Arrow batch; a window picks the k best of all.  Null vectors
    are neither queries nor answers.
    """
    rows = rows.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    queries = queries.where(F.col("embedding").isNotNull())
    number = -(-queries.count() // block)
    kind = rows.schema[id_col].dataType.simpleString()
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), (F.col(group_col) if group_col else F.lit(0)).cast("string").alias("g"))
    parts = []
    for n in range(number):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(number)) == n) if number > 1 else queries
        table = own.select("query_id", "embedding", (F.col("group") if group_col else F.lit(0)).cast("string").alias("g")).orderBy("query_id").toArrow()
        if not table.num_rows:
            continue
        ids, q, groups = table.column("query_id").to_numpy(), _matrix(table.column("embedding").combine_chunks()), np.array(table.column("g").to_pylist())
        shared = rows.sparkSession.sparkContext.broadcast((ids, q, groups))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, groups = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                score = np.round(q @ _matrix(batch.column(1)).T, digits)
                own = batch.column(0).to_numpy()
                allowed = groups[:, None] == np.array(batch.column(2).to_pylist())[None, :]
                if exclude_self:
                    allowed &= ids[:, None] != own[None, :]
                if threshold is not None:
                    allowed &= score >= threshold
                score = np.where(allowed, score, -np.inf)
                i, j = best(score, own, k)
                yield pa.RecordBatch.from_pydict({"query_id": ids[i], "id": own[j], "score": score[i, j]})

        parts.append(base.mapInArrow(run, f"query_id {own.schema['query_id'].dataType.simpleString()}, id {kind}, score double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {kind}, score double, rank int")
    return top(reduce(DataFrame.unionByName, parts), k)
