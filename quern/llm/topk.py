"""Exact top-k search on binary codes by incremental multi-index hashing.

A code is cut into m segments of 16 bits, four for each 64 components; each
segment has a table of its values.  Round s probes, for each segment, the table at
all values that differ from the query's in exactly s bits.  After round s every
code within distance m (s + 1) - 1 has been met in some segment, so a query with
k rows verified within that distance is done; the others go on.  A code is verified
once: in the round and at the segment where its least segment distance shows.

The codes are dealt to tasks, each of which searches its own tables; the k best
of all tasks are the k best of all.  The query set is taken in blocks of bounded
size that go to every task.  Equal codes are one entry, which keeps its k + 1
smallest ids, so a code that a third of all rows share stays small.

Defined results: rows with a null id or vector are neither queries nor answers;
ties go to the smaller id; a query isn't its own answer; repeated rows of one id
count once, with the smallest code; with fewer than k other rows all are answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import stored

BITS, WIDTH = 64, 16
U = np.uint64
#: Values of a segment by their number of bits.
MASKS = [np.flatnonzero(np.bitwise_count(np.arange(1 << WIDTH)) == s) for s in range(WIDTH + 1)]
#: Queries that one broadcast holds, and codes that one task's tables hold.
QUERY_BLOCK, TABLE_CODES = 1_000_000, 250_000
_TOGETHER = 32


def sign_code(vector: str, dims: int) -> Column:
    """As longs: bit i is set where component i is above zero; missing components are not."""

    def long(first: int) -> Column:
        bits = [F.when(F.get(F.col(vector), F.lit(first + i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(min(BITS, dims - first))]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return F.array(*[long(i) for i in range(0, dims, BITS)])


def codes(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code) by the signs of all components, up to those of the longest vector."""
    own = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    dims = max(own.agg(F.max(F.size(vector_col))).first()[0] or 0, 1)
    return own.select(F.col(id_col).cast("long").alias("id"), sign_code(vector_col, dims).alias("code")).groupBy("id").agg(F.min("code").alias("code"))


def _numbers(column: pa.Array) -> np.ndarray:
    """Codes of a column, a row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)


def _segments(x: np.ndarray) -> np.ndarray:
    return np.stack([((x[:, w] >> U(j)) & U((1 << WIDTH) - 1)).astype(np.int64) for w in range(x.shape[1]) for j in range(0, BITS, WIDTH)])


class Tables:
    """One table a segment: the codes in order of the segment's value, and where each value begins."""

    def __init__(self, codes: np.ndarray, first_id: np.ndarray, n_ids: np.ndarray):
        self.codes, self.first_id, self.n_ids = codes, first_id, n_ids
        parts = _segments(codes)
        self.order = [np.argsort(p, kind="stable") for p in parts]
        self.begin = [np.searchsorted(p[o], np.arange((1 << WIDTH) + 1)) for p, o in zip(parts, self.order)]

    def probed(self, queries: np.ndarray, parts: np.ndarray, s: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) first met in round s at segment j."""
        at = parts[j][:, None] ^ MASKS[s][None, :]
        low = self.begin[j][at]
        count = (self.begin[j][at + 1] - low).ravel()
        full = np.flatnonzero(count)
        low, count = low.ravel()[full], count[full]
        query = np.repeat(full // at.shape[1], count)
        code = self.order[j][np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        apart = self.codes[code] ^ queries[query]
        new = np.ones(len(apart), bool)
        for i, part in enumerate(_segments(apart)):
            if i != j:
                bits = np.bitwise_count(part)
                new &= bits > s if i < j else bits >= s
        return query[new], code[new], np.bitwise_count(apart[new]).sum(axis=1, dtype=np.int64)

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance): the k + 1 nearest codes of each, smaller ids first among equals."""
        active, out = np.arange(len(queries)), []
        held = [np.zeros(0, np.int64)] * 3
        for s in range(WIDTH + 1):
            own = queries[active]
            parts = _segments(own)
            met = [self.probed(own, parts, s, j) for j in range(len(parts))]
            query, code, distance = (np.concatenate([h, *m]) for h, m in zip(held, zip(*((active[q], c, d) for q, c, d in met))))
            order = np.lexsort((self.first_id[code], distance, query))
            query, code, distance = query[order], code[order], distance[order]
            starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
            place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
            keep = place <= k
            query, code, distance = query[keep], code[keep], distance[keep]
            covered = distance <= len(parts) * (s + 1) - 1
            rows = np.bincount(query[covered], self.n_ids[code[covered]], minlength=len(queries))
            done = rows[active] > k if s < WIDTH else np.ones(len(active), bool)
            ready = np.isin(query, active[done])
            out.append((query[ready], code[ready], distance[ready]))
            held, active = [query[~ready], code[~ready], distance[~ready]], active[~done]
            if not len(active):
                break
        return tuple(np.concatenate(c) for c in zip(*out))


def search(base: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, neighbor_id, distance, rank); base and queries are (id, code)."""
    spark = base.sparkSession
    least = Window.partitionBy("code").orderBy("id")
    kept = base.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    index = stored(kept.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "index")
    number = max(8, -(-index.count() // TABLE_CODES))
    dealt = index.select("code", F.col("ids")[0].alias("first_id"), F.size("ids").cast("long").alias("n_ids")).repartition(number, "code")
    blocks = max(1, -(-queries.count() // query_block))
    parts = []
    for n in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n) if blocks > 1 else queries
        asked = own.select("id", "code").orderBy("id").toArrow()
        if not asked.num_rows:
            continue
        shared = spark.sparkContext.broadcast((asked.column("id").to_numpy(), _numbers(asked.column("code"))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            first_id, n_ids = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in (1, 2))
            tables = Tables(np.concatenate([_numbers(b.column(0)) for b in got]), first_id, n_ids)
            ids, wanted = shared.value
            for i in range(0, len(ids), _TOGETHER):
                query, found, distance = tables.nearest(wanted[i : i + _TOGETHER], k)
                yield pa.RecordBatch.from_pydict({"query_id": ids[i : i + _TOGETHER][query], "first_id": first_id[found], "distance": distance})

        parts.append(dealt.mapInArrow(run, "query_id long, first_id long, distance long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, neighbor_id long, distance long, rank long")
    nearest = Window.partitionBy("query_id").orderBy("distance", "first_id")
    best = reduce(DataFrame.unionByName, parts).withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
    rows = best.join(index.select(F.col("ids")[0].alias("first_id"), "ids"), "first_id").select("query_id", F.explode("ids").alias("neighbor_id"), "distance").where("query_id <> neighbor_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "neighbor_id", "distance", "rank")


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100) -> DataFrame:
    """The k nearest rows, by sign codes, of every row whose id is divisible by `every`."""
    base = stored(codes(rows, id_col, vector_col), "codes")
    return search(base, base.where(F.col("id") % every == 0), k)
