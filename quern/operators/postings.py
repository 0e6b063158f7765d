"""An inverted index as a table, and exact BM25 top-k that skips blocks of rows.

The rows of an input batch are numbered in blocks of about a thousand.  A row of the
index is a term in a block: the ids that hold it, its counts there, their lengths,
and the largest count and least length, from which the largest weight that the term
can have in the block follows for any parameters.  The table is partitioned by the
term's bucket and sorted by term, so a search reads its terms' buckets alone.  No
list grows with the table: a frequent term has one row a block.

A search first adds up the largest weights of each query's terms in each block: no
row of the block can score more.  The most promising blocks are scored, whose k-th
best score every result must reach; of the others only blocks that can reach it are
scored too.  Blocks of any query are scored by matrices in one task each.

Defined results: rows with a null id are no part of the index; a null or empty text
counts as a row without terms; a query without terms, or without any that the index
knows, has no results; a term that a query repeats counts as often; ties go to the
smaller id; an empty table or batch gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.batches import Terms
from quern.operators.ranking import top
from quern.profile import MACEDONIAN, Profile
from quern.tables import new_path, spread, stored

#: Rows of a block, partitions of the index, queries that go to every task at once, and blocks a query that are scored first.
BLOCK_ROWS, BUCKETS, QUERIES, LEAD = 1024, 32, 256, 2
#: The term under which a block lists all its rows, for the statistics; no token is empty.
ALL = ""


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    rows: int
    mean: float
    profile: Profile
    do_stem: bool
    buckets: int


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def _block(ids: pa.Array, lists: list[list[str]], number: int, buckets: int) -> pa.RecordBatch:
    """The index rows of one block."""
    length = np.array([len(x) for x in lists], np.int32)
    names: dict[str, int] = {}
    flat = np.fromiter((names.setdefault(t, len(names)) for t in chain.from_iterable(lists)), np.int64, int(length.sum()))
    cell, count = np.unique(flat * len(lists) + np.repeat(np.arange(len(lists)), length), return_counts=True)
    term, row = np.divmod(cell, max(1, len(lists)))
    begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))]).astype(np.int32)
    # and all rows, whatever they hold
    row, count = np.concatenate([row, np.arange(len(lists))]), np.concatenate([count, np.zeros(len(lists), np.int64)]).astype(np.int32)
    begin = np.append(begin, begin[-1] + len(lists)).astype(np.int32)
    words, held = [*names, ALL], length[row]
    lists_of = lambda values: pa.ListArray.from_arrays(pa.array(begin), values)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(words, pa.string()), pa.array(np.full(len(words), number)), pa.array(np.diff(begin)), lists_of(ids.take(pa.array(row))), lists_of(pa.array(count)), lists_of(pa.array(held)),
            pa.array(np.maximum.reduceat(count, begin[:-1])), pa.array(np.minimum.reduceat(held, begin[:-1])), pa.array(np.add.reduceat(held.astype(np.int64), begin[:-1])),
            pa.array([bucket_of(w, buckets) for w in words], pa.int32()),
        ],
        [f.split()[0] for f in _schema("x").split(", ")],
    )


def _schema(key: str) -> str:
    return f"term string, block long, n int, ids array<{key}>, tf array<int>, lengths array<int>, most_tf int, least_length int, total long, bucket int"


def build(rows: DataFrame, id_col: str, text_col: str, profile: Profile = MACEDONIAN, do_stem: bool = True, path: str | None = None, buckets: int = BUCKETS, block_rows: int = BLOCK_ROWS) -> Index:
    """Writes the index of the rows to path, or to the shared folder."""
    spark = rows.sparkSession
    path = path or new_path(spark, "postings")
    own = spread(rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    terms = Terms(profile, do_stem)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                yield _block(part.column(0), [terms(t) for t in part.column(1).to_pylist()], number, buckets)
                number += 1

    rows_of = own.mapInArrow(run, _schema(own.schema["id"].dataType.simpleString()))
    # a large bucket is dealt over several tasks and files
    rows_of.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(path)
    return opened(spark, path, profile, do_stem, buckets, rows_of.schema)


def opened(spark: SparkSession, path: str, profile: Profile = MACEDONIAN, do_stem: bool = True, buckets: int = BUCKETS, schema=None) -> Index:
    """An index written before; profile, stemming and buckets are those it was built with."""
    postings = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    n, total = postings.where((F.col("bucket") == bucket_of(ALL, buckets)) & (F.col("term") == ALL)).agg(F.sum("n"), F.sum("total")).first()
    return Index(postings, n or 0, (total or 0) / n if n else 0.0, profile, do_stem, buckets)


def _asked(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, terms) of queries with terms."""
    terms, kind = Terms(index.profile, index.do_stem), queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [terms(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], ["query_id", "terms"])

    return queries.select("query_id", "query").mapInArrow(run, f"query_id {kind}, terms array<string>").where(F.size("terms") > 0)


def search(index: Index, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, digits: int | None = None, at_once: int = QUERIES) -> DataFrame:
    """(query_id, id, score, rank) for a batch (query_id, query)."""
    spark = queries.sparkSession
    asked = stored(_asked(index, queries), "asked")
    parts, blocks = [], -(-asked.count() // at_once)
    for number in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number) if blocks > 1 else asked
        table = part.orderBy("query_id").toArrow()  # about at_once queries
        if table.num_rows and index.rows:
            parts.append(_searched(index, table, k, k1, b, digits))
    if not parts:
        kinds = queries.schema["query_id"].dataType.simpleString(), index.postings.schema["ids"].dataType.elementType.simpleString()
        return spark.createDataFrame([], "query_id {}, id {}, score double, rank int".format(*kinds))
    return top(reduce(DataFrame.unionByName, parts), k, digits=digits)


def _searched(index: Index, table: pa.Table, k: int, k1: float, b: float, digits: int | None) -> DataFrame:
    spark = index.postings.sparkSession
    ids, lists = table.column("query_id").combine_chunks(), table.column("terms").combine_chunks()
    wanted = pc.unique(lists.flatten())
    times = np.zeros((len(wanted), len(ids)))
    np.add.at(times, (pc.index_in(lists.flatten(), value_set=wanted).to_numpy(), np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))), 1)
    words = wanted.to_pylist()
    numbered = F.broadcast(spark.createDataFrame(pa.table({"term": wanted, "number": pa.array(np.arange(len(words), dtype=np.int32))})))
    own = index.postings.where(F.col("bucket").isin(sorted({bucket_of(w, index.buckets) for w in words}))).join(numbered, "term")
    df = np.zeros(len(words))
    for r in own.groupBy("number").agg(F.sum("n").alias("df")).collect():  # the terms of about QUERIES queries
        df[r["number"]] = r["df"]
    idf = np.log(1 + (index.rows - df + 0.5) / (df + 0.5))

    number, query = np.nonzero(times)
    factor = times[number, query] * idf[number]
    pairs = F.broadcast(spark.createDataFrame(pa.table({"number": pa.array(number.astype(np.int32)), "q": pa.array(query.astype(np.int32)), "factor": pa.array(factor)})))
    most = F.col("most_tf") * (k1 + 1) / (F.col("most_tf") + k1 * (1 - b + b * F.col("least_length") / index.mean))
    bounds = stored(own.select("block", "number", most.alias("most")).join(pairs, "number").groupBy("q", "block").agg(F.sum(F.col("factor") * F.col("most")).alias("score")), "bounds")
    shared = spark.sparkContext.broadcast((ids, times, idf))
    mean = index.mean
    kinds = index.postings.schema["ids"].dataType.elementType.simpleString()

    def score(key: tuple, held: pa.Table, chosen: pa.Table) -> pa.Table:
        ids, times, idf = shared.value
        queries = chosen.column("q").to_numpy()
        number, tf = held.column("number").to_numpy(), held.column("tf").combine_chunks()
        size = np.diff(tf.offsets.to_numpy())
        tf, length = tf.flatten().to_numpy(), held.column("lengths").combine_chunks().flatten().to_numpy()
        docs = held.column("ids").combine_chunks().flatten().dictionary_encode()
        terms, place = np.unique(np.repeat(number, size), return_inverse=True)
        weight = np.zeros((len(docs.dictionary), len(terms)))
        weight[docs.indices.to_numpy(), place] = idf[terms[place]] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        found = weight @ times[np.ix_(terms, queries)]
        if digits is not None:
            found = np.round(found, digits)
        if len(found) > k:
            found[found < np.partition(found, len(found) - k, axis=0)[len(found) - k]] = 0
        d, q = np.nonzero(found)
        return pa.table({"q": pa.array(queries[q].astype(np.int32)), "query_id": ids.take(pa.array(queries[q])), "id": docs.dictionary.take(pa.array(d)), "score": pa.array(found[d, q])})

    def scored(chosen: DataFrame) -> DataFrame:
        held = own.select("block", "number", "ids", "tf", "lengths").join(chosen.select("block").distinct(), "block", "left_semi")
        kind = spark_kind(table.schema.field("query_id").type)
        return held.groupBy("block").cogroup(chosen.select("block", "q").groupBy("block")).applyInArrow(score, f"q int, query_id {kind}, id {kinds}, score double")

    lead = top(bounds, max(LEAD, -(-2 * k // BLOCK_ROWS)), by=("q",), id_col="block")
    first = stored(scored(lead), "first")
    reached = top(first, k, by=("q",)).where(F.col("rank") == k).select("q", F.col("score").alias("least"))
    slack = 10.0**-digits if digits is not None else 1e-9
    others = bounds.join(lead.select("q", "block"), ["q", "block"], "left_anti").join(F.broadcast(reached), "q", "left")  # a row a query
    able = stored(others.where(F.col("least").isNull() | (F.col("score") + slack >= F.col("least"))).select("q", "block"), "able")
    return first.unionByName(scored(able)).select("query_id", "id", "score")


def spark_kind(kind: pa.DataType) -> str:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind).simpleString()
