"""Centroid clustering of integer vectors: a tournament of sign tests, all numbers exact.

Vectors and centroids have integer components.  For each pair of centroids a < b,
the side of their bisector on which x lies is the sign of

    normal[a, b] . x - threshold[a, b],    normal = 2 (b - a),  threshold = |b|^2 - |a|^2

Positive: b is nearer and a is out; zero or negative: b is out, so ties go to the
smaller number.  k - 1 such tests leave the nearest centroid; only its distance is
then computed.  Arithmetic is in the narrowest kind of number that holds the
batch's largest possible value exactly: doubles up to 2^53, longs up to 2^62, else
Python's integers.

A round is one scan: each task sums the vectors of its clusters and sends k rows of
sums, in limbs of 48 bits, so that no sum overflows.  Spark adds them up; the driver
gets k centroids, whatever the number of vectors.  Nothing is kept between rounds
but these, so a lost executor costs its tasks alone.

Defined results: vectors of another length, or with null or non-finite components,
and null vectors are left out; a null id counts as the empty text when the first
centroids are drawn; rows with one id are vectors of their own (the smaller vector
is drawn first); fewer vectors than centroids give as many centroids; an empty
table gives no rows; a distance or a sum beyond a long is given as the largest long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import only

LARGEST = 2**63 - 1
_LIMB = 48
_int = np.frompyfunc(int, 1, 1)
RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def exact(bound: int) -> type:
    """A kind of number in which all integers up to bound are exact."""
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


def as_kind(x: np.ndarray, kind: type) -> np.ndarray:
    """Integers, as doubles or objects, in another kind."""
    if kind is object:
        return _int(x) if x.size else x.astype(object)
    return x.astype(kind, copy=False)


class Tournament:
    """Normals and thresholds of all pairs of centroids (lists of Python integers)."""

    def __init__(self, centroids: list[list[int]]):
        self.k = len(centroids)
        whole = np.empty((self.k, len(centroids[0])), object)
        whole[:] = centroids
        self.centroids = whole
        self.normals = 2 * (whole[None, :, :] - whole[:, None, :])
        squares = (whole * whole).sum(axis=1)
        self.thresholds = squares[None, :] - squares[:, None]
        self.most = [max(abs(v) for v in a.ravel()) for a in (whole, self.normals, self.thresholds)]

    def nearest(self, x: np.ndarray, most: int) -> np.ndarray:
        """Number of the nearest centroid of each row; no component is beyond most."""
        kind = exact(x.shape[1] * most * self.most[1] + self.most[2])
        x, normals, thresholds = as_kind(x, kind), as_kind(self.normals, kind), as_kind(self.thresholds, kind)
        won = np.zeros(len(x), np.int64)
        for c in range(1, self.k):
            side = (x * normals[won, c]).sum(axis=1) - thresholds[won, c]
            won[side > 0] = c
        return won

    def distances(self, x: np.ndarray, won: np.ndarray, most: int) -> np.ndarray:
        kind = exact(x.shape[1] * (most + self.most[0]) ** 2)
        away = as_kind(x, kind) - as_kind(self.centroids, kind)[won]
        return (away * away).sum(axis=1)


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(number, limb) with value = sum of limb << 48 * number; only the last may be negative."""
    i = 0
    while not -(1 << _LIMB - 1) <= value < 1 << _LIMB - 1:
        yield i, value & (1 << _LIMB) - 1
        value, i = value >> _LIMB, i + 1
    yield i, value


def batches_of(batches: Iterator[pa.RecordBatch], dims: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int]]:
    """Each batch with its integer vectors (doubles without fraction) and their largest component."""
    for batch in batches:
        if batch.num_rows:
            x = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            yield batch, x, int(np.abs(x).max())


def sums(kept: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> dict[int, list[int]]:
    """Of each cluster with vectors: the sum of each component, the number of vectors, and the sum of distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament, total = Tournament(centroids), {}
        for _, x, most in batches_of(batches, dims, scale):
            won = tournament.nearest(x, most)
            far = as_kind(tournament.distances(x, won, most), object)
            kind = exact(len(x) * most)
            for c in np.unique(won).tolist():
                own = won == c
                added = [*map(int, as_kind(x[own], kind).sum(axis=0)), int(own.sum()), int(far[own].sum())]
                total[c] = [a + b for a, b in zip(total[c], added)] if c in total else added
        rows = [(c, part, i, limb) for c, values in total.items() for part, v in enumerate(values) for i, limb in limbs(v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["cluster", "part", "number", "limb"])

    parts = kept.mapInArrow(run, "cluster long, part long, number long, limb long")
    added = parts.groupBy("cluster", "part", "number").agg(F.sum(F.col("limb").cast("decimal(38,0)")).alias("limb"))
    out: dict[int, list[int]] = {}
    for r in added.collect():  # k centroids, in limbs
        out.setdefault(r["cluster"], [0] * (dims + 2))[r["part"]] += int(r["limb"]) << _LIMB * r["number"]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", dims: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector: its cluster, squared distance, the sums of distances, and the digest of its centroid."""
    own = only(vectors, id_col, vector_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = own.where((F.size("v") == dims) & finite)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(order, "v").limit(k).collect()
    centroids = [[math.floor(scale * x) for x in r["v"]] for r in first]
    schema = f"id {own.schema['id'].dataType.simpleString()}, {RESULT}"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    for _ in range(rounds):
        found = sums(kept, centroids, dims, scale)
        after = [[s // found[c][dims] for s in found[c][:dims]] if c in found else old for c, old in enumerate(centroids)]
        if after == centroids:  # further rounds change nothing
            break
        centroids = after
    inertia = {c: v[dims + 1] for c, v in sums(kept, centroids, dims, scale).items()}
    whole = min(sum(inertia.values()), LARGEST)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        by_cluster = pa.array([min(inertia.get(c, 0), LARGEST) for c in range(len(centroids))], pa.int64())
        for batch, x, most in batches_of(batches, dims, scale):
            won = tournament.nearest(x, most)
            far = tournament.distances(x, won, most)
            far = np.array([min(d, LARGEST) for d in far], np.int64) if far.dtype == object else far.astype(np.int64)
            number = pa.array(won)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(won.astype(np.int32)), pa.array(far), by_cluster.take(number), pa.array(np.full(len(x), whole, np.int64)), pa.array(digests).take(number)],
                ["id", *(f.split()[0] for f in RESULT.split(", "))],
            )

    return kept.mapInArrow(run, schema).withColumnRenamed("id", id_col)
