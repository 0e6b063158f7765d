"""SimHash near-duplicates by an embedding of segment bit counts.

A fingerprint's 32 segments of two bits are mapped to their bit counts.  The
Manhattan distance of two such vectors is at most the Hamming distance of the
fingerprints, so it bounds it from below.  Within distance r, of r + t bands of
segments at least t are equal: these bands are the coordinates of grid cells, and
fingerprints meet in the cells of all choices of t bands.  t is three or more, so
many that a cell holds few of the distinct fingerprints however many there are.
In a cell the Manhattan bound is tested first and the Hamming distance verifies
exactly.

Copies are joined before: only distinct fingerprints enter the grid.  A cell
emits a spanning forest of its links, never all pairs, since only classes are
asked for.  In a crowded cell the fingerprints within r / 2 of the bitwise
majority link to each other without being compared.

Defined results: null and empty texts have fingerprint zero, linked like any
other; repeated rows share a class; a class whose ids are all null has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bytewords import mixed
from quern.llm.common import only, slices, stored
from quern.llm.components import components

U = np.uint64
_EVEN = U(0x5555555555555555)
_CROWD = 24
_MANY = 50_000


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64 majority bits over XXH64 of the word shingles, repeats included."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII separators
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    at = list(accumulate((len(w) + 1 for w in words), initial=0))
    n, digest = len(words) - width + 1, xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _MANY):
        hashes = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(at[i : min(n, i + _MANY)], at[i + width :])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): fingerprints as signed longs."""
    own = only(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(x or b"", width) for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, fp long")


def embedded(fps: np.ndarray) -> np.ndarray:
    """Bit counts 0, 1, 2 of 32 segments, each as 00, 01, 11: their xor's bits count the Manhattan distance."""
    low, high = fps & _EVEN, (fps >> U(1)) & _EVEN
    return (low | high) | ((low & high) << U(1))


def bands_equal(distinct: int, radius: int, most: int = 8, crowd: float = 4.0) -> int:
    """How many of radius + t bands must be equal: the fewest that leave cells of at most `crowd` on average.

    The bit count of a segment holds 1.5 bits.
    """
    for t in range(3, most):
        if distinct <= crowd * 2 ** (1.5 * 32 * t / (radius + t)):
            return t
    return most


def band_masks(radius: int, t: int = 3) -> list[np.uint64]:
    """Masks of t bands at a time, of radius + t."""
    bands = [U(sum(3 << (2 * k) for k in part.tolist())) for part in np.array_split(np.arange(32), radius + t)]
    return [U(sum(map(int, some))) for some in combinations(bands, t)]


def links_in(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints of a crowded cell, as index pairs."""
    n = len(fps)
    label, links = np.arange(n), []
    bits = ((fps[:, None] >> np.arange(64, dtype=np.uint64)) & U(1)).sum(axis=0) if n < 4096 else np.array([int(((fps >> U(k)) & U(1)).sum()) for k in range(64)])
    middle = U(sum(1 << k for k in range(64) if 2 * int(bits[k]) > n))
    near = np.flatnonzero(np.bitwise_count(fps ^ middle) <= radius // 2)
    if len(near) > 1:
        links += [(int(near[0]), int(k)) for k in near[1:]]
        label[near] = near[0]
    rest = np.setdiff1d(np.arange(n), near, assume_unique=True) if len(near) > 1 else np.arange(n)
    points = embedded(fps)
    for i in rest.tolist():
        close = np.flatnonzero(np.bitwise_count(points ^ points[i]) <= radius)
        close = close[np.bitwise_count(fps[close] ^ fps[i]) <= radius]
        groups = np.unique(label[close])
        if len(groups) > 1:
            links += [(int(groups[0]), int(g)) for g in groups[1:]]
            label[np.isin(label, groups[1:])] = groups[0]
    return links


def _links(cell: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((fps, cell))
    cell, fps = cell[order], fps[order]
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    sizes = np.diff(np.append(starts, len(cell)))
    size_at = np.repeat(sizes, sizes)
    points = embedded(fps)
    left, right = [], []
    small = size_at <= _CROWD
    for lag in range(1, int(sizes[sizes <= _CROWD].max(initial=1))):
        i = np.flatnonzero(small[:-lag] & (cell[:-lag] == cell[lag:]))
        i = i[np.bitwise_count(points[i] ^ points[i + lag]) <= radius]
        i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= radius]
        left.append(fps[i])
        right.append(fps[i + lag])
    for s, k in zip(starts[sizes > _CROWD].tolist(), sizes[sizes > _CROWD].tolist()):
        own = fps[s : s + k]
        if found := links_in(own, radius):
            a, b = np.array(found).T
            left.append(own[a])
            right.append(own[b])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def near_links(distinct: DataFrame, radius: int = 4, rows_a_task: int = 2_000_000) -> DataFrame:
    """(u, v) links that span the classes of the distinct fingerprints fp within the radius."""
    spark = distinct.sparkSession
    number = distinct.count()
    masks = band_masks(radius, bands_equal(number, radius))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-number * len(masks) // rows_a_task))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            points = embedded(fps)
            for k, mask in enumerate(masks):
                yield pa.RecordBatch.from_pydict({"cell": mixed((points & mask) + U(k * 0x9E3779B97F4A7C15 % 2**64)).view(np.int64), "fp": fps.view(np.int64)})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            cell, fps = (np.concatenate([b.column(i).to_numpy() for b in got]).view(np.uint64) for i in (0, 1))
            u, v = _links(cell, fps, radius)
            yield pa.RecordBatch.from_pydict({"u": u.view(np.int64), "v": v.view(np.int64)})

    return distinct.select("fp").mapInArrow(cells, "cell long, fp long").repartition(tasks, "cell").mapInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id of the class.

    Links tie nodes that carry their smallest id, null last, so the smallest node
    of a class tells its component_id, and nothing is gathered by class.
    """
    prints = stored(fingerprints(docs, id_col, text_col, width), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    node = F.struct(F.col("first").isNull().alias("last"), "first", "fp")
    links = near_links(distinct, radius)
    for end in "uv":
        links = links.join(distinct.select(F.col("fp").alias(end), node.alias(f"{end}_node")), end)
    roots = components(links.select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))).select("node.fp", F.col("root.first").alias("component_id"), F.lit(True).alias("linked"))
    own = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first"))
    classes = stored(distinct.join(roots, "fp", "left").select("fp", own.alias("component_id")), "classes")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose id is the smallest of their class; rows without an id stay."""
    classes = near_duplicates(docs, id_col, text_col, **how)
    gone = classes.where(F.col(id_col) != F.col("component_id")).select(id_col)
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
