"""Near copies by SimHash, decided by the Jaccard similarity of word shingles, one of each class kept.

Texts with equal shingle sets are joined first.  The others get a SimHash of 512
bits over their distinct shingles, embedded by segment bit counts as in simhash.
Cells of a grid over these coordinates name the candidates, in two steps.  Whole
codes are dealt by cells of few segments, so many draws of them that a pair at
the least similarity is left without a common cell with probability 1e-9, by its
expected distance; their number stays the same up to some ten million texts.
Inside such a cell its members meet in finer cells of further segments, which move
no rows.  There the Hamming distance of the first 128 bits tests each pair, then
that of all bits, and the exact similarity decides.  A pair that meets in several
tables is told by the first alone.

By that formula, finer cells and the spread of the distance included, a pair of
similarity 0.8 is lost with probability 1e-7 for 200,000 texts, and the 128 bits
lose 2e-7 more (less for closer pairs); texts of eight and nine words, four
shingles against five, differ in more bits and are lost at 1e-4.

A class of many near members in a cell is spanned by links instead of all pairs.
Such crowds, joined over all cells, whose members the exact links don't join into
one class meet by the rarest of their shingles, a filter that loses no pair.

Texts are stored once, in buckets of neighbouring rows.  Marks of the rows that
are asked for come to them, a bit each, so joins move no texts.

Shingles count as equal if their 64-bit XXH64 is.  Defined results: null and
empty texts have the empty set and are one class; a text of fewer words than a
shingle is one shingle.  Of a class the row with the smallest id stays, null
ids last; rows that share it are told apart by text, then by place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.bytewords import mixed
from quern.llm.common import only, shared_folder, slices, stored
from quern.llm.components import components
from quern.llm.simhash import embedded

U = np.uint64
#: Words of 64 bits in a code, and how many of them cells test a pair by; the most bits these and whole codes may differ in.
WORDS, TESTED, RADIUS, WHOLE_RADIUS = 8, 2, 42, 132
#: Texts that share a cell by chance, on average; how many times as many share one that rows are dealt by; those that share a finer one.
_CROWD, _WIDE, _FINE = 600, 1000, 12
#: A pair that shares a cell shares none of its finer ones with this probability, by its expected distance.
_FINE_MISS = 0.02
#: Cells of so many members are compared as they are.
_SMALL = 128
#: A class of more pairs a member is dense; in a cell of more members, all of them count as near to some other.
_DENSE, _GIANT = 8, 8192
_MANY = 4096
_ROWS_A_TASK = 250_000
_PAIRS_AT_ONCE = 1 << 19
_BUCKET = np.uint64(511)
#: Shingles before its own that a row of the prefix filter knows.
_BEFORE = 16
#: Rows of one number of a chunk, as a power of two.
_CHUNK_BITS = 13
_ROW, _CHUNK = "quern_row", "quern_chunk"
_draw = np.random.default_rng(42)
_SEEDS = _draw.integers(0, 2**64, WORDS, np.uint64)


def shingles(text: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending; words as in simhash.fingerprint."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    at = list(accumulate((len(w) + 1 for w in words), initial=0))
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], seed) for a, b in zip(at, at[width:])], np.uint64))


def code(own: np.ndarray) -> np.ndarray:
    """SimHash of a shingle set: majority bits, none of the empty set."""
    if not len(own):
        return own
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(own), _MANY):
        bits = np.unpackbits(mixed(own[i : i + _MANY, None] ^ _SEEDS).view(np.uint8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(own)).view(np.uint64)


def grid(number: int, least: float, miss: float = 1e-9) -> np.ndarray:
    """The segments drawn for each table, a row of their numbers each.

    A bit of two sets of that similarity differs with probability `flip`, a segment
    of two bits has equal bit counts in both with probability `same`, and by chance
    with 3/8.
    """
    flip = acos(2 * least / (1 + least)) / pi
    same = (1 - flip) ** 2 + flip**2 / 2
    drawn = max(3, ceil(log(max(number, 1) / _CROWD) / log(8 / 3)))
    tables = ceil(log(miss) / log(1 - same**drawn))
    draw = np.random.default_rng(7)
    return np.array([draw.choice(32 * WORDS, drawn, replace=False) for _ in range(tables)])


def finer(number: int, least: float, coarse: np.ndarray) -> np.ndarray:
    """The segments drawn for the finer cells of each table of grid: tables, cells, segments."""
    flip = acos(2 * least / (1 + least)) / pi
    same = (1 - flip) ** 2 + flip**2 / 2
    drawn = max(1, ceil(log(max(number, 1) / _FINE) / log(8 / 3)) - coarse.shape[1])
    cells = ceil(log(_FINE_MISS) / log(1 - same**drawn))
    draw = np.random.default_rng(11)
    return np.array([[draw.choice(others, drawn, replace=False) for _ in range(cells)] for others in (np.setdiff1d(np.arange(32 * WORDS), own) for own in coarse)])


def _within(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether the codes (rows of words) differ in few bits: a row for each of some, a column for each of others."""
    apart = np.bitwise_count(some[:, 0, None] ^ others[:, 0])
    for k in range(1, TESTED):
        apart += np.bitwise_count(some[:, k, None] ^ others[:, k])
    near = apart <= RADIUS
    if some.shape[1] > TESTED:
        u, v = np.nonzero(near)
        for i in range(0, len(u), _PAIRS_AT_ONCE):
            a, b = u[i : i + _PAIRS_AT_ONCE], v[i : i + _PAIRS_AT_ONCE]
            near[a, b] = _whole(some[a], others[b])
    return near


def _whole(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether whole codes differ in few bits, row by row."""
    return np.bitwise_count(some ^ others).sum(axis=1, dtype=np.int64) <= WHOLE_RADIUS


def _spread(seed: np.ndarray, left: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (u, v) that span all that near codes join to the seed, and which are left without it."""
    us, vs, front = [], [], seed
    while len(front) and len(left):
        reached, step = [], max(1, (1 << 20) // len(left))
        for i in range(0, len(front), step):
            at = _within(codes[front[i : i + step]], codes[left])
            hit = at.any(axis=0)
            us.append(front[i : i + step][at.argmax(axis=0)[hit]])
            reached.append(left[hit])
            left = left[~hit]
            if not len(left):
                break
        front = np.concatenate(reached)
        vs.append(front)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs]), left


def near_in(codes: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each class that near codes join its near pairs or, if it is dense, links that span it; and the members of dense ones.

    The first index of a class stands first in its links.
    """
    n, pairs, members, seeds = len(codes), [], [np.zeros(0, np.int64)], 0
    left = np.arange(n)
    while len(left) > 1 and (n <= _GIANT or seeds < 64):
        some = min(64, len(left))
        at = _within(codes[left[:some]], codes[left])
        lone = np.count_nonzero(at, axis=1) == 1
        seeds += 1
        if lone.all():
            left = left[some:]
            continue
        left = left[np.append(~lone, np.ones(len(left) - some, bool))]
        seed = left[:1]
        u, v, left = _spread(seed, left[1:], codes)
        if n <= _GIANT and len(v) <= 2 * _DENSE:
            own = np.sort(np.append(seed, v))
            a, b = np.nonzero(np.triu(_within(codes[own], codes[own]), 1))
            u, v = own[a], own[b]
        else:
            members.append(np.append(seed, v))
        pairs.append((u, v))
    return pairs, np.arange(n) if n > _GIANT else np.sort(np.concatenate(members))


def _pairs_in(starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, cell) of the near pairs of these cells of neighbouring rows, some cells at a time."""
    ends = np.cumsum(sizes * (sizes - 1) // 2)
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _PAIRS_AT_ONCE, "right")))
        s, n = starts[begin:end], sizes[begin:end]
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # the place of each row in its cell
        later = np.repeat(n, n) - row - 1
        u = np.repeat(np.repeat(s, n) + row, later)
        v = u + 1 + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
        apart = np.bitwise_count(codes[u, 0] ^ codes[v, 0])
        for k in range(1, TESTED):
            apart += np.bitwise_count(codes[u, k] ^ codes[v, k])
        near = np.flatnonzero(apart <= RADIUS)
        near = near[_whole(codes[u[near]], codes[v[near]])]
        u, v = u[near], v[near]
        yield u, v, np.searchsorted(starts, u, "right") - 1
        begin = end


def _near_in_cells(key: np.ndarray, node: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near pairs (u, v) of all cells, rows of one key; links (u, v) that span dense classes; (class, node) of their members."""
    order = np.argsort(key, kind="stable")
    key, node, codes = key[order], node[order], codes[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    small = (sizes > 1) & (sizes <= _SMALL)
    large = list(zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist()))
    starts, sizes = starts[small], sizes[small]
    pairs, spans, dense = ([np.zeros((2, 0), np.int64)] for _ in range(3))
    for u, v, cell in _pairs_in(starts, sizes, codes):
        linked = np.bincount(np.searchsorted(starts, np.unique(np.concatenate([u, v])), "right") - 1, minlength=len(starts))
        crowded = np.bincount(cell, minlength=len(starts)) > _DENSE * linked
        large += zip(starts[crowded].tolist(), sizes[crowded].tolist())
        pairs.append(np.stack([u, v])[:, ~crowded[cell]])
    for s, n in large:
        links, members = near_in(codes[s : s + n])
        first, left = np.zeros(n, np.int64), np.zeros(n, bool)
        left[members] = True
        for u, v in links:
            (spans if left[u[0]] else pairs).append(np.stack([u, v]) + s)
            if n <= _GIANT:
                first[u] = first[v] = u[0]
        dense.append(np.stack([first[members], members]) + s)
    return tuple(node[np.concatenate(x, axis=1)] for x in (pairs, spans, dense))


def _joined(dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these links, ascending, and for each the smallest one that links join it to."""
    nodes, at = np.unique(dense, return_inverse=True)
    (a, b), root = at.reshape(2, -1), np.arange(len(nodes))
    while True:
        least, before = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same found together: of the pairs those that no crowd holds, of the links to a node one, and members by crowd."""
    pairs, spans, dense = (np.concatenate([np.zeros((2, 0), np.int64), *x], axis=1) for x in (zip(*found) if found else ((), (), ())))
    pairs, nodes, spans = np.unique(np.sort(pairs, axis=0), axis=1), np.zeros(0, np.int64), spans[:, np.lexsort((mixed(spans[0].view(np.uint64)), spans[1]))]
    spans = spans[:, np.append(True, spans[1, 1:] != spans[1, :-1])[: spans.shape[1]]]
    if dense.shape[1]:
        nodes, roots = _joined(dense)
        at = np.minimum(np.searchsorted(nodes, pairs), len(nodes) - 1)
        pairs = pairs[:, ~((nodes[at] == pairs).all(axis=0) & (roots[at[0]] == roots[at[1]]))]
        dense = np.stack([roots, nodes])
    return pairs, spans, dense


def _first_here(left: np.ndarray, right: np.ndarray, cells: np.ndarray, coarse: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """Whether pairs of codes have the first finer cell they share, in order of the tables, inside these cells (ascending), or share none."""
    here = np.ones(len(left), bool)
    for i in range(0, len(left), _MANY):
        points, others = embedded(left[i : i + _MANY]), embedded(right[i : i + _MANY])
        apart = points ^ others
        equal = np.stack([apart[:, s // 32] >> U(s % 32 * 2) & U(3) for s in range(32 * WORDS)], axis=1) == 0
        open_ = np.arange(len(apart))
        for k, segments in enumerate(coarse.tolist()):
            met = equal[open_][:, segments].all(axis=1)
            met[met] = equal[open_[met]][:, fine[k]].all(axis=2).any(axis=1)
            found = open_[met]
            here[i + found] = np.isin(_cells_of(points[found], k, segments), cells)
            open_ = open_[~met]
    return here


def _cells_of(points: np.ndarray, table: int, segments: list[int]) -> np.ndarray:
    """The table, then two bits for each bit count."""
    cell = np.full(len(points), table, np.uint64)
    for segment in segments:
        cell = cell << U(2) | points[:, segment // 32] >> U(segment % 32 * 2) & U(3)
    return cell.view(np.int64)


def _near(cell: np.ndarray, node: np.ndarray, codes: np.ndarray, coarse: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u, v) of all cells that no other task tells; and (crowd, node) of the members of dense classes."""
    cells, (nodes, at) = np.unique(cell), np.unique(node, return_index=True)
    own = codes[at]
    order = np.lexsort((mixed(node.view(np.uint64)), cell))  # so that cells choose the same first members
    cell, node, codes = cell[order], node[order], codes[order]
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    sizes = np.diff(np.append(starts, len(cell)))
    number = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= _SMALL, sizes)
    found = [_near_in_cells(number[small], node[small], codes[small])] if small.any() else []
    number, node, codes, cell = (x[~small] for x in (number, node, codes, cell))
    points, tables = embedded(codes), cell.view(np.uint64) >> U(2 * coarse.shape[1])
    begins = np.flatnonzero(np.append(True, tables[1:] != tables[:-1])) if len(cell) else np.zeros(0, np.int64)
    for draw in range(fine.shape[1] if len(cell) else 0):
        key = number.astype(np.uint64)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(cell)]):
            for segment in fine[int(tables[a]), draw].tolist():
                key[a:b] = key[a:b] << U(2) | points[a:b, segment // 32] >> U(segment % 32 * 2) & U(3)
        found.append(_near_in_cells(key, node, codes))
        if draw % 8 == 7:
            found = [_merged(found)]
    pairs, spans, dense = _merged(found)
    ends = np.searchsorted(nodes, pairs)
    pairs = pairs[:, _first_here(own[ends[0]], own[ends[1]], cells, coarse, fine)]
    return np.unique(np.sort(np.concatenate([pairs, spans], axis=1), axis=0), axis=1), dense


def candidates(nodes: DataFrame, least: float) -> DataFrame:
    """(cell, u, v): pairs u, v without a cell, and members u of dense classes without v, the cell being the first node of their crowd there; nodes has (node, code)."""
    number = nodes.count()
    tables = grid(number // _WIDE, least)
    fine = finer(number, least, tables)
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-number * len(tables) // _ROWS_A_TASK))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
            points = embedded(codes)
            own = [batch.column(0), *(pa.array(codes[:, k].view(np.int64)) for k in range(WORDS))]
            for k, segments in enumerate(tables.tolist()):
                yield pa.RecordBatch.from_arrays([pa.array(_cells_of(points, k, segments)), *own], ["cell", "node", *(f"c{k}" for k in range(WORDS))])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            cell, node = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(2))
            codes = np.empty((len(cell), WORDS), np.uint64)
            for k in range(WORDS):
                codes[:, k] = np.concatenate([b.column(2 + k).to_numpy() for b in got]).view(np.uint64)
            got.clear()
            (u, v), (crowd, members) = _near(cell, node, codes, tables, fine)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.array(u), pa.array(v)], ["cell", "u", "v"])
            yield pa.RecordBatch.from_arrays([pa.array(crowd), pa.array(members), pa.nulls(len(members), pa.int64())], ["cell", "u", "v"])

    coded = nodes.where(F.size("code") > 0).select("node", "code")
    return coded.mapInArrow(cells, "cell long, node long" + "".join(f", c{k} long" for k in range(WORDS))).repartition(tasks, "cell").mapInArrow(link, "cell long, u long, v long")


def _lists(rows: list) -> pa.Array:
    """Unsigned numbers as arrays of signed longs."""
    flat = np.concatenate([np.asarray(r, np.uint64) for r in rows])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat.view(np.int64)))


def _sketches(own: DataFrame, width: int) -> DataFrame:
    """(row, digest of the shingle set, its SimHash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(x or b"", width) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, _lists([code(s) for s in sets])], ["row", "digest", "code"])

    return own.mapInArrow(run, "row long, digest binary, code array<long>")


def _sets(own: DataFrame, text_col: str, rows: DataFrame, width: int) -> DataFrame:
    """(node, shingles, parity) of these rows (row): whether each of 512 buckets of shingles holds an odd number, as eight longs."""
    texts = only(_marked(own, rows), _ROW, text_col).toDF("row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingles(x or b"", width) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            odd = [np.packbits(np.bincount((s & _BUCKET).astype(np.int64), minlength=512) & 1).view(np.uint64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets), _lists(odd)], ["node", "shingles", "parity"])

    return texts.mapInArrow(run, "node long, shingles array<long>, parity array<long>")


def _close(least: float) -> Column:
    """Whether sets of n and n2 shingles can be so similar: buckets of different parity are no more than the shingles that only one of the two holds."""
    apart = sum((F.bit_count(F.get("parity", F.lit(k)).bitwiseXOR(F.get("parity2", F.lit(k)))) for k in range(8)), F.lit(0))
    return (F.least("n", "n2") >= least * F.greatest("n", "n2") - 1e-6) & (apart <= (F.col("n") + F.col("n2")) * ((1 - least) / (1 + least)) + 1e-6)


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose similarity is at least so much."""
    left, right = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "uv")
    both = F.size(F.array_intersect("su", "sv"))
    near = both / (F.size("su") + F.size("sv") - both) >= least
    return pairs.join(left, "u").join(right, "v").where(near).select("u", "v")


def _possible(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) that sizes and parities don't rule out, so that few are joined with their sets."""
    size = F.size("shingles")
    left = sets.select(F.col("node").alias("u"), size.alias("n"), "parity")
    right = sets.select(F.col("node").alias("v"), size.alias("n2"), F.col("parity").alias("parity2"))
    return pairs.join(left, "u").join(right, "v").where(_close(least)).select("u", "v")


def similar_links(nodes: DataFrame, own: DataFrame, text_col: str, width: int, least: float) -> DataFrame:
    """(u, v) links that span the classes of the nodes (node, code); own has the nodes' rows, their chunks and texts."""
    found = stored(candidates(nodes, least).distinct(), "candidates")
    pairs = found.where("v IS NOT NULL").select("u", "v")
    met = pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    sets = stored(_sets(own, text_col, met, width), "sets")
    first = stored(_alike(stored(_possible(pairs, sets, least), "possible"), sets, least), "links")
    crowds = stored(components(found.where("v IS NULL").select("u", F.col("cell").alias("v"))), "crowds").select("node", F.col("root").alias("crowd"))
    rest = crowds.join(components(first), "node", "left").select("crowd", "node", F.coalesce("root", "node").alias("root"))
    split = rest.groupBy("crowd").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("crowd")
    rest = stored(rest.join(split, "crowd").select("node", "root"), "split")
    rest = stored(rest.join(_sets(own, text_col, rest.select(F.col("node").alias("row")), width), "node"), "rest")
    return first.unionByName(_alike(_meetings(rest, least).distinct(), rest, least))


def _meetings(rest: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of the nodes (node, root, shingles, parity), of different roots: all whose similarity can be at least so much, some repeated.

    Such a set holds at least that share of the other, so in any one order of
    the shingles the first of each, as many as may be missing and one more, meet.
    The rarest come first.  Nodes of the root that most holders of a shingle have
    meet the others, not each other.  Two that share one of the few shingles
    before have met there.
    """
    held = stored(rest.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "held")
    often = held.groupBy("shingle").agg(F.count("*").alias("df"), F.min("root").alias("a"), F.max("root").alias("b"), F.mode("root").alias("most"))
    own = Window.partitionBy("node").orderBy("df", "shingle")
    first = held.join(often, "shingle").withColumn("place", F.row_number().over(own)).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-6) + 1).where("a <> b")
    before = F.collect_list("shingle").over(own.rowsBetween(-_BEFORE, -1))
    first = first.select("shingle", "node", "root", "n", (F.col("root") == F.col("most")).alias("usual"), before.alias("before"))
    first = stored(first.join(rest.select("node", "parity"), "node"), "first")
    other = first.where("NOT usual").select("shingle", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "n", "parity", "usual", "before")])
    new = (F.col("usual") | (F.col("node") < F.col("node2"))) & (F.col("root") != F.col("root2"))
    met = first.join(other, "shingle").where(new & _close(least) & ~F.arrays_overlap("before", "before2"))
    return met.select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v"))


def _in_chunks(docs: DataFrame) -> DataFrame:
    """docs stored with numbers of its rows and of chunks of neighbouring ones, in buckets by chunk; a task's rows are few chunks, so its files are few."""
    spark, name = docs.sparkSession, f"quern_rows_{uuid.uuid4().hex}"
    row = F.monotonically_increasing_id()
    own = docs.withColumn(_ROW, row).withColumn(_CHUNK, F.shiftright(_ROW, _CHUNK_BITS))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.write.format("parquet").bucketBy(buckets, _CHUNK).option("path", f"{shared_folder(spark)}/quern/{name}").saveAsTable(name)
    stored_rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry alone: the files stay in the shared folder
    return stored_rows


def _marked(own: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of own whose number is in rows (row): bits of the chunks are joined with the chunks where they are."""
    row = F.col("row")
    bits = rows.groupBy(F.shiftright(row, _CHUNK_BITS).alias(_CHUNK), F.shiftright(row, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(row & 63 AS INT))")).alias("bits"))
    marks = bits.groupBy(_CHUNK).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("quern_marks"))
    return own.join(marks.hint("shuffle_hash"), _CHUNK).where(F.expr(f"shiftright(quern_marks[shiftright({_ROW}, 6)], CAST({_ROW} & 63 AS INT)) & 1 = 1")).drop("quern_marks")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each class of rows joined by similarities of at least so much."""
    own = _in_chunks(docs)
    texts = only(own, _ROW, text_col).toDF("row", "text")
    prints = stored(_sketches(texts, width), "prints")
    best = F.struct(F.col("id").isNull().alias("last"), "id", "told", "row")
    ids = only(own, _ROW, id_col, text_col).toDF("row", "id", "text").select("row", "id", F.xxhash64("text").alias("told"))
    same = prints.join(ids, "row").groupBy("digest").agg(F.min(best).alias("best"), F.first("code").alias("code"))
    nodes = stored(same.select(F.col("best.row").alias("node"), "best", "code"), "nodes")
    roots = components(similar_links(nodes.select("node", "code"), own, text_col, width, least))
    rooted = nodes.select("node", "best").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.row")
    return _marked(own, kept).select(*[F.col(f"`{c}`") for c in docs.columns])
