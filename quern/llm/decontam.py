"""Benchmark decontamination by greedy string tiling.

Tokens are lower-case runs of letters and digits.  A document and a benchmark
item that share a seed (`least` tokens in a row, found by Karp-Rabin rolling
hashes) are tiled: the longest common run of unmarked tokens of `least` or more
is marked again and again until none is left.  The share of the item's tokens
that tiles cover is its coverage, whatever the order of the tiles in the
document; documents at or above the threshold are contaminated.

Repetitive texts share seeds at very many pairs of places.  Where a document's pairs
are more than a bound, its runs are enumerated by their first seeds alone, those whose
tokens before differ, with lengths by prefix hashes; of more than a bounded number the
best are marked, and what the marks leave is enumerated again.

The benchmark is the stated query set: it is taken in blocks of bounded size, one
after the other, each of which goes to every task; documents stay where they are.

Defined results: null and empty texts and items have no tokens and match nothing;
items of fewer than `least` tokens match nothing; repeated document rows each
give their matches, equal items each match; an empty benchmark matches nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bytewords as bw
from quern.llm.common import lowered, only, slices

#: Benchmark text that goes to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Pairs of places, or runs, that a task holds at once.
PAIRS = 1 << 20


@dataclass
class Items:
    ids: list
    tokens: list[np.ndarray]  # token hashes of each item
    seeds: np.ndarray  # distinct seed hashes, ascending
    begin: np.ndarray  # first place of each seed in where; one more at the end
    where: np.ndarray  # (item, position)
    coarse: np.ndarray  # which leading bits any seed has
    shift: np.uint64


def hashed(column: pa.Array) -> tuple[bw.Words, np.ndarray]:
    words = bw.split(lowered(column), bw.NOT_ALNUM)
    return words, bw.span_hash(words.data, words.start, words.end)


def index_of(ids: list, column: pa.Array, least: int) -> Items:
    words, hashes = hashed(column)
    at = np.flatnonzero(bw.within(words.first, least))
    seeds, inverse = np.unique(bw.rolling(hashes, least)[at], return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    begin = np.searchsorted(inverse[order], np.arange(len(seeds) + 1))
    where = np.stack([words.doc[at], words.place[at]], axis=1)[order] if len(at) else np.zeros((0, 2), np.int64)
    bits = int(len(seeds)).bit_length() + 6
    shift = np.uint64(64 - bits)
    coarse = np.zeros(1 << bits, bool)
    coarse[seeds >> shift] = True
    return Items(ids, [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:])], seeds, begin, where, coarse, shift)


def tiles(doc_at: np.ndarray, item_at: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, document position, item position) of the greedy tiles, from all shared seeds.

    Seeds on one diagonal with adjoining positions are one maximal run.  The
    longest run is marked first; among equals the one that begins earlier in the
    item, then in the document.  What marks leave of a run is a run again.
    """
    order = np.lexsort((item_at, doc_at - item_at))
    d, q = doc_at[order], item_at[order]
    new = np.append(True, (np.diff(d - q) != 0) | (np.diff(q) != 1))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(d))) + least - 1
    heap = [(-n, b, a) for n, a, b in zip(sizes.tolist(), d[starts].tolist(), q[starts].tolist())]
    heapq.heapify(heap)
    used_d, used_q, out = set(), set(), []
    while heap:
        n, b, a = heapq.heappop(heap)
        free = [k for k in range(-n) if a + k not in used_d and b + k not in used_q]
        if len(free) == -n:
            out.append((-n, a, b))
            used_d.update(range(a, a - n))
            used_q.update(range(b, b - n))
            continue
        k = 0
        while k < len(free):
            e = k
            while e + 1 < len(free) and free[e + 1] == free[e] + 1:
                e += 1
            if e - k + 1 >= least:
                heapq.heappush(heap, (-(e - k + 1), b + free[k], a + free[k]))
            k = e + 1
    return out


class Lengths:
    """How far a document and an item agree from given places, up to the next marked token."""

    def __init__(self, doc: np.ndarray, item: np.ndarray):
        base = bw._BASES[2]
        self.sums = [bw._sums(x, base) for x in (doc, item)]
        self.back = [bw._power(base, len(x) + 1, True) for x in (doc, item)]

    def _hash(self, which: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        sums = self.sums[which]
        return (sums[at + size] - sums[at]) * self.back[which][at]

    def __call__(self, d: np.ndarray, q: np.ndarray, most: np.ndarray, least: int) -> np.ndarray:
        low, high = np.full(len(d), least), most.copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            same = self._hash(0, d, mid) == self._hash(1, q, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.minimum(high, mid - 1))
        return low


def _free(used: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where `least` unmarked tokens begin, and how many unmarked ones follow from each place."""
    marked = np.flatnonzero(np.append(used, True))
    left = marked[np.searchsorted(marked, np.arange(len(used)))] - np.arange(len(used))
    return np.flatnonzero(left >= least), left


def _best_runs(doc: np.ndarray, item: np.ndarray, used_d: np.ndarray, used_q: np.ndarray, least: int, most: int, lengths: Lengths) -> tuple[np.ndarray, bool]:
    """The best `most` runs of unmarked tokens as rows (-length, item place, document place), ascending; and whether these are all."""
    (at_d, left_d), (at_q, left_q) = _free(used_d, least), _free(used_q, least)
    seed_d, seed_q = bw.rolling(doc, least)[at_d], bw.rolling(item, least)[at_q]
    # the token before, where there is an unmarked one
    first_d, first_q = (at_d == 0) | used_d[at_d - 1], (at_q == 0) | used_q[at_q - 1]
    before_d, before_q = doc[at_d - 1], np.where(first_q, np.uint64(0), item[at_q - 1])
    order = np.lexsort((at_q, before_q, first_q, seed_q))
    keys = np.zeros(len(order), [("seed", "u8"), ("first", "?"), ("before", "u8")])
    keys["seed"], keys["first"], keys["before"], at_q = seed_q[order], first_q[order], before_q[order], at_q[order]
    low, high = np.searchsorted(keys["seed"], seed_d, "left"), np.searchsorted(keys["seed"], seed_d, "right")
    some = high > low
    at_d, low, high, first_d = at_d[some], low[some], high[some], first_d[some]
    own = np.zeros(len(at_d), keys.dtype)
    own["seed"], own["before"] = seed_d[some], before_d[some]
    kinds, inverse = np.unique(own, return_inverse=True)
    same = np.searchsorted(keys, kinds, "left")[inverse], np.searchsorted(keys, kinds, "right")[inverse]
    same_low, same_high = np.where(first_d, low, same[0]), np.where(first_d, low, same[1])
    count = (same_low - low) + (high - same_high)
    total, held, whole, begin = np.cumsum(count), np.zeros((0, 3), np.int64), True, 0
    while begin < len(at_d):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + most, "right")))
        c, part = count[begin:end], slice(begin, end)
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        skip = np.repeat(same_low[part] - low[part], c)
        q = at_q[np.repeat(low[part], c) + k + np.where(k >= skip, np.repeat(same_high[part] - same_low[part], c), 0)]
        d = np.repeat(at_d[part], c)
        n = lengths(d, q, np.minimum(left_d[d], left_q[q]), least)
        held = np.concatenate([held, np.stack([-n, q, d], axis=1)])
        held = held[np.lexsort((held[:, 2], held[:, 1], held[:, 0]))]
        whole, held, begin = whole and len(held) <= most, held[:most], end
    return held, whole


def bounded_tiles(doc: np.ndarray, item: np.ndarray, least: int, most: int = PAIRS) -> list[tuple[int, int, int]]:
    """The same as tiles(), from the tokens' hashes, holding a bounded number of runs."""
    used_d, used_q, lengths, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), Lengths(doc, item), []
    while True:
        runs, whole = _best_runs(doc, item, used_d, used_q, least, most, lengths)
        if not len(runs):
            return out
        last, pieces, at = tuple(runs[-1].tolist()), [], 0
        while at < len(runs) or pieces:
            if at % 1024 == 0 and not len(_free(used_q, least)[0]):
                return out
            if at < len(runs) and (not pieces or tuple(runs[at].tolist()) <= pieces[0]):
                n, b, a = runs[at].tolist()
                at += 1
            else:
                n, b, a = heapq.heappop(pieces)
            free = ~(used_d[a : a - n] | used_q[b : b - n])
            if free.all():
                out.append((-n, a, b))
                used_d[a : a - n] = used_q[b : b - n] = True
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
                piece = (i - j, b + i, a + i)
                if j - i >= least and (whole or piece <= last):
                    heapq.heappush(pieces, piece)
        if whole:
            return out


def matches(items: Items, column: pa.Array, least: int, threshold: float, most: int = PAIRS) -> list[tuple[int, int, float, int, int]]:
    """(row, item, coverage, tiles, tokens covered) at or above the threshold."""
    if not len(items.seeds):
        return []
    words, hashes = hashed(column)
    runs = bw.rolling(hashes, least)
    at = np.flatnonzero(items.coarse[runs >> items.shift] & bw.within(words.first, least))
    seed = np.minimum(np.searchsorted(items.seeds, runs[at]), len(items.seeds) - 1)
    hit = items.seeds[seed] == runs[at]
    at, seed = at[hit], seed[hit]
    if not len(at):
        return []
    count, doc = items.begin[seed + 1] - items.begin[seed], words.doc[at]
    found = []

    def judge(row: int, i: int, own: list[tuple[int, int, int]]) -> None:
        covered = sum(t[0] for t in own)
        if covered >= threshold * len(items.tokens[i]):
            found.append((row, i, covered / len(items.tokens[i]), len(own), covered))

    begins = np.flatnonzero(np.append(True, np.diff(doc) != 0))
    until = np.cumsum(np.add.reduceat(count, begins))
    begins = np.append(begins, len(doc))
    k = 0
    while k < len(until):
        before = until[k - 1] if k else 0
        if until[k] - before > most:
            row, part = int(doc[begins[k]]), np.unique(seed[begins[k] : begins[k + 1]])
            tokens = hashes[words.first[row] : words.first[row + 1]]
            for i in np.unique(np.concatenate([np.unique(items.where[items.begin[x] : items.begin[x + 1], 0]) for x in part])).tolist():
                judge(row, i, bounded_tiles(tokens, items.tokens[i], least, most))
            k += 1
            continue
        end = k + int(np.searchsorted(until[k:], before + most, "right"))
        some = slice(begins[k], begins[end])
        c, s = count[some], seed[some]
        pick = np.repeat(items.begin[s], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        item, item_at = items.where[pick].T
        row, place = np.repeat(doc[some], c), np.repeat(words.place[at[some]], c)
        pair = row.astype(np.int64) * len(items.ids) + item
        order = np.argsort(pair, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(pair[order]) != 0))
        for group in np.split(order, starts[1:]):
            judge(int(row[group[0]]), int(item[group[0]]), tiles(place[group].astype(np.int64), item_at[group].astype(np.int64), least))
        k = end
    return found


def blocks(benchmark: DataFrame, id_col: str, text_col: str, least: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark's index in blocks; an item lies in one block by a hash of its text."""
    own = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // (block_bytes // 2)) if size > block_bytes else 1
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("text", "id"), F.lit(n)) == k).orderBy("id", "text").toArrow()
        if rows.num_rows:
            yield index_of(rows.column("id").to_pylist(), rows.column("text").combine_chunks(), least)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", least: int = 5, threshold: float = 0.5, **how) -> DataFrame:
    """(id, item, coverage, n_tiles, covered_tokens, item_tokens) of contaminated documents."""
    own = only(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key, item_key = (df.schema[c].dataType.simpleString() for df, c in ((docs, id_col), (benchmark, item_id_col)))
    schema = f"id {key}, item {item_key}, coverage double, n_tiles long, covered_tokens long, item_tokens long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, item_id_col, item_text_col, least, **how):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                items = shared.value
                if found := matches(items, batch.column(1), least, threshold):
                    row, item, coverage, n, covered = zip(*found)
                    size = [len(items.tokens[i]) for i in item]
                    names = [items.ids[i] for i in item]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(names), pa.array(coverage, pa.float64()), pa.array(n, pa.int64()), pa.array(covered, pa.int64()), pa.array(size, pa.int64())], ["id", "item", "coverage", "n_tiles", "covered_tokens", "item_tokens"])

        out = out.unionByName(own.mapInArrow(run, schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_id_col})


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", least: int = 5, threshold: float = 0.5, **how) -> DataFrame:
    """The rows of docs that match no item; all columns, in place."""
    for items in blocks(benchmark, item_id_col, item_text_col, least, **how):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_col):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in matches(shared.value, batch.column(batch.schema.get_field_index(text_col)), least, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
