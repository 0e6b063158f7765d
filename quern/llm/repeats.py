"""Substring dedup by fixed-block anchors.

A window of n words that occurs twice holds, in either place, a whole block of
n / 2 words that begins at a multiple of n / 2.  These non-overlapping blocks are
the anchors; every rolling run of n / 2 words of every text probes them.  A hit
makes the windows around it candidates, which are matched by 128 bits of hash;
each but the first occurrence is removed.  Windows that follow each other in both
places are joined to maximal exact repeats, and of every such repeat the words in
both places are compared by their SHA-256.  Were two to differ, all is done again
with other hashes, so the result rests on the words.

Words are never sent alone: a task packs the probes of some megabytes of text
into one row for each range of hash values, and where a run repeats within them
it sends one of its places only, since the others are known to be hits.  So a
passage that many documents share costs each task one probe.  Whole copies of a
text are found first, by its SHA-256, and need no windows.

Defined results: documents come in the order of their id, null ids last; rows
that share an id, or have none, are documents of their own, in the order of the
text's hash and then of their place.  A null or empty text has no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bytewords as bw
from quern.llm.common import SLICE_BYTES, only, slices, stored

U = np.uint64
#: Text that a range of hash values stands for, and the fewest ranges.
RANGE_BYTES, FEWEST = 32 << 20, 256
#: Above so many ranges they stand for more text, and tasks pack more of it at once, so that rows stay long.
MANY = 8192
#: Rows that one part of a group of copies holds.
COPIES = 100_000


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of hash values each value is in."""
    return (((hashes >> U(32)) * U(n)) >> U(32)).astype(np.uint32)


def _cut(blob_sizes: np.ndarray) -> Iterator[slice]:
    ends = np.cumsum(blob_sizes)
    for e, n in zip(ends.tolist(), blob_sizes.tolist()):
        yield slice(e - n, e)


def _small(values: np.ndarray) -> bytes:
    """As two bytes each if all fit, else four."""
    return values.astype("<u2" if not len(values) or values.max() < 1 << 16 else "<u4").tobytes()


def _large(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype(np.int64)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and size of each run of equal values."""
    starts = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(sorted_values)))


PROBES = "range int, slice long, ids binary, first binary, known binary, steps binary, keys binary"


def _sizes(total: int) -> tuple[int, int]:
    """How many ranges the hash values are dealt to, and bytes of text that are packed at once."""
    grown = min(8, max(1, total // (RANGE_BYTES * MANY)))
    return max(FEWEST, -(-total // (RANGE_BYTES * grown))), SLICE_BYTES * grown


def _probes(docs: DataFrame, block: int, ranges: int, packed: int, seed: int) -> DataFrame:
    """Packed probes: for each slice of text and range of hashes, the places and 32 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", packed):
            number += 1
            words = bw.split(batch.column(1))
            runs = bw.rolling(bw.span_hash(words.data, words.start, words.end, seed), block, seed + 1)
            at = np.flatnonzero(bw.within(words.first, block))
            if not len(at):
                continue
            value = runs[at]
            aligned = words.place[at] % block == 0
            order = np.argsort(value)
            starts, sizes = _runs(value[order])
            # an aligned place stands for its run, else any
            best = np.maximum.reduceat(np.where(aligned[order], order, -1), starts)
            chosen = np.sort(np.where(best >= 0, best, order[starts]))
            known = np.sort(order[np.repeat(sizes > 1, sizes)])
            part = _ranges(value[chosen], ranges)
            by_range = np.argsort(part.astype(np.uint16) if ranges <= 1 << 16 else part, kind="stable")
            chosen, part = chosen[by_range], part[by_range]
            starts, sizes = _runs(part)
            place = at[chosen]
            step = np.diff(place, prepend=0)
            step[starts] = place[starts]
            step = step * 2 + aligned[chosen]
            key = (value[chosen] & U(0xFFFFFFFF)).astype("<u4")
            cuts = list(_cut(sizes))
            n = len(cuts)
            home = [b""] * (n - 1)
            yield pa.RecordBatch.from_pydict({
                "range": pa.array(part[starts].astype(np.int32)), "slice": pa.array(np.full(n, number)),
                "ids": pa.array([batch.column(0).to_numpy().astype("<i8").tobytes(), *home], pa.binary()),
                "first": pa.array([words.first.astype("<i8").tobytes(), *home], pa.binary()),
                "known": pa.array([at[known].astype("<u4").tobytes(), *home], pa.binary()),
                "steps": pa.array([_small(step[c]) for c in cuts], pa.binary()), "keys": pa.array([key[c].tobytes() for c in cuts], pa.binary()),
            })

    return docs.mapInArrow(run, PROBES)


def _anchored(table: pa.Table) -> pa.Table:
    """Of one range: which probes hit an anchor, as word numbers of their slices."""
    keys = [np.frombuffer(b, "<u4") for b in table.column("keys").to_pylist()]
    steps = [_large(b, len(k)) for b, k in zip(table.column("steps").to_pylist(), keys)]
    aligned = np.concatenate(steps) % 2 == 1
    value = np.concatenate(keys)
    sizes = np.array([len(k) for k in keys])
    hit = np.zeros(len(value), bool)
    blocks = np.unique(value[aligned])
    if len(blocks):
        bits = min(32, int(len(blocks)).bit_length() + 4)
        coarse = np.zeros(1 << bits, bool)
        coarse[blocks >> np.uint32(32 - bits)] = True
        maybe = np.flatnonzero(coarse[value >> np.uint32(32 - bits)])
        where = np.minimum(np.searchsorted(blocks, value[maybe]), len(blocks) - 1)
        equal = blocks[where] == value[maybe]
        maybe, where = maybe[equal], where[equal]
        hit[maybe[np.bincount(where, minlength=len(blocks))[where] > 1]] = True
    found = [np.cumsum(s >> 1)[hit[c]].astype("<u4").tobytes() for s, c in zip(steps, _cut(sizes))]
    out = pa.table({"slice": table.column("slice"), "ids": table.column("ids"), "first": table.column("first"), "known": table.column("known"), "hits": pa.array(found, pa.binary())})
    keep = [bool(h or i) for h, i in zip(found, table.column("ids").to_pylist())]
    return out.filter(pa.array(keep))


def _by_document(table: pa.Table) -> pa.Table:
    """Of one slice: the hit places of each document."""
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<i8")
    first = np.frombuffer(b"".join(table.column("first").to_pylist()), "<i8")
    hits = np.unique(np.frombuffer(b"".join([*table.column("hits").to_pylist(), *table.column("known").to_pylist()]), "<u4")).astype(np.int64)
    doc = np.searchsorted(first, hits, "right") - 1
    place = (hits - first[doc]).astype("<i4")
    starts, sizes = _runs(doc)
    return pa.table({"id": pa.array(ids[doc[starts]], pa.int64()), "places": pa.array([place[c].tobytes() for c in _cut(sizes)], pa.binary())})


def _hits(docs: DataFrame, block: int, ranges: int, packed: int, tasks: int, seed: int) -> DataFrame:
    """(id, places): where the probes hit; a document has a row for each slice that holds it."""
    found = _probes(docs, block, ranges, packed, seed).repartition(tasks, "range").groupBy("range").applyInArrow(_anchored, "slice long, ids binary, first binary, known binary, hits binary")
    return found.groupBy("slice").applyInArrow(_by_document, "id long, places binary")


WINDOWS = "range int, ids binary, counts binary, steps binary, low binary, high binary, gone binary"
LATER = [("id", "<i8"), ("first", "<i8"), ("place", "<i4"), ("first_place", "<i4")]


def _marked(words: bw.Words, starts: list[bytes | None], before: int, after: int) -> np.ndarray:
    """Words from `before` before each of the given places to `after` after it, within its document."""
    mark = np.zeros(len(words.start) + 1, np.int32)
    for i, blob in enumerate(starts):
        if blob:
            a, b = int(words.first[i]), int(words.first[i + 1])
            at = np.frombuffer(blob, "<i4").astype(np.int64) + a
            at = at[at < b]
            np.add.at(mark, np.maximum(at - before, a), 1)
            np.add.at(mark, np.minimum(at + after, b), -1)
    return np.cumsum(mark[:-1]) > 0


def _packed(ids: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Runs of one id as ids and counts, and steps between places (from 0 where the id changes)."""
    starts, sizes = _runs(ids)
    step = np.diff(place, prepend=0)
    step[starts] = place[starts]
    return ids[starts].astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), _small(step)


def _unpacked(ids: bytes, counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.frombuffer(counts, "<u4").astype(np.int64)
    step = _large(steps, int(sizes.sum()))
    total = np.cumsum(step)
    starts = np.cumsum(sizes) - sizes
    return np.repeat(np.frombuffer(ids, "<i8"), sizes), total - np.repeat(total[starts] - step[starts], sizes)


def _later(ids: np.ndarray, place: np.ndarray, *hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrence of each window; and of those that start later, what LATER lists (equal starts don't)."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, LATER)
    order = np.lexsort((place, ids, *hashes))
    new = np.zeros(len(order), bool)
    new[0] = True
    for h in hashes:
        s = h[order]
        new[1:] |= s[1:] != s[:-1]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (ids[order] != ids[first]) | (place[order] != place[first])
    at, source = order[later], first[later]
    out = np.zeros(len(at), LATER)
    out["id"], out["place"], out["first"], out["first_place"] = ids[at], place[at], ids[source], place[source]
    return order[new], out


def _windows(joined: DataFrame, window: int, ranges: int, seed: int) -> DataFrame:
    """Packed candidate windows, the first of its kind in a slice; and those known to be later."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 16
        for batch in slices(batches, "text", SLICE_BYTES // 2):  # two hashes of each word are held at once
            whole = np.array([bool(d) and hashlib.sha256(t or b"").hexdigest() in d for d, t in zip(batch.column(3).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())])
            places = [b"".join(p or []) if not w else b"" for p, w in zip(batch.column(2).to_pylist(), whole)]
            if not any(places):
                continue
            words = bw.split(batch.column(1))
            within = bw.within(words.first, window)
            at = np.flatnonzero(_marked(words, places, block, 1)[: len(within)] & within)
            if not len(at):
                continue
            a, b = (bw.rolling(bw.span_hash(words.data, words.start, words.end, seed + s), window, seed + s + 2)[at] for s in (0, 1))
            ids, place = batch.column(0).to_numpy()[words.doc[at]], words.place[at].astype(np.int64)
            first, later = _later(ids, place, b, a)
            part = _ranges(a[first], ranges)
            order = np.lexsort((place[first], ids[first], part))
            first, part = first[order], part[order]
            starts, sizes = _runs(part)
            rows = [(int(part[c.start]), *_packed(ids[first[c]], place[first[c]]), a[first[c]].tobytes(), b[first[c]].tobytes(), b"") for c in _cut(sizes)]
            if len(later):  # any range will do; each slice takes another
                number += 1
                rows.append(((number * 0x9E3779B1 >> 8) % ranges, b"", b"", b"", b"", b"", later.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 6])], [x.split()[0] for x in WINDOWS.split(", ")])

    return joined.mapInArrow(run, WINDOWS)


def _removed(table: pa.Table) -> pa.Table:
    """Of one range: the windows that occur earlier, and where, by document."""
    rows = table.to_pylist()
    gone = [np.frombuffer(r["gone"], LATER) for r in rows if r["gone"]]
    own = [(_unpacked(r["ids"], r["counts"], r["steps"]), r) for r in rows if not r["gone"]]
    if own:
        ids, place = (np.concatenate([p[i] for p, _ in own]) for i in (0, 1))
        low, high = (np.frombuffer(b"".join(r[c] for _, r in own), "<u8") for c in ("low", "high"))
        gone.append(_later(ids, place, high, low)[1])
    every = np.concatenate(gone)
    every = every[np.argsort(every["id"], kind="stable")]
    starts, sizes = _runs(every["id"])
    return pa.table({"id": pa.array(every["id"][starts], pa.int64()), "later": pa.array([every[c].tobytes() for c in _cut(sizes)], pa.binary())})


REPEATS = "id long, start int, windows int, first long, first_start int"


def _repeats(removed: DataFrame) -> DataFrame:
    """Maximal exact repeats: windows that follow each other in the document and in the first occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blobs in batch.column(1).to_pylist():
                own = np.frombuffer(b"".join(blobs), LATER)
                own = own[np.lexsort((own["first_place"], own["first"], own["place"]))]
                # in runs of one source and one shift
                order = np.lexsort((own["place"], own["place"].astype(np.int64) - own["first_place"], own["first"]))
                own = own[order]
                new = np.ones(len(own), bool)
                new[1:] = (own["first"][1:] != own["first"][:-1]) | (np.diff(own["place"]) != 1) | (np.diff(own["first_place"]) != 1)
                at = np.flatnonzero(new)
                out.append((own["id"][at], own["place"][at], np.diff(np.append(at, len(own))), own["first"][at], own["first_place"][at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))], [x.split()[0] for x in REPEATS.split(", ")])

    return removed.groupBy("id").agg(F.collect_list("later").alias("later")).mapInArrow(run, REPEATS)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs (id, text) with a number that is unique and in the defined order: the id itself where that serves."""
    shared = docs.groupBy("id").count().where("count > 1 OR id IS NULL").limit(1).count()
    if not shared:
        return docs.select("id", "text", F.col("id").alias("number"))
    own = stored(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    order = own.select("row", "id", F.xxhash64("text").alias("told")).orderBy(F.col("id").asc_nulls_last(), "told", "row")
    numbers = stored(order.select("row", F.monotonically_increasing_id().alias("number")), "numbers")
    return stored(own.join(numbers, "row").select("id", "text", "number"), "numbered")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, keep_text: bool = False, attempts: int = 3) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]): what is left without words of windows that start earlier.

    kept is the remaining words joined by one space.
    """
    docs = _numbered(only(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    for n in range(attempts):
        done, proofs = _without_repeats(docs, window, keep_text, 4 * n)
        wrong = proofs.groupBy("first", "first_start", "windows").agg((F.min("proof") != F.max("proof")).alias("wrong")).where("wrong").limit(1).count()
        if not wrong:
            return done.withColumnRenamed("id", id_col)
    raise ArithmeticError("windows of different words had equal 128-bit hashes in every attempt")


def _without_repeats(docs: DataFrame, window: int, keep_text: bool, seed: int) -> tuple[DataFrame, DataFrame]:
    """The result, and for each maximal repeat and its first occurrence the SHA-256 of its words."""
    spark = docs.sparkSession
    texts = docs.select(F.col("number").alias("id"), "text")
    keys = stored(texts.where(F.octet_length("text") >= 2 * window - 1).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").alias("size")), "keys")
    ranges, packed = _sizes(keys.agg(F.sum("size")).first()[0] or 0)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges // 4)
    # a group of copies is met in parts, each with the first of the whole group
    groups = keys.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    salts = max(16, -(-keys.count() // COPIES))
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = keys.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(groups, ["digest", "salt"]).where("id > first").select("id", F.array("digest").alias("copies"))
    hits = _hits(texts, window // 2, ranges, packed, tasks, seed).groupBy("id").agg(F.collect_list("places").alias("places"))
    found = stored(hits.join(copies, "id", "full"), "hits")
    candidates = texts.join(found, "id").select("id", "text", "places", "copies")
    less = max(64, ranges // 4)
    removed = _windows(candidates, window, less, seed).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), less // 4), "range").groupBy("range").applyInArrow(_removed, "id long, later binary")
    repeats = stored(_repeats(removed), "repeats")
    piece = F.struct("start", "windows", "first", "first_start")
    ends = repeats.select("id", piece.alias("piece")).unionByName(repeats.select(F.col("first").alias("id"), F.struct(F.col("first_start").alias("start"), "windows", F.lit(None).cast("long").alias("first"), F.col("first_start")).alias("piece")).distinct())
    pieces = ends.groupBy("id").agg(F.collect_list("piece").alias("pieces"))
    whole = found.where("copies IS NOT NULL").select("id", "copies")
    joined = docs.withColumnRenamed("id", "doc").join(pieces.join(whole, "id", "full"), F.col("number") == F.col("id"), "left").select("doc", "text", "pieces", "copies", "number")
    proof = pa.list_(pa.struct([("first", pa.int64()), ("first_start", pa.int32()), ("windows", pa.int32()), ("proof", pa.binary())]))
    names = ["id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else []), "proofs"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, own, copies, number in zip(batch.column(1).cast(pa.binary()).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3, 4))):
                words = (text or b"").split()
                n, proofs = len(words), []
                mark = np.zeros(n + 1, np.int32)
                for p in own or []:
                    a, b = p["start"], p["start"] + p["windows"] + window - 1
                    told = hashlib.sha256(b" ".join(words[a:b])).digest()
                    proofs.append({"first": number if p["first"] is None else p["first"], "first_start": p["first_start"], "windows": p["windows"], "proof": told})
                    if p["first"] is not None:
                        mark[a] += 1
                        mark[b] -= 1
                if copies and n >= window and hashlib.sha256(text).hexdigest() in copies:
                    words = []
                elif proofs:
                    words = [words[i] for i in np.flatnonzero(np.cumsum(mark[:n]) == 0).tolist()]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else []), proofs))
            kinds = [pa.int64(), pa.int64(), pa.string(), *([pa.string()] if keep_text else []), proof]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names)

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    done = stored(joined.mapInArrow(finish, schema + ", proofs array<struct<first:long,first_start:int,windows:int,proof:binary>>"), "kept")
    return done.drop("proofs"), done.select(F.inline("proofs"))
