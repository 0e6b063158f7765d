"""Packing: window cuts at document and sentence ends, chosen by dynamic programming.

The documents of an input partition form one stream of tokens in their stored
order.  Cutting it into windows costs the padding of each window and a penalty
for each cut inside a document.  With ends e[0] < e[1] < ... the least cost is

    f[j] = penalty[j] + length - e[j] + min(f[i] + e[i] : 0 < e[j] - e[i] <= length)

The minimum over this sliding range of i comes from a monotone queue, so each end
enters and leaves it once.  A window whose size is a power of two needs no
padding; these few sizes are further ways to reach an end.  Only a sentence of
more than `length` tokens has ends inside, at the highest penalty.

The stream is cut in blocks.  After a block, the cheapest ways to all ends that
can still begin a window share their first cuts; these are final, the rest stays
for the next block.  So the cuts are the cheapest of the whole stream, while a
task mostly holds about one block.  Where no cut is shared, as in long stretches of
equal documents of half a window, it holds the stretch: four bytes a token and 24 an
end, at most those of its input partition.

Defined results: a null or empty text is the end token alone; repeated rows are
each packed; an empty table gives no pieces.  Sequence ids are unique over the
table: the input partition's number, then a running number.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import only, slices

END = 0  # the id that ends each document
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut string"


class Encoder:
    """Ids of the tokenizer file, by the faster of two equal byte-pair encoders.

    The same vocabulary as ranks gives the same ids; texts that spell a special
    token go to the tokenizer itself, which knows these.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str | None, pattern: str | None):
        self.file, self.own, self.fast = tokenizer_file, None, None
        with open(tokenizer_file, encoding="utf-8") as f:
            parts = json.load(f)
        self.special = [t["content"] for t in parts.get("added_tokens", [])]
        vocabulary = parts["model"]["vocab"]
        n = max(vocabulary.values()) + len(self.special) + 1
        #: Whether the token closes with a full stop or the like, holds a line break, or begins with a space (all as byte-level tokens are written).
        self.stops, self.breaks, self.spaced = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        self.stops[[i for t, i in vocabulary.items() if t[-1:] in (".", "!", "?")]] = True
        self.breaks[[i for t, i in vocabulary.items() if "\u010a" in t]] = True
        self.spaced[[i for t, i in vocabulary.items() if t[:1] in ("\u0120", "\u010a")]] = True
        if ranks_file:
            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def full(self, text: str) -> list[int]:
        if self.own is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.file)
        return self.own.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.full(text), np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Whether a sentence ends with each token: at a line break, or at a stop before a space."""
        before_space = np.append(self.spaced[ids[1:]], True)
        return self.breaks[ids] | (self.stops[ids] & before_space)


@lru_cache(maxsize=2)
def encoder_of(tokenizer_file: str, ranks_file: str | None, pattern: str | None) -> Encoder:
    """One for each worker: it outlives the task."""
    return Encoder(tokenizer_file, ranks_file, pattern)


class Cutter:
    """The dynamic programme over a growing list of ends.

    Positions count from the last final cut.
    """

    def __init__(self, length: int):
        self.length = length
        self.powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
        self.restart()

    def restart(self) -> None:
        self.e, self.cost, self.back = array("q", [0]), array("d", [0.0]), array("q", [0])
        self.queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # (f + e, e, index), values rising

    def exact(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the further ends lie a power of two after which end number, smaller powers first."""
        known = len(self.e)
        first = max(0, known - self.length)
        every = np.concatenate([np.array(self.e[first:], np.int64), ends])
        found = []
        for size in self.powers:
            at = np.searchsorted(every, ends - size)
            hit = np.flatnonzero(every[at] == ends - size)
            found.append((hit, at[hit] + first))
        here, short = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        order = np.argsort(here, kind="stable")
        return here[order], short[order]

    def add(self, ends: list[int], penalties: list[float]) -> None:
        """Further ends, ascending and at most `length` apart."""
        if not len(ends):
            return
        e, cost, back, queue, length = self.e, self.cost, self.back, self.queue, self.length
        further = np.array(ends, np.int64)
        which, shorts = self.exact(further)
        which, shorts, k = [*which.tolist(), -1], shorts.tolist(), 0
        j = len(e)
        e.frombytes(further.tobytes())
        for number, (here, penalty) in enumerate(zip(ends, penalties)):
            while queue[0][1] < here - length:
                queue.popleft()
            value, _, i = queue[0]
            best = value + length - here
            while which[k] == number:
                short = shorts[k]
                if cost[short] < best:
                    best, i = cost[short], short
                k += 1
            best += penalty
            cost.append(best)
            back.append(i)
            best += here
            while queue and queue[-1][0] >= best:
                queue.pop()
            queue.append((best, here, j))
            j += 1

    def path(self, j: int) -> list[int]:
        """The cuts of the cheapest way to end number j, ascending."""
        out = []
        while j:
            out.append(self.e[j])
            j = self.back[j]
        return out[::-1]

    def shared(self) -> int:
        """The last end that all cheapest ways to the ends of the last window pass."""
        n = len(self.e) - 1
        active = {j for j in range(max(0, n - self.length), n + 1) if self.e[j] >= self.e[n] - self.length}
        while len(active) > 1:
            j = max(active)
            active.remove(j)
            active.add(self.back[j])
        return active.pop()


def cuts(ends: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Positions of the cheapest cuts: ascending, the last is ends[-1].

    ends are ascending positions above 0, at most `length` apart.
    """
    cutter = Cutter(length)
    cutter.add(ends.tolist(), penalties.tolist())
    return cutter.path(len(cutter.e) - 1)


def with_hard_ends(ends: np.ndarray, penalties: np.ndarray, kinds: np.ndarray, length: int, every: int, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adds ends, `every` tokens apart, inside stretches of more than `length` tokens without one."""
    begin = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - begin > length)
    if not len(long):
        return ends, penalties, kinds
    more = np.concatenate([np.arange(begin[k] + every, ends[k], every) for k in long])
    order = np.argsort(np.concatenate([ends, more]), kind="stable")
    joined = lambda a, v: np.concatenate([a, np.full(len(more), v, a.dtype)])[order]
    return np.concatenate([ends, more])[order], joined(penalties, penalty), joined(kinds, 2)


KINDS = pa.array(["document", "sentence", "hard"])


class Stream:
    """The documents of one task: their ids not yet cut, and where each began."""

    def __init__(self, encoder: Encoder, length: int, sentence_penalty: float, hard_penalty: float, hard_every: int, number: int):
        self.encoder, self.cutter, self.length = encoder, Cutter(length), length
        self.penalties, self.every, self.sequence = (sentence_penalty, hard_penalty), hard_every, number
        self.ids, self.docs = np.zeros(0, np.uint32), []  # docs: (id, first position, its tokens before that, all its tokens)
        self.ends, self.kinds, self.blocks, self.wait = np.zeros(0, np.int64), np.zeros(0, np.int8), 0, 1

    def take(self, docs: list[tuple], last: bool) -> Iterator[tuple]:
        """Adds (id, token ids) of whole documents; gives the columns of final pieces."""
        at = len(self.ids)
        block = np.concatenate([ids for _, ids in docs]) if docs else np.zeros(0, np.uint32)
        sizes = np.array([len(ids) for _, ids in docs], np.int64)
        doc_end = np.cumsum(sizes)
        self.docs += [(key, int(at + e - n), 0, int(n)) for (key, _), e, n in zip(docs, doc_end, sizes)]
        if len(block):
            stop = self.encoder.sentence_ends(block)
            stop[doc_end - 1] = True
            ends = np.flatnonzero(stop) + 1
            kinds = np.ones(len(ends), np.int8)
            kinds[np.searchsorted(ends, doc_end)] = 0
            ends, penalties, kinds = with_hard_ends(ends, np.where(kinds == 0, 0.0, self.penalties[0]), kinds, self.length, self.every, self.penalties[1])
            self.cutter.add((ends + at).tolist(), penalties.tolist())
            self.ids = np.concatenate([self.ids, block])
            self.ends, self.kinds = np.concatenate([self.ends, ends + at]), np.concatenate([self.kinds, kinds])
        self.blocks += 1
        j = len(self.cutter.e) - 1 if last else self.cutter.shared() if self.blocks >= self.wait else 0
        if not j and self.blocks >= self.wait:
            self.wait = 2 * self.blocks  # looking back takes as long as the stretch
        if j:
            yield self.final(np.array(self.cutter.path(j)), j)

    def final(self, path: np.ndarray, j: int) -> tuple:
        done = int(path[-1])
        doc_start = np.array([d[1] for d in self.docs])
        doc_end = np.append(doc_start[1:], len(self.ids))
        bounds = np.union1d(path, doc_end[doc_end < done])
        begins = np.concatenate([[0], bounds[:-1]])
        owner = np.searchsorted(doc_start, begins, "right") - 1
        window = np.searchsorted(path, begins, "right")
        window_start = np.concatenate([[0], path])[window]
        raw = self.ids[:done].astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), bounds.tolist())]
        before, total = (np.array([d[k] for d in self.docs])[owner] for k in (2, 3))
        what = KINDS.take(pa.array(self.kinds[np.searchsorted(self.ends, bounds)].astype(np.int64)))
        out = [self.docs[i][0] for i in owner.tolist()], begins - doc_start[owner] + before, bounds - begins, crc, total, self.sequence + window, begins - window_start, what
        self.sequence += len(path)
        rest = int(np.searchsorted(doc_end, done, "right"))
        self.docs = [(d[0], max(0, d[1] - done), d[2] + max(0, done - d[1]), d[3]) for d in self.docs[rest:]]
        self.ids, self.blocks, self.wait = self.ids[done:], 0, 1
        # the ends after the last final cut are entered again, from the cut as position 0
        keep = self.ends > done
        self.ends, self.kinds = self.ends[keep] - done, self.kinds[keep]
        penalties = np.array([0.0, *self.penalties])[self.kinds]
        self.cutter = Cutter(self.length)
        self.cutter.add(self.ends.tolist(), penalties.tolist())
        return out


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, sentence_penalty: float = 4.0, hard_penalty: float = 12.0, hard_every: int = 32, block_tokens: int = 1 << 18) -> DataFrame:
    """One row a piece: which ids of which document stand where in which sequence.

    cut says what ends the piece: the document, a sentence, or neither (hard).
    """
    own = only(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", *(f.split()[0] for f in PIECES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_file, ranks_file, pattern)
        stream = Stream(encoder, length, sentence_penalty, hard_penalty, hard_every, TaskContext.get().partitionId() << 36)
        held, size, kind = [], 0, None

        def batched(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for ids, *numbers, what in pieces:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(x, pa.int64()) for x in numbers), what], names)

        for batch in slices(batches, "text"):
            kind = batch.schema.field("id").type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((key, np.append(encoder.ids(text or ""), np.uint32(END))))
                size += len(held[-1][1])
                if size >= block_tokens:
                    yield from batched(stream.take(held, False))
                    held, size = [], 0
        if held or len(stream.ids):
            yield from batched(stream.take(held, True))

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, {PIECES}").withColumnRenamed("id", id_col)
