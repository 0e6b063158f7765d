"""Secret scans: three fixed formats, and character Markov models for the rest.

First-order character models are trained on labelled samples: one of ordinary
words and identifiers (all tokens of the table that no fixed format covers), and
one for each alphabet in which secrets are written, of generated random strings.
A token is a secret if its log-likelihood ratio, the best random model over the
ordinary one, is large.  What the fixed formats find isn't learned from, so how
much of it the models find by themselves shows how well they do.

Defined results: a null text is empty and has no spans; repeated rows are each
scanned; an empty table gives an empty result; other columns are ignored.  With
no ordinary tokens at all the ordinary model is uniform.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bytewords as bw
from quern.llm.common import only, slices, text_buffers

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
NOT_HEX = np.array([chr(b) not in "0123456789abcdef" for b in range(256)])
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
NOT_TOKEN = np.array([chr(b) not in ALPHABET for b in range(256)])
N = len(ALPHABET)
CODE = np.zeros(256, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(N)

#: Alphabets of the random samples.
RANDOM = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[26:62], ALPHABET[:26] + "0123456789", ALPHABET[:26] + "234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-")

SPANS = "array<struct<kind:string,start:long,end:long>>"


def _docs_with(low: bytes, needles: tuple[bytes, ...], at: np.ndarray) -> set[int]:
    found = []
    for needle in needles:
        i = low.find(needle)
        while i >= 0:
            found.append(i)
            i = low.find(needle, i + len(needle))
    return set((np.searchsorted(at, found, "right") - 1).tolist()) if found else set()


def _runs(column: pa.Array, separators: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run of at least so many bytes, and its document."""
    words = bw.split(column, separators)
    keep = words.end - words.start >= least
    return words.start[keep], words.end[keep], np.searchsorted(words.doc_at, words.start[keep], "right") - 1


def base_spans(column: pa.Array) -> tuple[list[list[tuple[str, int, int]]], np.ndarray, np.ndarray]:
    """Of each row: (kind, start, end) in code points, by the fixed formats; code points before, and whether covered, for each byte."""
    data, at = text_buffers(column)
    raw = data.tobytes()
    points = bw.code_points(data)
    spans: list[list[tuple[str, int, int]]] = [[] for _ in range(len(at) - 1)]
    for i in _docs_with(raw.lower(), KEYWORDS, at):
        text = raw[at[i] : at[i + 1]].decode()
        spans[i] += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    for i in _docs_with(raw, (b"AKIA",), at):
        text = raw[at[i] : at[i + 1]].decode()
        spans[i] += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    for s, e, i in zip(*(x.tolist() for x in _runs(column, NOT_HEX, HEX_LEAST))):
        begin = int(points[s] - points[at[i]])
        spans[i].append(("hex", begin, begin + e - s))
    edges = np.array([(points[at[i]] + s, points[at[i]] + e) for i, own in enumerate(spans) for _, s, e in own], np.int64).reshape(-1, 2)
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, np.searchsorted(points, edges[:, 0], "right") - 1, 1)  # of equal counts the last is the character's first byte
    np.add.at(change, np.searchsorted(points, edges[:, 1], "right") - 1, -1)
    return spans, points, np.cumsum(change[:-1]) > 0


def _touched(covered: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether any byte of each run is covered."""
    total = np.concatenate([[0], np.cumsum(covered)])
    return total[end] > total[start]


def _bigrams(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Counts of (character, next character) within the spans."""
    if not len(start):
        return np.zeros(N * N, np.int64)
    here = np.zeros(len(raw) + 1, np.int8)
    np.add.at(here, start, 1)
    np.add.at(here, np.maximum(end - 1, start), -1)
    pairs = np.flatnonzero(np.cumsum(here[:-1]) > 0)
    return np.bincount(CODE[raw[pairs]] * N + CODE[raw[pairs + 1]], minlength=N * N)


def random_models(samples: int = 2_000, size: int = 40, seed: int = 9) -> np.ndarray:
    """Log probability of each next character, one model an alphabet, trained on so many generated strings."""
    draw, out = np.random.default_rng(seed), []
    for alphabet in RANDOM:
        codes = CODE[[ord(c) for c in alphabet]][draw.integers(0, len(alphabet), (samples, size))]
        pairs = codes[:, :-1] * N + codes[:, 1:]
        out.append(np.log(_conditional(np.bincount(pairs.ravel(), minlength=N * N).reshape(N, N), 0.5)))
    return np.stack(out)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 20_000) -> np.ndarray:
    """Log-likelihood ratios of each character pair: each random model over the ordinary one.

    The ordinary model is fitted on at most about max_docs documents, dealt by a
    hash of the id; the counts are summed in Spark and at most len(ALPHABET)
    squared rows return.
    """
    total = docs.count()
    part = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, max_docs / max(total, 1))))
    sample = docs.where(part).select(F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(N * N, np.int64)
        for batch in slices(batches, "text"):
            _, _, covered = base_spans(batch.column(0))
            data, _ = text_buffers(batch.column(0))
            start, end, _ = _runs(batch.column(0), NOT_TOKEN, 2)
            plain = ~_touched(covered, start, end)
            counts += _bigrams(data, start[plain], end[plain])
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": cell, "plain": counts[cell]})

    counts = np.zeros(N * N)
    for row in sample.mapInArrow(count, "cell long, plain long").groupBy("cell").agg(F.sum("plain").alias("plain")).collect():
        counts[row["cell"]] = row["plain"]
    return random_models() - np.log(_conditional(counts.reshape(N, N)))


def _conditional(counts: np.ndarray, weight: float = 2.0 * N) -> np.ndarray:
    """Probability of the next character: pair counts, filled up by how common it is at all."""
    common = counts.sum(axis=0) + 0.5
    return (counts + weight * common / common.sum()) / (counts.sum(axis=1, keepdims=True) + weight)


def ratios(data: np.ndarray, start: np.ndarray, end: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """The best summed ratio of each run."""
    if not len(start):
        return np.zeros(0)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, end - 1, -1)
    pairs = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    cells = CODE[data[pairs]] * N + CODE[data[pairs + 1]]
    first = np.searchsorted(pairs, start)
    return np.max([np.add.reduceat(model.ravel()[cells], first) for model in ratio], axis=0)


def scan(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", least: int = 16, threshold: float = 12.0) -> DataFrame:
    """(id, spans, n_base_tokens, n_base_found): all spans of each text by start, then kind; ends are exclusive code points.

    A token of at least `least` characters whose summed ratio exceeds the
    threshold is added as kind markov unless it overlaps a span already found.
    Of the tokens that do overlap one, n_base_found counts those that the models
    find too.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            column = batch.column(1)
            spans, points, covered = base_spans(column)
            data, at = text_buffers(column)
            start, end, doc = _runs(column, NOT_TOKEN, least)
            secret, known = ratios(data, start, end, ratio) > threshold, _touched(covered, start, end)
            for s, e, i in zip(*(x[secret & ~known].tolist() for x in (start, end, doc))):
                begin = int(points[s] - points[at[i]])
                spans[i].append(("markov", begin, begin + e - s))
            order = {k: n for n, k in enumerate(KINDS)}
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in sorted(own, key=lambda x: (x[1], order[x[0]]))] if own else [] for own in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            counts = [pa.array(np.bincount(doc[mask], minlength=batch.num_rows)) for mask in (known, known & secret)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), *counts], ["id", "spans", "n_base_tokens", "n_base_found"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(find, f"id {own.schema['id'].dataType.simpleString()}, spans {SPANS}, n_base_tokens long, n_base_found long").withColumnRenamed("id", id_col)


def _is(kind: str):
    return lambda x: x["kind"] == kind


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"] != "markov")
    count = {k: F.size(F.filter("spans", _is(k))).cast("long") for k in KINDS}
    return found.select(id_col, *[c.alias(f"n_{k}") for k, c in count.items() if k != "markov"], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count["markov"].alias("n_markov"), "n_base_tokens", "n_base_found")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Train on generated random strings and the table's ordinary tokens, scan every whole text, and give the digest."""
    docs = only(docs, id_col, text_col)
    return digest(scan(docs, train(docs, id_col, text_col), id_col, text_col, **limits), id_col)
