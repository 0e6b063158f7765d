"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic scores.

Statistics of each whole text are standardised and mapped to random Fourier
features, which approximate a Gaussian kernel.  Every partition sums its share of
the normal equations; the driver adds these and solves a system of fixed size.
The ridge scores of the training rows are binned, pooled by adjacent violators,
and joined by straight lines, so that scores rise strictly between the pools.

Defined results: null and empty texts have the statistics of an empty text and
get a score like any other; repeated rows are each scored; several labels of one
document count as the lowest; with no training rows the score is 0.5, with one
class only it is that class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import bytewords as bw
from quern.llm.common import crc_remainder, only, slices

STATISTICS = (
    "log_words", "mean_word", "spread_word", "short_words", "long_words", "capitalised", "repeats_previous", "distinct_words", "distinct_pairs",
    "log_lines", "distinct_lines", "upper", "digit", "exclaim", "bar", "symbol", "stop", "comma", "beyond_ascii", "space",
)
_CLASSES = np.zeros((8, 256), bool)
_CLASSES[0, ord("A") : ord("Z") + 1] = True
_CLASSES[1, ord("0") : ord("9") + 1] = True
for _row, _chars in ((2, "!"), (3, "|"), (4, "#$%&*+/<=>@[]^_{}~\\"), (5, "."), (6, ",")):
    _CLASSES[_row, [ord(c) for c in _chars]] = True
_CLASSES[7, 128:] = True
_KIND = np.where(_CLASSES.any(axis=0), _CLASSES.argmax(axis=0) + 1, 0).astype(np.uint8)
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # ridge scores
    values: np.ndarray  # calibrated scores at the knots


def _share_distinct(key: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys over all keys of each document; 1 if it has none."""
    total = np.bincount(doc, minlength=n)
    tagged = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
    new = np.ones(len(tagged), bool)
    new[1:] = tagged[1:] != tagged[:-1]
    return np.where(total > 0, np.bincount((tagged[new] >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(total, 1), 1.0)


def statistics(column: pa.Array) -> np.ndarray:
    """One row a text, in the order of STATISTICS."""
    words, lines = bw.split(column), bw.split(column, _NEWLINE)
    n, doc, data = len(words.first) - 1, words.doc, words.data
    count, size = np.bincount(doc, minlength=n), np.diff(words.doc_at)
    some, length = np.maximum(count, 1), (words.end - words.start).astype(float)
    mean = np.bincount(doc, length, n) / some
    hashes = bw.span_hash(data, words.start, words.end)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    pair = bw.within(words.first, 2)
    kinds = np.bincount(np.repeat(np.arange(n), size) * 9 + _KIND[data], minlength=9 * n).reshape(n, 9)[:, 1:] / np.maximum(size, 1)[:, None]
    share = lambda mask: np.bincount(doc[mask], minlength=n) / some
    n_lines = np.diff(lines.first)
    return np.stack([
        np.log1p(count), mean, np.sqrt(np.maximum(np.bincount(doc, length**2, n) / some - mean**2, 0)), share(length <= 3), share(length > 12),
        share(_CLASSES[0][data[words.start]]), share(same), _share_distinct(hashes, doc, n), _share_distinct(bw.rolling(hashes, 2)[pair], doc[: len(pair)][pair], n),
        np.log1p(n_lines), _share_distinct(bw.span_hash(lines.data, lines.start, lines.end), lines.doc, n), *np.sqrt(kinds.T), 1 - np.bincount(doc, length, n) / np.maximum(size, 1),
    ], axis=1)


def fourier(x: np.ndarray, mean, spread, directions, phases) -> np.ndarray:
    z = np.clip((x - mean) / spread, -6, 6)
    waves = np.sqrt(2 / len(phases)) * np.cos(z @ directions + phases)
    return np.concatenate([waves, np.ones((len(x), 1))], axis=1)


def pooled(score: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means by pool adjacent violators; bins in ascending order of their score."""
    pools: list[list[float]] = []
    for s, y, n in zip(score, total, count):
        pools.append([s * n, y, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def predict(model: Model, column: pa.Array) -> np.ndarray:
    if not len(model.knots):
        return np.full(len(column), 0.5)
    z = fourier(statistics(column), model.mean, model.spread, model.directions, model.phases)
    return np.clip(np.interp(z @ model.weights, model.knots, model.values), 0, 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, waves: int = 256, width: float = 1.0, ridge: float = 1e-3, bins: int = 400, seed: int = 11) -> Model:
    """Fit on about max_rows labelled rows at most, dealt by a hash of the id.

    labels must hold the rows to learn from and no other.  width is the kernel's
    in units of the root of the number of statistics.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("double").alias("y"))
    share = int(1_000_000 * min(1.0, max_rows / max(marks.count(), 1)))
    picked = lambda df: df.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < share)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    # the picked labels, about max_rows at most, go to the documents, so that only labelled texts are measured
    own = picked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).join(F.broadcast(picked(marks)), "id")
    rows = own.select("y", "text").mapInArrow(measure, "y double, x array<double>").select("x", "y").persist()
    k, rng = len(STATISTICS), np.random.default_rng(seed)
    directions = rng.standard_normal((k, waves)) / (width * np.sqrt(k))
    phases = rng.uniform(0, 2 * np.pi, waves)
    sums = rows.agg(F.count("y"), *[F.avg(F.col("x")[i]) for i in range(k)], *[F.stddev_pop(F.col("x")[i]) for i in range(k)]).first()
    if not sums[0]:
        rows.unpersist()
        return Model(*[np.zeros(0)] * 7)
    mean = np.array(sums[1 : k + 1], float)
    spread = np.maximum(np.array(sums[k + 1 :], float), 1e-6)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((waves + 1, waves + 2))
        for batch in batches:
            if batch.num_rows:
                x, y = np.stack(batch.column(0).to_numpy(zero_copy_only=False)), batch.column(1).to_numpy()
                z = fourier(x, mean, spread, directions, phases)
                total += z.T @ np.concatenate([z, y[:, None]], axis=1)
        if total.any():
            yield pa.RecordBatch.from_pydict({"line": np.arange(waves + 1), "v": list(total)})

    def added(table: pa.Table) -> pa.Table:
        return pa.table({"line": table.column("line")[:1], "v": [np.stack(table.column("v").to_numpy()).sum(axis=0)]})

    lines = rows.mapInArrow(normal, "line long, v array<double>").groupBy("line").applyInArrow(added, "line long, v array<double>").collect()
    system = np.zeros((waves + 1, waves + 2))
    for row in lines:
        system[row["line"]] = row["v"]
    gram, right = system[:, :-1], system[:, -1]
    weights = np.linalg.solve(gram + ridge * sums[0] / waves * np.eye(waves + 1), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
                s = np.clip(fourier(x, mean, spread, directions, phases) @ weights, -0.5, 1.5)
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(s * bins).astype(np.int64)), pa.array(s), batch.column(1)], ["bin", "s", "y"])

    pools = rows.mapInArrow(binned, "bin long, s double, y double").groupBy("bin").agg(F.avg("s").alias("s"), F.sum("y").alias("y"), F.count("y").alias("n")).orderBy("bin").collect()
    rows.unpersist()
    knots, values = pooled(*(np.array([r[c] for r in pools], float) for c in ("s", "y", "n")))
    return Model(mean, spread, directions, phases, weights, knots, values)


def scored(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """All columns of docs and the score of the text, which replaces a column of that name."""
    docs = docs.drop(into) if into in docs.columns else docs
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            value = predict(shared.value, batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, pa.float64())], [*batch.schema.names, into])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held: int = 0, **how) -> Model:
    """Train outside the held-out fold: crc32 of the id modulo folds."""
    rows = only(labels, id_col, label_col).where(crc_remainder(id_col, folds) != held)
    return train(only(docs, id_col, text_col), rows, id_col, text_col, label_col, **how)


def accepted(threshold: float = 0.3, score: str = "score") -> Column:
    return F.col(score) >= threshold


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held: int = 0, threshold: float = 0.3, **how) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    model = learn(docs, labels, id_col, text_col, label_col, folds, held, **how)
    return scored(only(docs, id_col, text_col), model, text_col).select(id_col, (crc_remainder(id_col, folds) == held).alias("held_out"), "score", accepted(threshold).cast("int").alias("predicted"))
