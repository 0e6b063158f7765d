"""Toxicity: a linear-chain CRF tags toxic tokens; its marginals score documents.

Only documents are labelled, so training tokens get weak labels: in a toxic
training document a token is toxic if its word or a prefix of it is frequent in
toxic and absent from clean training documents.  The chain then learns weights of
hashed word, prefix, suffix and neighbour features and of the transitions, by
L-BFGS on the penalised conditional likelihood, which is concave, until its
gradient is small.  A document of any length is one chain.  Marginals by
forward-backward give each token's probability, runs of likely tokens give the
offending offsets, and a logistic fit on the training documents' marginals gives
the document score.

How strict the weak labels are is chosen by cross-validation inside the training
documents: each setting is fitted on all parts but one of the sample and judged on
the part left out, one task a part and setting.  Held-out documents take no part.

Forward and backward messages are products of 2 x 2 matrices, which can be
bracketed at will: runs of BLOCK words are multiplied side by side, then one
message passes from run to run of each document, then all runs are filled in side
by side.  This gives the same numbers as word after word, in far fewer steps.

Defined results: null and empty texts have no tokens and get the score of the
least toxic evidence; repeated rows are each scored; labels with several rows a
document count as toxic if any is; without both labels in training the score is
the share of toxic training rows (0.0 if there are none).  Equal ids with several texts train as several documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bytewords as bw
from quern.llm.common import crc_remainder, lowered, only, slices, stored

BITS = 18
SIZE = 1 << BITS
#: Bytes of the prefixes and suffixes that are features.
PREFIXES, SUFFIXES = (3, 4, 5, 7), (3,)
#: Likeliest tokens that tell about a document.
TOP = 3
#: Words of a document that are multiplied one after the other.
BLOCK = 64
#: (purity, doubt) that cross-validation chooses from: least share of toxic documents, clean ones added to those seen.
SETTINGS = ((0.65, 1 / 300), (0.75, 1 / 300), (0.85, 1 / 300))
#: Parts of the sample, and rounds of the fits that only compare settings.
PARTS, TRIAL_ROUNDS = 2, 40


@dataclass
class Chain:
    weights: np.ndarray  # of hashed features, for the toxic state
    left: np.ndarray  # of the previous word
    right: np.ndarray  # of the next word
    bias: float
    transitions: np.ndarray  # 2 x 2
    slopes: np.ndarray = field(default_factory=lambda: np.ones(TOP))
    offset: float = 0.0
    constant: float | None = None


def features(words: bw.Words) -> np.ndarray:
    """One row a word: hashed slots of the word, its prefixes and its suffixes."""
    s, e = words.start, words.end
    parts = [(s, e), *((s, np.minimum(s + k, e)) for k in PREFIXES), *((np.maximum(e - k, s), e) for k in SUFFIXES)]
    found = bw.span_hashes(words.data, s, e, parts)
    return np.stack([((x + np.uint64(i)) >> np.uint64(64 - BITS)).astype(np.int32) for i, x in enumerate(found)], axis=1)


def emissions(chain: Chain, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
    score = chain.weights[slots].sum(axis=1) + chain.bias
    word = slots[:, 0]
    inner = np.ones(len(word), bool)
    inner[first[:-1][first[:-1] < len(word)]] = False
    score[1:] += np.where(inner[1:], chain.left[word[:-1]], 0)
    score[:-1] += np.where(inner[1:], chain.right[word[1:]], 0)
    return score


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and size of each run of at most BLOCK words, and each document's first run; one more at the end."""
    count = -(-np.diff(first) // BLOCK)
    first_run = np.concatenate([[0], np.cumsum(count)])
    within = np.arange(first_run[-1]) - np.repeat(first_run[:-1], count)
    begin = np.repeat(first[:-1], count) + BLOCK * within
    return begin, np.minimum(BLOCK, np.repeat(first[1:], count) - begin), first_run


def _step(x: np.ndarray, y: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row vectors (x, y) times t."""
    return x * t[0, 0] + y * t[1, 0], x * t[0, 1] + y * t[1, 1]


def marginals(score: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of the toxic state at each token; summed pair marginals; log partition."""
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    t, ratio = np.exp(transitions), np.exp(np.clip(score, -60, 60))
    begin, size, first_run = _blocks(first)
    opens = np.zeros(len(begin), bool)
    opens[first_run[:-1][np.diff(first_run) > 0]] = True
    order = np.argsort(-size, kind="stable")  # so that runs still going at a step are the first ones
    going = np.searchsorted(-size[order], -np.arange(BLOCK), "left")
    steps, at, fresh = int(size[order[0]]), begin[order], opens[order]
    count = np.diff(first_run)
    most = int(count.max())
    left, right = np.ones((len(begin), 2)), np.ones((len(begin), 2))
    if most > 1:
        # the matrix of each run, from the state before it to the state at its end, by rows
        one, two = (np.zeros((2, len(begin))) for _ in range(2))
        one[0], two[1] = 1.0, 1.0
        for k in range(steps):
            g = going[k]
            r = ratio[at[:g] + k]
            rows = [_step(m[0, :g], m[1, :g], t) for m in (one, two)]
            if k == 0:  # nothing comes before a document's first word
                rows = [(np.where(fresh[:g], 1.0, x), np.where(fresh[:g], 1.0, y)) for x, y in rows]
            rows = [(x, y * r) for x, y in rows]
            top = np.maximum(np.maximum(*rows[0]), np.maximum(*rows[1]))
            for m, (x, y) in zip((one, two), rows):
                m[0, :g], m[1, :g] = x / top, y / top
        matrix = np.empty((len(begin), 2, 2))
        matrix[order, 0], matrix[order, 1] = one.T, two.T
        docs = np.argsort(-count, kind="stable")
        many = np.searchsorted(-count[docs], -np.arange(1, most + 1), "left")  # documents with more than so many runs
        for k in range(1, most):
            r = first_run[docs[: many[k - 1]]] + k
            m = np.einsum("ni,nij->nj", left[r - 1], matrix[r - 1])
            left[r] = m / m.sum(axis=1, keepdims=True)
        for k in range(most - 1, 0, -1):
            r = first_run[docs[: many[k - 1]]] + k
            m = np.einsum("nij,nj->ni", matrix[r], right[r])
            right[r - 1] = m / m.sum(axis=1, keepdims=True)
    forward, backward, scale = np.zeros((2, n)), np.zeros((2, n)), np.ones(n)
    a, b = (left[order] / left[order].sum(axis=1, keepdims=True)).T
    for k in range(steps):
        g = going[k]
        where = at[:g] + k
        x, y = _step(a[:g], b[:g], t)
        if k == 0:
            x, y = np.where(fresh, 1.0, x), np.where(fresh, 1.0, y)
        y = y * ratio[where]
        total = x + y
        scale[where] = total
        a, b = x / total, y / total
        forward[0, where], forward[1, where] = a, b
    a, b = right[order].T.copy()
    for k in range(steps - 1, -1, -1):
        g = going[k]
        where = at[:g] + k
        backward[0, where], backward[1, where] = a[:g], b[:g]
        x, y = _step(a[:g], b[:g] * ratio[where], t.T)
        a[:g], b[:g] = x / (x + y), y / (x + y)
    both = forward * backward
    p = both[1] / both.sum(axis=0)
    inner = np.ones(n, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    inner = np.flatnonzero(inner)
    before, x, y = forward[:, inner - 1], backward[0, inner], backward[1, inner] * ratio[inner]
    after = np.stack(_step(x, y, t.T))
    weight = np.stack([x, y]) / (before * after).sum(axis=0)
    return p, t * (before @ weight.T), float(np.log(scale).sum())


def evidence(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log odds of each document's likeliest toxic tokens, falling and bounded; the bound where it has fewer."""
    out = np.full((len(first) - 1, TOP), -12.0)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        left, owner = p.copy(), np.repeat(np.arange(len(full)), np.diff(first)[full])
        for k in range(TOP):
            top = np.maximum.reduceat(left, first[full])
            bounded = np.clip(top, 1e-9, 1 - 1e-9)
            out[full, k] = np.clip(np.log(bounded) - np.log1p(-bounded), -12, 12)
            _, where = np.unique(owner[(at := np.flatnonzero(left == top[owner]))], return_index=True)
            left[at[where]] = 0.0
    return out


def document_score(chain: Chain, p: np.ndarray, first: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(evidence(p, first) @ chain.slopes + chain.offset, -30, 30)))


def weak_labels(slots: np.ndarray, doc: np.ndarray, toxic: np.ndarray, purity: float, doubt: float) -> np.ndarray:
    """Tokens of toxic documents with a slot that is frequent there and rare elsewhere.

    The share of toxic among a slot's documents, with classes weighed alike, is
    reckoned with a few clean documents more than were seen: chance makes some
    rare words look toxic, and more of them the more documents there are.
    """
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    used = slots[:, [0, *range(2, 1 + len(PREFIXES))]]  # the word and its longer prefixes
    good = np.zeros(SIZE, bool)
    for column in used.T:
        seen = np.unique(doc.astype(np.int64) * SIZE + column)
        d, slot = seen // SIZE, seen % SIZE
        hit = np.bincount(slot[toxic[d]], minlength=SIZE)
        miss = np.bincount(slot[~toxic[d]], minlength=SIZE) * (n_toxic / max(1, n_clean))
        good |= hit >= purity * (hit + miss + 1 + n_toxic * doubt)
    return good[used].any(axis=1) & toxic[doc]


def climbed(value_and_gradient, x: np.ndarray, rounds: int, tolerance: float, flat: float = 1e-4, memory: int = 8) -> np.ndarray:
    """A maximum of a concave function by L-BFGS with backtracking."""
    value, g = value_and_gradient(x)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    start = np.abs(g).max()
    for _ in range(rounds):
        if np.abs(g).max() <= tolerance * max(start, 1e-12):
            break
        step, parts = g.copy(), []
        for s, y in reversed(kept):
            a = (s @ step) / (s @ y)
            parts.append(a)
            step -= a * y
        step *= (kept[-1][0] @ kept[-1][1]) / (kept[-1][1] @ kept[-1][1]) if kept else 1 / max(1.0, np.abs(g).max())
        for (s, y), a in zip(kept, reversed(parts)):
            step += (a - (y @ step) / (s @ y)) * s
        rise, size = g @ step, 1.0
        while True:
            new = x + size * step
            v, h = value_and_gradient(new)
            if v >= value + 1e-4 * size * rise or size < 1e-6:
                break
            size /= 2
        s, y = new - x, g - h
        if s @ y > 1e-12:
            kept = [*kept, (s, y)][-memory:]
        done = abs(v - value) <= flat * max(1.0, abs(v))
        x, value, g = new, v, h
        if done:
            break
    return x


class Likelihood:
    """Penalised conditional log-likelihood of token labels; parameters in one vector, features in use only."""

    def __init__(self, slots: np.ndarray, first: np.ndarray, y: np.ndarray, ridge: tuple[float, float] = (1e-2, 1e-1)):
        self.first, self.y = first, y.astype(float)
        self.used, own = np.unique(slots, return_inverse=True)
        self.own = np.asfortranarray(own.reshape(slots.shape))
        self.words, self.word = np.unique(slots[:, 0], return_inverse=True)
        inner = np.ones(len(y), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        self.inner = np.flatnonzero(inner)
        self.pairs = np.zeros((2, 2))
        k = y.astype(int)
        np.add.at(self.pairs, (k[self.inner - 1], k[self.inner]), 1)
        n, w = len(self.used), len(self.words)
        self.cuts = np.cumsum([n, w, w, 1])
        self.penalty = np.concatenate([np.full(n, ridge[0]), np.full(2 * w, ridge[1]), [0.0], np.full(4, ridge[0])])

    def start(self) -> np.ndarray:
        x = np.zeros(len(self.penalty))
        x[self.cuts[2]] = -3.0
        return x

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, self.cuts)

    def scores(self, x: np.ndarray) -> np.ndarray:
        weights, left, right, bias, _ = self.parts(x)
        score = sum((weights[column] for column in self.own.T), np.full(len(self.y), bias[0]))
        score[self.inner] += left[self.word[self.inner - 1]]
        score[self.inner - 1] += right[self.word[self.inner]]
        return score

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        score, t = self.scores(x), self.parts(x)[4].reshape(2, 2)
        p, pairs, log_z = marginals(score, self.first, t)
        value = float((self.y * score).sum() + (self.pairs * t).sum() - log_z - 0.5 * (self.penalty * x * x).sum())
        miss = self.y - p
        g = [
            sum(np.bincount(column, miss, len(self.used)) for column in self.own.T),
            np.bincount(self.word[self.inner - 1], miss[self.inner], len(self.words)),
            np.bincount(self.word[self.inner], miss[self.inner - 1], len(self.words)),
            [miss.sum()], (self.pairs - pairs).ravel(),
        ]
        return value, np.concatenate(g) - self.penalty * x

    def chain(self, x: np.ndarray) -> Chain:
        weights, left, right, bias, t = self.parts(x)
        full = np.zeros((3, SIZE))
        full[0, self.used], full[1, self.words], full[2, self.words] = weights, left, right
        return Chain(*full, float(bias[0]), t.reshape(2, 2))


def fit(column: pa.Array, toxic: np.ndarray, rounds: int = 100, tolerance: float = 1e-3, purity: float = SETTINGS[1][0], doubt: float = SETTINGS[1][1]) -> Chain:
    """The chain of greatest penalised likelihood, and the logistic fit of its evidence."""
    none = np.zeros(SIZE)
    if not len(toxic) or toxic.all() or not toxic.any():
        return Chain(none, none, none, -3.0, np.zeros((2, 2)), constant=float(toxic.mean()) if len(toxic) else 0.0)
    words = bw.split(lowered(column), bw.NOT_ALNUM)
    slots, first = features(words), words.first
    likelihood = Likelihood(slots, first, weak_labels(slots, words.doc, toxic, purity, doubt))
    chain = likelihood.chain(climbed(likelihood, likelihood.start(), rounds, tolerance))
    p, _, _ = marginals(emissions(chain, slots, first), first, chain.transitions)
    x = np.concatenate([evidence(p, words.first), np.ones((len(toxic), 1))], axis=1)
    weights, ridge = np.zeros(TOP + 1), np.array([0.1] * TOP + [0.01])
    for _ in range(50):  # Newton's method; a small ridge keeps separable labels finite
        q = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hess = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        weights += np.clip(np.linalg.solve(hess, x.T @ (toxic - q) - ridge * weights), -1, 1)
    chain.slopes, chain.offset = weights[:TOP], float(weights[TOP])
    return chain


def predicted(column: pa.Array, chain: Chain) -> np.ndarray:
    """The scores of whole texts."""
    if chain.constant is not None:
        return np.full(len(column), chain.constant)
    words = bw.split(lowered(column), bw.NOT_ALNUM)
    p, _, _ = marginals(emissions(chain, features(words), words.first), words.first, chain.transitions)
    return document_score(chain, p, words.first)


def loss(scores: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log loss of each score, bounded."""
    q = np.clip(scores, 1e-4, 1 - 1e-4)
    return -np.where(toxic, np.log(q), np.log1p(-q))


def validation(sample: DataFrame, settings: tuple[tuple[float, float], ...] = SETTINGS, parts: int = PARTS, **how) -> DataFrame:
    """(setting, part, n, loss) of a bounded sample (id, text, label): log loss summed over the part left out.

    Parts are dealt by a hash of the id; a group holds the sample once, as the final fit does.
    """
    trials = F.explode(F.array(*[F.struct(F.lit(i).alias("setting"), F.lit(k).alias("part")) for i in range(len(settings)) for k in range(parts)])).alias("trial")
    of = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(parts)).cast("int").alias("own")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        setting, part = table.column("setting")[0].as_py(), table.column("part")[0].as_py()
        text, toxic = table.column("text").combine_chunks(), table.column("label").to_numpy() > 0
        out = table.column("own").to_numpy() == part
        purity, doubt = settings[setting]
        chain = fit(text.filter(pa.array(~out)), toxic[~out], purity=purity, doubt=doubt, **how)
        lost = loss(predicted(text.filter(pa.array(out)), chain), toxic[out])
        return pa.table({"setting": [setting], "part": [part], "n": [len(lost)], "loss": [float(lost.sum())]})

    rows = sample.select("id", "text", "label", of, trials).select("id", "text", "label", "own", "trial.*")
    return rows.repartitionByRange(len(settings) * parts, "setting", "part").groupBy("setting", "part").applyInArrow(one, "setting long, part long, n long, loss double")


def chosen(sample: DataFrame, settings: tuple[tuple[float, float], ...] = SETTINGS, parts: int = PARTS, **how) -> tuple[float, float]:
    """The setting of least validated loss, the first of equal ones; the first too where the sample is empty."""
    if len(settings) == 1:
        return settings[0]
    sums = validation(sample, settings, parts, **how).groupBy("setting").agg(F.sum("loss").alias("loss")).collect()  # one row a setting
    return settings[min(((round(r["loss"], 6), r["setting"]) for r in sums), default=(0.0, 0))[1]]


def picked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 1500, max_bytes: int = 1 << 18, max_total: int = 1 << 24) -> DataFrame:
    """(id, text, label): a sample of labelled documents that is dealt by a hash of the id.

    Of each class about max_docs documents and half of max_total bytes at most, among
    those of at most max_bytes each.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("long").alias("label"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(size <= max_bytes)
    sizes = marks.join(own.select("id", size.alias("bytes")), "id").groupBy("label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()  # one row a class
    share = {int(r["label"]): min(1.0, max_docs / r["n"], max_total / 2 / max(1, r["bytes"])) for r in sizes}
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000))
    taken = reduce(lambda c, ks: F.when(F.col("label") == ks[0], part < int(1_000_000 * ks[1])).otherwise(c), share.items(), F.lit(False))
    # the picked labels, 2 * max_docs or so, go to the documents; texts don't move but for the sample
    return own.join(F.broadcast(marks.where(taken)), "id").select("id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 1500, max_bytes: int = 1 << 18, max_total: int = 1 << 24, settings: tuple[tuple[float, float], ...] = SETTINGS, **how) -> Chain:
    """Fit on a bounded sample (see picked) with the setting that cross-validation inside it prefers.

    The sample's texts alone meet in one task, in a number and size that the bounds
    keep small; documents are read in many.  labels must hold the rows to learn from
    and no other.
    """
    sample = stored(picked(docs, labels, id_col, text_col, label_col, max_docs, max_bytes, max_total), "sample")
    purity, doubt = chosen(sample, settings, **{"rounds": TRIAL_ROUNDS, **how})

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := list(batches)):
            return
        table = pa.Table.from_batches(got).sort_by("id").combine_chunks()
        chain = fit(table.column("text").combine_chunks(), table.column("label").to_numpy() > 0, purity=purity, doubt=doubt, **how)
        vectors = chain.weights, chain.left, chain.right
        used = [np.flatnonzero(v) for v in vectors]
        rest = [chain.bias, *chain.transitions.ravel(), *chain.slopes, chain.offset, np.nan if chain.constant is None else chain.constant]
        slot = np.concatenate([*(u + i * SIZE for i, u in enumerate(used)), 3 * SIZE + np.arange(len(rest))])
        value = np.concatenate([*(v[u] for v, u in zip(vectors, used)), rest])
        yield pa.RecordBatch.from_pydict({"slot": slot.astype(np.int64), "value": value})

    got = sample.repartition(1).mapInArrow(one, "slot long, value double").toPandas()  # of a bounded size: a model
    if not len(got):
        return fit(pa.array([], pa.string()), np.zeros(0, bool))
    flat = np.zeros(3 * SIZE + 7 + TOP)
    flat[got["slot"].to_numpy()] = got["value"].to_numpy()
    weights, left, right, rest = np.split(flat, [SIZE, 2 * SIZE, 3 * SIZE])
    return Chain(weights, left, right, float(rest[0]), rest[1:5].reshape(2, 2), rest[5:-2], float(rest[-2]), None if np.isnan(rest[-1]) else float(rest[-1]))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", likely: float = 0.5) -> DataFrame:
    """(id, score, n_toxic_tokens, spans): spans are (start, end) code points of runs of likely toxic tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # of a fixed size

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, "text", 1 << 20):
            column = lowered(batch.column(1))
            words = bw.split(column, bw.NOT_ALNUM)
            n = batch.num_rows
            if chain.constant is not None:
                p, value = np.zeros(len(words.start)), np.full(n, chain.constant)
            else:
                p, _, _ = marginals(emissions(chain, features(words), words.first), words.first, chain.transitions)
                value = document_score(chain, p, words.first)
            hit = np.flatnonzero(p > likely)
            spans: list[list[dict]] = [[] for _ in range(n)]
            count = np.zeros(n, np.int64)
            if len(hit):
                points = bw.code_points(words.data)
                doc = np.searchsorted(words.first, hit, "right") - 1
                count = np.bincount(doc, minlength=n)
                last = -2
                for w, d in zip(hit.tolist(), doc.tolist()):
                    s, e = (int(points[x[w]] - points[words.doc_at[d]]) for x in (words.start, words.end))
                    if w == last + 1 and spans[d]:
                        spans[d][-1]["end"] = e
                    else:
                        spans[d].append({"start": s, "end": e})
                    last = w
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64()), pa.array(count, pa.int64()), pa.array(spans, kind)], ["id", "score", "n_toxic_tokens", "spans"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(tag, f"id {own.schema['id'].dataType.simpleString()}, score double, n_toxic_tokens long, spans array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held: int = 2, threshold: float = 0.3, **how) -> DataFrame:
    """Train outside the held-out fold (crc32 of the id modulo folds) and score every document."""
    docs = only(docs, id_col, text_col)
    learn = only(labels, id_col, label_col).where(crc_remainder(id_col, folds) != held)
    scored = score(docs, train(docs, learn, id_col, text_col, label_col, **how), id_col, text_col)
    return scored.select(id_col, (crc_remainder(id_col, folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_toxic_tokens", "spans")
