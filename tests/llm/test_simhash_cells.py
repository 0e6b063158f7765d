"""Candidates of the near-duplicates stage come by SimHash: codes, cells and pairs against plain versions."""

import random

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
from quern.llm import nearcopies  # noqa: E402
from test_nearcopies import near_texts, plain_set, stage  # noqa: E402


def apart(a, b):
    return sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b))


def test_codes_are_majorities_of_the_distinct_shingles():
    own = nearcopies.shingles(b" ".join(b"w%d" % (i * i % 97) for i in range(300)))
    votes = [0] * 64 * nearcopies.WORDS
    for h in own:
        bits = np.unpackbits(nearcopies.mixed(np.array([h]) ^ nearcopies._SEEDS).view(np.uint8))
        votes = [v + (1 if b else -1) for v, b in zip(votes, bits.tolist())]
    assert np.unpackbits(nearcopies.code(own).view(np.uint8)).tolist() == [int(v > 0) for v in votes]
    assert len(nearcopies.code(own[:0])) == 0


def test_grid_grows_with_the_table():
    assert [nearcopies.grid(n, 0.8).shape for n in (0, 10_000, 200_000)] == [(42, 3), (42, 3), (125, 6)]
    assert all(len(set(segments)) == 6 and max(segments) < 256 for segments in nearcopies.grid(200_000, 0.8).tolist())


def met(spark, texts):
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    codes = [nearcopies.code(s) for s in sets]
    nodes = spark.createDataFrame([(i, c.view(np.int64).tolist()) for i, c in enumerate(codes)], "node long, code array<long>").repartition(3)
    rows = nearcopies.candidates(nodes, 0.8).collect()
    dense = {}
    for r in rows:
        if r["v"] is None:
            dense.setdefault(r["cell"], set()).add(r["u"])
    return codes, {(r["u"], r["v"]) for r in rows if r["v"] is not None}, dense


@pytest.mark.parametrize("groups, copies", [(14, 10), (2, 70)])
def test_every_similar_pair_meets_by_its_code(spark, groups, copies):
    texts = near_texts(5, groups, copies)
    codes, pairs, dense = met(spark, texts)
    plain = [plain_set(t) for t in texts]
    assert pairs and all(u < v and apart(codes[u][: nearcopies.TESTED], codes[v][: nearcopies.TESTED]) <= nearcopies.RADIUS for u, v in pairs)
    assert bool(dense) == (copies > 20)
    for j in range(len(texts)):
        for i in range(j):
            if plain[i] != plain[j] and 10 * len(plain[i] & plain[j]) >= 8 * len(plain[i] | plain[j]):
                assert (i, j) in pairs or any({i, j} <= m for m in dense.values())


def test_cells_beyond_the_giant_size_lose_no_member(monkeypatch):
    r = np.random.default_rng(3)
    codes = np.repeat(r.integers(0, 2**64, (30, nearcopies.TESTED), np.uint64), 4, axis=0)
    pairs, left = nearcopies.near_in(codes)
    assert sorted((int(a), int(b)) for u, v in pairs for a, b in zip(u, v)) == [(4 * g + i, 4 * g + j) for g in range(30) for i in range(4) for j in range(i + 1, 4)] and not len(left)
    monkeypatch.setattr(nearcopies, "_GIANT", 10)
    stars, left = nearcopies.near_in(codes)
    assert left.tolist() == list(range(120)) and sum(len(u) for u, _ in stars) == 90


def test_stage_searches_by_codes(spark, monkeypatch):
    """Codes that tell nothing leave every copy in place: no other search stands beside them."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:k] + [f"x{r.random()}"] + base[k + 1 :]) for k in range(20, 180, 40)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    assert stage(spark, docs).count() == 1
    monkeypatch.setattr(nearcopies, "candidates", lambda nodes, least: nearcopies.spark_none(nodes), raising=True)
    monkeypatch.setattr(nearcopies, "spark_none", lambda nodes: nodes.sparkSession.createDataFrame([], "cell long, u long, v long"), raising=False)
    assert stage(spark, docs).count() == len(texts)
