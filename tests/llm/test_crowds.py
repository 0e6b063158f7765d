"""Cells in two steps: whole codes move in the same number of tables, crowds give few pairs, and none of both loses a link."""

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
from quern.llm import nearcopies  # noqa: E402
from test_nearcopies import plain_kept, stage  # noqa: E402


def near_codes(copies, flips, seed=1):
    """Codes that differ from one in so many bits each, and as many that have nothing to do with it."""
    r = np.random.default_rng(seed)
    bits = np.tile(r.integers(0, 2, 64 * nearcopies.WORDS, np.uint8), (copies, 1))
    for row in bits:
        row[r.choice(len(row), flips, replace=False)] ^= 1
    return np.concatenate([np.packbits(bits, axis=1).view(np.uint64), r.integers(0, 2**64, (copies, nearcopies.WORDS), np.uint64)])


def found(spark, codes):
    nodes = spark.createDataFrame([(i, c.view(np.int64).tolist()) for i, c in enumerate(codes)], "node long, code array<long>").repartition(3)
    return nearcopies.candidates(nodes, 0.8)


def test_rows_moved_grow_with_the_table_alone():
    tables = [nearcopies.grid(n // nearcopies._WIDE, 0.8) for n in (40_000, 200_000, 10_000_000)]
    assert {t.shape for t in tables} == {(42, 3)}
    fine = nearcopies.finer(200_000, 0.8, tables[1])
    assert fine.shape[0] == 42 and all(len({*own.tolist(), *draw.tolist()}) == 3 + fine.shape[2] for own, draws in zip(tables[1], fine) for draw in draws)


def test_pairs_of_a_crowd_grow_with_its_size(spark):
    """A class of 600 has 179,700 pairs; each member is found, and links to few others."""
    rows = found(spark, near_codes(600, 20)).distinct().collect()
    assert {r["u"] for r in rows if r["v"] is None} == set(range(600))
    assert 599 <= sum(r["v"] is not None for r in rows) < 30 * 600
    assert sum(r["v"] is None for r in rows) <= 42 * 2 * 600


def test_finer_cells_lose_no_pair(spark):
    """Pairs of codes as far apart as texts of similarity 0.8, in cells too large to be compared as they are."""
    codes = near_codes(4000, 0)[4000:]
    r = np.random.default_rng(4)
    bits = np.unpackbits(codes.view(np.uint8), axis=1)
    for row in bits:
        row[r.choice(len(row), 78, replace=False)] ^= 1
    both = np.concatenate([codes, np.packbits(bits, axis=1).view(np.uint64)])
    near = np.bitwise_count(both[:4000, : nearcopies.TESTED] ^ both[4000:, : nearcopies.TESTED]).sum(axis=1) <= nearcopies.RADIUS
    got = {(x["u"], x["v"]) for x in found(spark, both).collect() if x["v"] is not None}
    assert got == {(i, 4000 + i) for i in np.flatnonzero(near).tolist()}


def test_a_crowd_of_several_classes_equals_brute_force(spark):
    """Texts that share much, of which only some are similar enough: exact links don't join the crowd into one class."""
    r = np.random.default_rng(6)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(90):
        own = list(base)
        for at in r.choice(120, r.integers(0, 7), replace=False).tolist():
            own[at] = f"n{r.integers(0, 10**9)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(k for _, k, _ in plain_kept(rows))
    assert 1 < len(want) < 90
    assert sorted(x["doc_id"] for x in stage(spark, docs).collect()) == want
