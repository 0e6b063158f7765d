"""Greedy tiles of repetitive texts: the bounded way against the plain one."""

import random
import resource

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import decontam


def plain(doc, item, least):
    pairs = [(i, j) for i in range(len(doc) - least + 1) for j in range(len(item) - least + 1) if (doc[i : i + least] == item[j : j + least]).all()]
    return decontam.tiles(*np.array(pairs, np.int64).T, least) if pairs else []


@pytest.mark.parametrize("most", [1, 3, 20, 1 << 20])
def test_bounded_tiles_equal_plain_tiles(most):
    r, hashes = random.Random(most), np.random.default_rng(1).integers(1, 2**63, 9, dtype=np.uint64)
    for t in range(150):
        k, least = r.choice([1, 2, 2, 3, 5]), r.choice([1, 2, 3, 5])
        doc, item = hashes[[r.randrange(k) for _ in range(r.randrange(1, 50))]], hashes[[r.randrange(k) for _ in range(r.randrange(1, 25))]]
        if t % 5 == 0:
            doc, item = np.tile(doc[:3], 12), np.tile(item[:2], 7)
        assert decontam.bounded_tiles(doc, item, least, most) == plain(doc, item, least)


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_matches_do_not_depend_on_the_bound(most):
    r = random.Random(5)
    text = lambda n, k: " ".join(r.choice("abcdefgh"[:k]) for _ in range(n))
    benchmark = pa.array([text(12, 2), text(30, 8), "a " * 9, "", None, "a b c d e f g"])
    docs = pa.array([text(80, 2), text(200, 8), None, "", "a " * 50, "x a b c d e f g y", "b " * 40])
    items = decontam.index_of(list(range(6)), benchmark, 5)
    assert sorted(decontam.matches(items, docs, 5, 0.3, most)) == sorted(decontam.matches(items, docs, 5, 0.3, 10**9))


def test_very_many_equal_words_take_little_memory():
    items = decontam.index_of([0, 1], pa.array(["w " * 5000, "a b c d e f g"]), 5)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert decontam.matches(items, pa.array(["x y", "w " * 200_000, None, "a b c d e f"]), 5, 0.5) == [(1, 0, 1.0, 1, 5000), (3, 1, 6 / 7, 1, 6)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_packing_of_equal_documents_has_no_cap():
    """300 equal documents of half a window: blocks of two documents each, none of which shares a cut with the next."""
    from quern.llm import packing
    from quern.llm.queries import tokenizer

    stream = packing.Stream(packing.encoder_of(**tokenizer()), 1024, 4.0, 12.0, 32, 0)
    doc, out = np.append(np.full(511, 64, np.uint32), np.uint32(packing.END)), []
    for i in range(0, 300, 2):
        out += list(stream.take([(i, doc), (i + 1, doc)], False))
    out += list(stream.take([], True))
    sequences = np.concatenate([x[5] for x in out])
    assert len(sequences) == 300 and len(set(sequences.tolist())) == 150
