"""The ways of a power of two that the cutter looks up in bulk, against plain ones."""

import random

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
from quern.llm import packing  # noqa: E402


@pytest.mark.parametrize("length", [1, 2, 16, 100])
def test_exact_ways_over_several_calls(length):
    r = random.Random(length)
    cutter, ends = packing.Cutter(length), [0]
    for _ in range(6):
        more = []
        for _ in range(r.randrange(60)):
            more.append((more or ends)[-1] + r.randint(1, length))
        which, shorts = cutter.exact(np.array(more, np.int64))
        every = ends + more
        assert list(zip(which.tolist(), shorts.tolist())) == [(k, every.index(e - p)) for k, e in enumerate(more) for p in cutter.powers if e - p in every]
        cutter.add(more, [r.choice([0.0, 4.0]) for _ in more])
        ends = every
        assert list(cutter.e) == every and len(cutter.cost) == len(cutter.back) == len(every)
