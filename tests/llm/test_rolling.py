"""Rolling hashes in pieces: the same values, and tables of powers that stay small."""

import numpy as np
import pytest

pytest.importorskip("quern.llm")
from quern.llm import bytewords as bw  # noqa: E402


@pytest.mark.parametrize("n", [1, 10, 20, 700])
def test_pieces_give_the_values_of_the_whole(monkeypatch, n):
    values = np.random.default_rng(n).integers(0, 2**64, 5000, np.uint64)
    whole = bw.rolling(values, n)
    base = bw._BASES[1]
    plain = [sum(int(values[i + k]) * pow(base, k, 2**64) for k in range(n)) % 2**64 for i in (0, 1, 999, 5000 - n)]
    assert bw.mixed(np.array(plain, np.uint64)).tolist() == whole[[0, 1, 999, 5000 - n]].tolist()
    monkeypatch.setattr(bw, "_CHUNK", 1000)
    assert (bw.rolling(values, n) == whole).all() and len(whole) == 5001 - n


def test_tables_of_powers_stay_small(monkeypatch):
    monkeypatch.setattr(bw, "_powers", {})
    assert len(bw.rolling(np.ones(1_000_000, np.uint64), 20)) == 999_981
    assert max(map(len, bw._powers.values())) <= bw._CHUNK
