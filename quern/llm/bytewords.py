"""Words, word hashes and rolling hashes of whole batches of text, on UTF-8 bytes.

Separators are ASCII, so no character is ever cut.  All work is on arrays: no
Python object is made for a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quern.llm.common import text_buffers

U = np.uint64
#: Words are runs of bytes other than space and x09 to x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: For matching regardless of punctuation: ASCII letters, digits and all other characters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASES = [int(x) | 1 for x in _rng.integers(2**60, 2**63, 12, dtype=np.uint64)]
_powers: dict[tuple[int, bool], np.ndarray] = {}
#: Bytes, or words of a rolling hash, that are hashed at once.  Tables of powers are kept for so many, eight bytes each, as long as a worker lives.
_CHUNK = 1 << 18


def _power(base: int, n: int, inverse: bool = False) -> np.ndarray:
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        factor = pow(base, -1, 2**64) if inverse else base
        have = np.full(size, U(factor))
        have[0] = 1
        have = _powers[base, inverse] = np.cumprod(have)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=out[1:])
    return out


@dataclass
class Words:
    data: np.ndarray  # bytes of all documents
    doc_at: np.ndarray  # where each document begins in data; one more at the end
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    first: np.ndarray  # first word of each document; one more at the end

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))

    @property
    def place(self) -> np.ndarray:
        """Of each word, within its document."""
        return (np.arange(len(self.start)) - np.repeat(self.first[:-1], np.diff(self.first))).astype(np.int32)

    def words_of(self, i: int) -> list[bytes]:
        raw = self.data.tobytes() if len(self.first) == 2 else self.data[self.doc_at[i] : self.doc_at[i + 1]].tobytes()
        a = slice(self.first[i], self.first[i + 1])
        base = int(self.doc_at[i])
        return [raw[s - base : e - base] for s, e in zip(self.start[a].tolist(), self.end[a].tolist())]


def split(column: pa.Array, separators: np.ndarray = SPACES) -> Words:
    data, at = text_buffers(column)
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(data, at, none, none, np.zeros(len(at), np.int64))
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    begins = at[:-1][at[:-1] < len(data)]
    before[begins] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[begins[begins > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], seed: int = 0) -> list[np.ndarray]:
    """64-bit hashes of parts of words; start and end give the words, in ascending order.

    Each part is (start, end) of a span within each word; running sums of the
    bytes are made once for all parts.
    """
    base, out = _BASES[seed], [np.empty(len(start), np.uint64) for _ in parts]
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + _CHUNK)))
        low, high = int(start[i]), int(end[j - 1])
        sums, back = _sums(_BYTE[data[low:high]], base), _power(base, high - low + 1, True)
        for (s, e), found in zip(parts, out):
            a, b = s[i:j] - low, e[i:j] - low
            found[i:j] = mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        i = j
    return out


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    return span_hashes(data, start, end, [(start, end)], seed)[0]


def rolling(hashes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of n values; the last n - 1 values begin none."""
    count = len(hashes) - n + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    base, out, step = _BASES[seed], np.empty(count, np.uint64), max(n, _CHUNK - n + 1)
    for i in range(0, count, step):
        part = hashes[i : i + step + n - 1]
        sums = _sums(part, base)
        out[i : i + step] = mixed((sums[n:] - sums[:-n]) * _power(base, len(part), True)[: len(part) - n + 1])
    return out


def within(first: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each word on lie in one document; for words that rolling() covers."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))[: total - n + 1]
    return np.arange(total - n + 1) + n <= last


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of characters before each byte; one more at the end."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
