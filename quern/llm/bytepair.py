"""Byte-pair encoding without merging: the last token of every prefix, and back.

Of each prefix of a word exactly one token can be the last of its encoding.  It is
the token t that ends there and may follow the last token of the prefix before t.
An automaton over all tokens, with suffix links, finds the tokens that end at each
byte; whether two tokens may stand side by side is decided on the pair alone; the
back-pointers from the last prefix then are the encoding.  The work is linear in a
word's length, whatever it repeats.

Two tokens stay apart if no merge across their border comes before the merges that
made them.  Going back in time from the pair, the later of the two parts at the
border is taken apart; at each moment the pair at the border may have no merge that
is due before either of them is used up.  Of equal merges the left one comes first.

A worker encodes each word once and keeps it; beyond a bound in words or characters
it keeps the most used half.

Defined results: a null or empty text has no ids and decodes to an empty text; ids
that the vocabulary lacks, null ones too, are passed over in decoding, and bytes
that are no UTF-8 become U+FFFD; repeated rows are each encoded; further columns
stay, and one of the result's name is replaced.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.common import SLICE_BYTES, slices

NEVER = 1 << 62
#: Words, their characters, and pairs of tokens that a worker keeps between batches.
KEPT_WORDS, KEPT_CHARS, KEPT_PAIRS = 1 << 19, 1 << 23, 1 << 19
#: Characters that are split into words at once.
CHUNK = 1 << 19


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    printable = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Characters unknown to Python's Unicode tables: pattern libraries of other versions may class them differently."""
    runs, begin = [], None
    for c in range(sys.maxunicode + 2):
        new = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if new and begin is None:
            begin = c
        elif not new and begin is not None:
            runs.append(f"\\U{begin:08X}-\\U{c - 1:08X}")
            begin = None
    return re.compile("[" + "".join(runs) + "]")


_RARE = re.compile("[^\0-ԯḀ-ỿ‐-‧　-ヿ一-鿿가-힣]")
_BREAK = re.compile(r"(?<=\S)[ \n]")


class Vocabulary:
    """A byte-level byte-pair tokenizer file, ready for the dynamic programme.

    The method asks that every token has one merge, later than those of its parts.
    """

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            parts = json.load(f)
        model, splitter = parts["model"], parts["pre_tokenizer"]
        if model["type"] != "BPE" or splitter["type"] != "ByteLevel" or splitter["add_prefix_space"] or not splitter["use_regex"] or parts["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{file}: not a plain byte-level byte-pair tokenizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in parts["added_tokens"]):
            raise ValueError(f"{file}: added tokens with conditions are not supported")
        self.file, alphabet, ids = file, byte_alphabet(), model["vocab"]
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        n = max([*ids.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for token, i in ids.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        #: When a token is merged (bytes: before all merges), from which two, and the time of each pair's merge.
        self.time, self.left, self.right, self.merges = [-1] * n, [-1] * n, [-1] * n, {}
        for when, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = ids[a], ids[b], ids[a + b]
            if self.time[z] >= 0 or max(self.time[x], self.time[y]) >= when:
                raise ValueError(f"{file}: token {z} has two merges, or one before its parts")
            self.time[z], self.left[z], self.right[z] = when, x, y
            self.merges[x << 32 | y] = when
        import ahocorasick
        import regex

        self.sizes = [len(b) for b in self.bytes]
        self.automaton = ahocorasick.Automaton()
        for i in ids.values():
            self.automaton.add_word(self.bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        # fixed values: the pattern of byte-level tokenizers
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.alphabet, self.library = alphabet, None
        self.token_data = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.pairs: dict[int, bool] = {}  # what apart() said of a << 32 | b

    def apart(self, a: int, b: int) -> bool:
        """Whether tokens a and b may stand side by side."""
        time, merges, a_used, b_used = self.time, self.merges, NEVER, NEVER
        while True:
            due = merges.get(a << 32 | b, NEVER)
            if due < a_used and due <= b_used and due < NEVER:
                return False
            if time[a] > time[b]:
                a_used, a = time[a], self.right[a]
            elif time[b] >= 0:
                b_used, b = time[b], self.left[b]
            else:
                return True

    def word(self, raw: bytes) -> list[int]:
        """Ids of one word: the last token of each prefix, then the way back."""
        last, sizes, pairs = [-1] * len(raw), self.sizes, self.pairs
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            if last[end] < 0:
                before = end - sizes[token]
                if before < 0:
                    last[end] = token
                    continue
                key = last[before] << 32 | token
                fine = pairs.get(key)
                if fine is None:
                    fine = pairs[key] = self.apart(last[before], token)
                if fine:
                    last[end] = token
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        out, end = [], len(raw) - 1
        while end >= 0:
            out.append(last[end])
            end -= sizes[last[end]]
        return out[::-1]

    def split(self, text: str) -> Iterator[list[str]]:
        """The words of a text without added tokens, in lists of bounded length.

        Between a character and white space after it there is always a border.
        """
        if not text.isascii() and _RARE.search(text) and unassigned().search(text):
            yield self._library_words(text)
            return
        begin = 0
        while begin < len(text):
            found = _BREAK.search(text, begin + CHUNK) if begin + CHUNK < len(text) else None
            end = found.start() if found else len(text)
            yield self.words(text[begin:end] if begin or found else text)
            begin = end

    def _library_words(self, text: str) -> list[str]:
        """Words by the tokenizer library's own Unicode tables."""
        if self.library is None:
            from tokenizers import pre_tokenizers

            self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [bytes(self.alphabet[c] for c in w).decode() for w, _ in self.library.pre_tokenize_str(text)]


class Encoder(dict):
    """Code numbers of words; the ids of each word stand in one flat array."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.flat, self.at, self.chars, self.used = vocabulary, array("i"), array("q", [0]), 0, np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        own = self.vocabulary
        code = self[word] = len(self.at) - 1
        self.flat.extend([own.added[word]] if word in own.added else own.word(word.encode()))
        self.at.append(len(self.flat))
        self.chars += len(word)
        return code

    def halve(self) -> None:
        """Keeps the words used most, in half the bounds."""
        ids, at = np.array(self.flat, np.int32), np.array(self.at, np.int64)
        words = list(self)  # in the order of their codes
        order = np.argsort(-self.used, kind="stable")[: KEPT_WORDS // 2]
        chars = np.cumsum([len(words[c]) for c in order])
        order = order[chars <= KEPT_CHARS // 2]
        self.clear()
        self.update((words[c], k) for k, c in enumerate(order.tolist()))
        self.flat, self.at = array("i", ragged(ids, at, order).tobytes()), array("q", np.cumsum([0, *(at[order + 1] - at[order])]).astype(np.int64).tobytes())
        self.used, self.chars = self.used[order] // 2, int(chars[len(order) - 1]) if len(order) else 0

    def _codes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def _text(self, text: str) -> Iterator[np.ndarray]:
        own, begin = self.vocabulary, 0
        for found in own.specials.finditer(text) if own.specials else ():
            yield from map(self._codes, own.split(text[begin : found.start()]))
            yield self._codes([found[0]])
            begin = found.end()
        yield from map(self._codes, own.split(text[begin:] if begin else text))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin in them (one more at the end)."""
        none = np.zeros(0, np.int32)
        rows = [np.concatenate([none, *self._text(t)]) for t in texts]
        codes, words = np.concatenate([none, *rows]), np.cumsum([0, *map(len, rows)])
        flat, at = np.array(self.flat, np.int32), np.array(self.at, np.int64)
        before = np.concatenate([[0], np.cumsum(at[codes + 1] - at[codes])])
        out = ragged(flat, at, codes), before[words]
        self.used = np.bincount(codes, minlength=len(at) - 1) + np.pad(self.used, (0, len(at) - 1 - len(self.used)))
        if len(self) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.halve()
        return out


def ragged(data: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows' stretches of data, one after the other."""
    begin = at[rows]
    size = at[rows + 1] - begin
    until = np.cumsum(size)
    return data[np.arange(until[-1] if len(until) else 0) + np.repeat(begin - until + size, size)]


@lru_cache(maxsize=2)
def vocabulary_of(file: str) -> Vocabulary:
    """One for each worker: it outlives the task."""
    return Vocabulary(file)


@lru_cache(maxsize=2)
def encoder_of(file: str) -> Encoder:
    return Encoder(vocabulary_of(file))


def _adding(docs: DataFrame, into: str, kind: T.DataType, values: Callable[[pa.RecordBatch], pa.Array], cut: Callable[[Iterator], Iterator]) -> DataFrame:
    others = [f for f in docs.schema.fields if f.name != into]
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            stay = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != into]
            yield pa.RecordBatch.from_arrays([*stay, values(batch)], [*names, into])

    return docs.mapInArrow(run, T.StructType([*others, T.StructField(into, kind)]))


def encode(docs: DataFrame, tokenizer_file: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """docs with a column of token ids."""
    place = docs.columns.index(text_col)

    def values(batch: pa.RecordBatch) -> pa.Array:
        ids, at = encoder_of(tokenizer_file).ids([t or "" for t in batch.column(place).to_pylist()])
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))

    return _adding(docs, into, T.ArrayType(T.IntegerType()), values, lambda batches: slices(batches, text_col))


def decode(tokens: DataFrame, tokenizer_file: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """tokens with the text of each row's ids."""
    place = tokens.columns.index(ids_col)

    def values(batch: pa.RecordBatch) -> pa.Array:
        own = vocabulary_of(tokenizer_file)
        texts = []
        for ids in batch.column(place):
            flat = (ids.values if ids.is_valid else pa.array([], pa.int32())).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            known = flat[(flat >= 0) & (flat < len(own.sizes))]
            texts.append(ragged(own.token_data, own.token_at, known).tobytes().decode("utf-8", "replace"))
        return pa.array(texts, pa.string())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At most so many ids at once, or one row."""
        for batch in batches:
            sizes = np.array([len(x) if x.is_valid else 0 for x in batch.column(place)])
            begin = 0
            while begin < batch.num_rows:
                end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), SLICE_BYTES // 4, "right")))
                yield batch.slice(begin, end - begin)
                begin = end

    return _adding(tokens, into, T.StringType(), values, cut)
