"""Spelling variants: words one edit apart, found by an index of grams of variable length.

Words are padded at both ends.  A gram of `short` characters is always usable; a
longer one is in the dictionary if the gram before its last character is frequent
and it is not rare itself, so frequent grams split up and rare ones stay short.  A
word decomposes into the longest grams of the dictionary at each place, without
those inside an earlier one.

One edit spoils some grams of a word: those over the edited character, those on
the left that may now grow over it, with all that such a one would swallow, and
those on the right that a gram over the edit may swallow.  The largest number over
all places bounds what an edit can cost, so two words one edit apart share, at
places that correspond, at least (number of grams - bound) grams of either.  If
both list their grams in one order, rarest first, they share one of the first
bound + 1.  Only these are listed and met, by gram, place and length.  Of the pairs
that meet those go whose sets of letters differ in more than an edit can change; the
others are verified.

The padding leaves at least one gram out of reach of every edit of a word of at
least long - short + 2 characters, so no pair is lost and no word needs another way.

The gram dictionary has at most 1 / `share` grams of each length, for a gram of it
makes up at least that share of all; its size is thus bounded, whatever the number
of words.

Defined results: a null or empty text has no words; a null id counts as the empty
text; an id that occurs twice is no problem; repeated rows count each; an empty
table, or one without words frequent enough, gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import only, slices, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Characters of a text that are split at once, and distinct strings counted in a task before they are sent on.
CHUNK, HELD = 1 << 20, 1 << 16
BEFORE, AFTER = "\x01", "\x02"


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, in lists of bounded length."""
    begin = 0
    while begin < len(text):
        end = min(begin + CHUNK, len(text))
        rest = RUN.match(text, end)
        end = rest.end() if rest else end
        yield RUN.findall(text, begin, end)
        begin = end


def count_words(key: str, text: str, into: Counter, every: int, least: int) -> None:
    """Adds a document's words: its runs, lower-cased, a few of them with one character less."""
    found: Counter = Counter()
    for some in runs(text):
        found.update(some)
    for run, n in found.items():
        word = run.lower() if run.isascii() else run.translate(_LOWER)
        h = zlib.crc32(f"{key}:{word}".encode())
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            into[word] += n


def counted(rows: DataFrame, name: str, add: Callable[[pa.RecordBatch, Counter], None], cut: Callable[[Iterator], Iterator] = iter) -> DataFrame:
    """(name, n): the sums of what add() counts, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in cut(batches):
            add(batch, held)
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], [name, "n"])
                held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], [name, "n"])

    return rows.mapInArrow(run, f"{name} string, n long").groupBy(name).agg(F.sum("n").alias("n"))


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, least: int = 5, times: int = 3) -> DataFrame:
    """(word, n): words of at least so many characters and occurrences."""
    own = only(docs, id_col, text_col).select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")

    def add(batch: pa.RecordBatch, into: Counter) -> None:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            count_words(key, text, into, every, least)

    return counted(own, "word", add, lambda batches: slices(batches, "text")).where(F.col("n") >= times)


class Grams:
    """The dictionary: grams by number, and what follows from it for a word."""

    def __init__(self, often: dict[str, int], short: int, long: int, frequent: int):
        self.short, self.long, self.often = short, long, often
        self.kept = {g for g in often if len(g) > short and often.get(g[:-1], 0) > frequent}
        #: Beginnings that a gram may go on from, and endings that one may come to, both of at least `short` characters.
        self.grows = {g[:i] for g in self.kept for i in range(short, len(g))}
        self.tails = {g[i:] for g in self.kept for i in range(1, len(g) - short + 1)}

    def padded(self, word: str) -> str:
        return BEFORE * (self.long - 1) + word + AFTER * (self.long - 1)

    def decomposed(self, text: str) -> list[tuple[int, int]]:
        """(begin, end) of the grams of a padded word."""
        out, reach = [], 0
        for begin in range(len(text) - self.short + 1):
            end = begin + self.short
            while end < min(begin + self.long, len(text)) and text[begin : end + 1] in self.kept:
                end += 1
            if end > reach:
                out.append((begin, end))
                reach = end
        return out

    def bound(self, text: str, grams: list[tuple[int, int]]) -> int:
        """How many of its grams one edit can spoil at most.

        An insertion spoils no more than a replacement of the character after it.
        """
        pad, most, first = self.long - 1, 0, 0
        for at in range(pad, len(text) - pad + 1):
            while first < len(grams) and grams[first][0] < at - self.long + 1:
                first += 1
            grown = next((p for p in range(max(0, at - self.long + 1), at - self.short + 1) if text[p:at] in self.grows), at)
            n = 0
            for begin, end in grams[first : first + 2 * self.long]:
                if begin >= at + self.long:
                    break
                if begin <= at:
                    n += at < end or begin >= grown
                else:
                    n += end <= at + self.long and text[at + 1 : end] in self.tails
            most = max(most, n)
        return most

    def listed(self, word: str) -> list[tuple[str, int]]:
        """(gram, begin) of those under which a word is listed: its rarest, one more than an edit can spoil."""
        text = self.padded(word)
        grams = self.decomposed(text)
        order = sorted((self.often.get(text[b:e], 0), text[b:e], b) for b, e in grams)
        return [(g, b) for _, g, b in order[: self.bound(text, grams) + 1]]


def letters(word: str) -> int:
    """Which characters a word has, by their numbers modulo 63: an edit changes two bits at most."""
    out = 0
    for c in set(word):
        out |= 1 << ord(c) % 63
    return out


def dictionary(words: DataFrame, short: int, long: int, frequent: int, share: float) -> Grams:
    """Counts of all grams of the words that make up at least `share` of those of their length."""
    pad = long - 1

    def add(batch: pa.RecordBatch, into: Counter) -> None:
        for word in batch.column(0).to_pylist():
            text = BEFORE * pad + word + AFTER * pad
            for size in range(short, long + 1):
                into.update([text[i : i + size] for i in range(len(text) - size + 1)])

    whole = words.agg(F.sum(F.char_length("word") + 2 * pad - short + 1)).first()[0] or 0
    found = counted(words.select("word"), "gram", add).where(F.col("n") >= max(2, whole * share))
    return Grams({r["gram"]: r["n"] for r in found.collect()}, short, long, frequent)  # at most 1 / share of each length


def near_pairs(words: DataFrame, short: int = 2, long: int = 4, frequent: int = 32, share: float = 1 / 65536, least: int = 5) -> DataFrame:
    """(word, n, other, other_n): each pair of words one edit apart once, word the longer, or the later of two as long."""
    if not 1 <= short <= long or least < long - short + 2:
        raise ValueError("words must have at least long - short + 2 characters")
    context = words.sparkSession.sparkContext
    sent = context.broadcast(dictionary(words, short, long, frequent, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(g, b, len(w), w, n, letters(w)) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for g, b in sent.value.listed(w)]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["gram", "place", "size", "word", "n", "letters"])

    lists = stored(words.select("word", "n").mapInArrow(run, "gram string, place int, size int, word string, n long, letters long"), "grams")
    sent.unpersist()
    # a gram before the edit is as far from the front in both words, one after it as far from the end
    other = lists.select("gram", "place", "size", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("letters").alias("other_letters"))
    asked = lists.select(
        "gram", "word", "n", "letters", F.inline(F.array(*[F.struct((F.col("place") - back).alias("place"), (F.col("size") - less).alias("size"), F.lit(less == 0).alias("level")) for back, less in ((0, 0), (0, 1), (1, 1))])),
    )
    one_edit = (F.bit_count(F.col("letters").bitwiseXOR(F.col("other_letters"))) <= 2) & (F.levenshtein("word", "other", 1) == 1)
    return asked.join(other, ["gram", "place", "size"]).where((~F.col("level") | (F.col("word") > F.col("other"))) & one_edit).select("word", "n", "other", "other_n").distinct()


def last_of(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain word, form, form's form, ... ends.  Each round doubles the steps taken."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if at.join(step, "root", "left_semi").isEmpty():
            return at
        at = stored(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, least: int = 5, times: int = 3, factor: int = 2, **grams) -> DataFrame:
    """One row a word: its near words, the form it is a variant of, and the root of its forms."""
    words = stored(words_of(docs, id_col, text_col, every, least, times), "words")
    pairs = stored(near_pairs(words, least=least, **grams), "pairs")
    both = pairs.select("word", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = stored(
        words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= factor * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f")).select("word", "n", "n_near", "f.form", "f.form_n"), "forms",
    )
    roots = last_of(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
