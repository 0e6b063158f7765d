"""Names in texts: all of a list at once, by an automaton instead of one pattern a pair.

The names, without case, stand in automata of bounded size that go to every task; a
list that is too long for one is cut into several, and the texts are read once for
each.  A name counts anywhere, where a word begins, whatever follows it, or only as a
whole word.  Matches that share characters with a longer one of the same text, or
with an earlier one as long, may be left out: longest name first.

Defined results: a null or empty text holds nothing; null and empty names are left
out; names that differ in case only are each found; repeated rows are each searched;
an empty list or table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of an automaton and their characters; an automaton of these takes some ten megabytes.
NAMES, CHARS = 1 << 16, 1 << 20
#: Characters of text that a task searches at once.
FOUND = 1 << 14


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def occurrences(automaton, text: str, bounds: str) -> list[tuple[int, int, list[str]]]:
    """(begin, end, names) of the names in a lower-case text."""
    out = []
    for last, (size, names) in automaton.iter(text):
        begin, end = last + 1 - size, last + 1
        if bounds != "anywhere" and begin and _word(text[begin - 1]) or bounds == "whole" and end < len(text) and _word(text[end]):
            continue
        out.append((begin, end, names))
    return out


def longest_first(found: list[tuple[int, int, list[str]]]) -> list[tuple[int, int, list[str]]]:
    """Those that share no character with a longer one, or with one as long before it."""
    begins: list[int] = []  # of those taken, ascending
    out: dict[int, tuple[int, int, list[str]]] = {}
    for one in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
        begin, end, _ = one
        at = bisect_left(begins, begin)
        if (at == len(begins) or end <= begins[at]) and (at == 0 or out[begins[at - 1]][1] <= begin):
            begins.insert(at, begin)
            out[begin] = one
    return [out[b] for b in begins]


def _automaton(names: list[str]):
    import ahocorasick

    spelled: dict[str, list[str]] = {}
    for name in names:
        spelled.setdefault(name.lower(), []).append(name)
    found = ahocorasick.Automaton()
    for low, same in spelled.items():
        found.add_word(low, (len(low), same))
    found.make_automaton()
    return found


def _parts(names: DataFrame, name_col: str) -> Iterator[list[str]]:
    """The distinct names in lists of bounded size, which reach the driver one after the other."""
    held, chars = [], 0
    for r in names.select(F.col(name_col).alias("name")).where("name IS NOT NULL AND name <> ''").distinct().toLocalIterator():
        held.append(r["name"])
        chars += len(r["name"])
        if len(held) >= NAMES or chars >= CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def find(texts: DataFrame, names: DataFrame, text_col: str, name_col: str, key: tuple[str, ...], bounds: str = "start", longest: bool = False) -> DataFrame:
    """(key, name, begin, end) of each occurrence; begin and end count characters of the lower-case text.

    bounds is "anywhere", "start" (of a word) or "whole" (words).  longest needs all
    names in one automaton, so that a longer one is known.
    """
    if bounds not in ("anywhere", "start", "whole"):
        raise ValueError(f"bounds: {bounds}")
    kinds = [f"{c} {texts.schema[c].dataType.simpleString()}" for c in key]
    schema, columns = ", ".join([*kinds, "name string", "begin int", "end int"]), [*key, "name", "begin", "end"]
    own = texts.select(*key, F.col(text_col).alias("searched text")).where("`searched text` IS NOT NULL")
    parts = list(_parts(names, name_col))
    if longest and len(parts) > 1:
        raise ValueError(f"longest name first: more than {NAMES} names or {CHARS} characters")
    out = texts.sparkSession.createDataFrame([], schema)
    for part in parts:
        sent = texts.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent.value)
            for batch in batches:
                rows, met = [], []
                for i, text in enumerate(batch.column(len(key)).to_pylist()):
                    found = occurrences(automaton, text.lower(), bounds)
                    for begin, end, same in longest_first(found) if longest else found:
                        met += [(name, begin, end) for name in same]
                        rows += [i] * len(same)
                    if len(rows) >= FOUND or i == batch.num_rows - 1:
                        at = pa.array(rows, pa.int64())
                        arrays = [pa.array([m[k] for m in met], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(key))), *arrays], columns)
                        rows, met = [], []

        found = own.mapInArrow(run, schema)
        out = found if part is parts[0] else out.unionByName(found)
    return out
