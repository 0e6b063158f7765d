"""Text functions as column expressions; Python only where no built-in has the semantics."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.profile import MACEDONIAN, Profile

TOKEN = "[0-9A-Za-zЀ-ӿ]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, use) -> Column:
    """use(value) with the value computed a single time, however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    """NFKC and lower case; Spark has no Unicode normal forms."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC and case folding, which also folds sharp s and final sigma."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@lru_cache(maxsize=1)
def _changeable() -> str:
    """A pattern of characters that NFKC may change or join to the one before them.

    It is a few long ranges that are safe, negated: a pattern of many short ranges
    is slow.  What is outside them goes to Python, changed or not.
    """
    joined = {int(p[1], 16) for c in range(0x80, 0x3100) if len(p := unicodedata.decomposition(chr(c)).split()) == 2 and p[0][0] != "<"}
    safe = [c < 0x80 or not (c in joined or unicodedata.combining(chr(c))) and unicodedata.is_normalized("NFKC", chr(c)) for c in range(0x2100)]
    edges = [i for i in range(1, len(safe)) if safe[i] != safe[i - 1]]
    runs = [(a, b - 1) for a, b in zip([0, *edges], [*edges, len(safe)]) if safe[a] and (b - a >= 16 or b < 0x100)]
    usual = [r for r in runs if r[0] < 0x530 or 0x2000 <= r[0]]
    return "[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in usual) + "]"


def normal(text: Column | str) -> Column:
    """NFKC and lower case; only texts with a character that NFKC could change go through Python."""
    t = col(text)
    return F.coalesce(normalized(F.when(t.rlike(_changeable()), t)), F.lower(t))


def _suffixes(rules: tuple[tuple[str, int], ...]) -> tuple[str, str]:
    """A pattern whose alternatives are the rules in order, and what is left of the token."""
    groups: list[tuple[int, list[str]]] = []
    for suffix, least in rules:
        if groups and groups[-1][0] == least - len(suffix) and len(groups[-1][1][0]) == len(suffix):
            groups[-1][1].append(suffix)
        else:
            groups.append((least - len(suffix), [suffix]))
    pattern = "|".join(f"(.{{{n},}})(?:{'|'.join(ends)})" for n, ends in groups)
    return f"^(?:{pattern})$", "".join(f"${i + 1}" for i in range(len(groups)))


def stem(token: Column | str, profile: Profile = MACEDONIAN) -> Column:
    """At most one derivational, then one inflectional suffix, the first listed that fits."""
    t, last = col(token), sorted({s[-1] for s, _ in (*profile.derivational, *profile.inflectional)})
    cut = F.regexp_replace(F.regexp_replace(t, *_suffixes(profile.derivational)), *_suffixes(profile.inflectional))
    return F.when(F.right(t, F.lit(1)).isin(last), cut).otherwise(t)  # most tokens end in no suffix's letter


def words(text: Column | str, is_normal: bool = False) -> Column:
    """Tokens of the normal, lower-case text, function words included.

    A text that is in normal form already needs no Python, as in join conditions.
    """
    t = F.lower(col(text)) if is_normal else normal(text)
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))


def content_words(text: Column | str, profile: Profile = MACEDONIAN, is_normal: bool = False) -> Column:
    """Tokens without function words, before stemming."""
    return F.filter(words(text, is_normal), lambda w: ~w.isin(list(profile.stopwords)))


def tokens(text: Column | str, profile: Profile = MACEDONIAN, do_stem: bool = True, is_normal: bool = False) -> Column:
    own = content_words(text, profile, is_normal)
    return F.transform(own, lambda w: stem(w, profile)) if do_stem else own


def distinct_tokens(text: Column | str, profile: Profile = MACEDONIAN) -> Column:
    """Each stem once; words are made distinct first, so that few are stemmed."""
    return F.array_distinct(F.transform(F.array_distinct(content_words(text, profile)), lambda w: stem(w, profile)))


def any_of(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles], F.lit(False))


def starts_word(text: Column, cues: tuple[str, ...]) -> Column:
    """Whether a cue begins at a word's left boundary; (?U) makes \\w know all scripts."""
    return text.rlike("(?U)(?<!\\w)(?:" + "|".join(re.escape(c) for c in cues) + ")")


def intents(text: Column | str, profile: Profile = MACEDONIAN, top_only: bool = False) -> Column:
    """Section types asked about, in order of precedence."""
    t = normal(text)
    found = F.filter(F.array(*[F.when(starts_word(t, cues), F.lit(kind)) for kind, cues in profile.intents.items()]), lambda x: x.isNotNull())
    return F.slice(found, 1, 1) if top_only else found


def anchor_terms(text: Column | str, profile: Profile = MACEDONIAN) -> Column:
    """Distinct stems of four letters or more that aren't generic."""
    generic = F.array(*[stem(F.lit(w), profile) for w in profile.generic_words])
    return F.array_except(F.array_distinct(F.filter(tokens(text, profile), lambda t: F.char_length(t) >= 4)), generic)


def is_followup(text: Column | str, profile: Profile = MACEDONIAN) -> Column:
    """A message that goes on: few words, an opener, an anaphor or a continuing phrase."""
    w = words(text)
    return (F.size(w) > 0) & (
        (F.size(w) <= 3)
        | F.get(w, F.lit(0)).isin(list(profile.openers))
        | F.arrays_overlap(w, F.array(*map(F.lit, profile.anaphors)))
        | any_of(normal(text), profile.continuations)
    )


def is_targeted(text: Column | str, profile: Profile = MACEDONIAN) -> Column:
    """About one thing, not a whole section; plain substrings, no word boundary."""
    t = F.lower(col(text))
    return any_of(t, profile.targeted) & ~any_of(t, profile.enumerative)


def collapse_dotted(text: Column | str) -> Column:
    """Runs of two to four single letters with dots lose the dots."""
    t = col(text)
    for n in (4, 3, 2):
        t = F.regexp_replace(t, "(?U)\\b" + r"(\w)\." * n, "".join(f"${i + 1}" for i in range(n)))
    return t


def digits(text: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), "\\P{Nd}", "")


def norm_text(text: Column | str) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "(?U)\\s+", " "))


def same_number(text: Column | str) -> Column:
    """Normal form for joins of identifiers: digits without leading zeros."""
    return F.regexp_replace(digits(text), "^0+", "")


def numbers_in(text: Column | str) -> Column:
    """Digit strings of two or more digits that are claims: no citations, list marks or digit counts."""
    # fixed values: the patterns decide which numbers count
    t = F.coalesce(col(text), F.lit(""))
    t = F.regexp_replace(t, r"\[[^\]]*\](?:\([^)]*\))?", " ")
    t = F.regexp_replace(t, r"(?m)^\s*\**\s*\d+[.)]\s", "")
    t = F.regexp_replace(t, r"(?iU)\d+\s*-?\s*цифр\w*", " ")
    found = F.regexp_extract_all(t, F.lit(r"(\d[\d.,/\-]*\d|\d{2,})"), F.lit(1))
    return F.filter(F.transform(found, lambda n: F.regexp_replace(n, r"\D", "")), lambda n: F.char_length(n) >= 2)


def number_parts(text: Column | str) -> Column:
    """Parts of separated numbers: 15.3.2026 also holds 15 and 2026."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(\d[\d.,/\-]*\d)"), F.lit(1))
    return F.filter(F.flatten(F.transform(found, lambda n: F.split(n, r"[.,/\-]+"))), lambda p: F.char_length(p) >= 2)


def citations(text: Column | str) -> Column:
    """Ids in brackets: without spaces, with an underscore, no addresses; links are taken out first."""
    # fixed values: the patterns decide what is cited
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\[[^\]]*\]\([^)]*\)", " ")
    found = F.regexp_extract_all(t, F.lit(r"\[([^\[\]\s]+)\]"), F.lit(1))
    return F.filter(found, lambda c: F.contains(c, F.lit("_")) & ~F.lower(c).rlike("^(http://|https://|www\\.)"))


def triaged(text: Column | str, current: Column | str, seen: Column | str) -> Column:
    """Citations as valid, stale (shown earlier) or fabricated; order and repeats stay."""
    found, now, before = citations(text), col(current), col(seen)
    old = F.array_except(before, now)
    return F.struct(
        F.filter(found, lambda c: F.array_contains(now, c)).alias("valid"),
        F.filter(found, lambda c: F.array_contains(old, c)).alias("stale"),
        F.filter(found, lambda c: ~F.array_contains(now, c) & ~F.array_contains(old, c)).alias("fabricated"),
    )


def states(text: Column, needle: Column, negation: str = MACEDONIAN.negation) -> Column:
    """Whether the needle occurs at least once without the negation as a word before it.

    What stands before each occurrence is a split's piece with the needles before
    it; only the last word matters, and a needle ends a piece as a word would.
    """
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    before = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.exists(before, lambda b: ~b.rlike(f"(?U)(?:^|\\P{{L}}){negation}\\s*$"))


def row_signature(kind: Column | str, content: Column | str) -> Column:
    """What a row would change about an answer: a fee's numbers, else the normal text."""
    amounts = F.array_join(F.regexp_extract_all(F.coalesce(col(content), F.lit("")), F.lit(r"(\d[\d.,]*)"), F.lit(1)), "|")
    return F.when(col(kind) == "tariffs", amounts).otherwise(norm_text(content))


def xml_text(text: Column | str) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(char), F.lit(entity))
    return t


def xml_attribute(text: Column | str) -> Column:
    t = F.replace(xml_text(text), F.lit('"'), F.lit("&quot;"))
    return F.regexp_replace(t, "[\\r\\n\\t]", " ")


def history_text(text: Column | str, most: int = 500, note: str = "\n[...]") -> Column:
    """Older answers, cut at the last line break within the first characters."""
    t = col(text)
    head = F.substring(t, 1, most)
    lines = F.split(head, "\n")
    kept = F.when(F.size(lines) > 1, F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n")).otherwise(head)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(kept, F.lit(note)))
