"""Scores of answers without a judge: behaviour, values, numbers and citations.

records are (case_id, query, text, citations, docs, asked_clarification,
invalid_citations), cases (case_id, expect_behavior, expect_values,
forbid_values), blocks (chunk_id, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import any_of, col, number_parts, numbers_in, states
from quern.profile import MACEDONIAN, Profile

IDENTIFIER_LENGTHS = (7, 8, 13, 14)


def behaviour(text: Column | str, citations: Column | str, asked: Column | str, profile: Profile = MACEDONIAN) -> Column:
    """error, answer, abstain or clarify: whatever states a number or cites is an answer."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    return (
        F.when(t == "", "error")
        .when((F.size(F.coalesce(col(citations), F.array().cast("array<string>"))) > 0) | (F.size(numbers_in(text)) > 0), "answer")
        .when(any_of(t, profile.abstain), "abstain")
        .when(F.coalesce(col(asked), F.lit(False)) | any_of(t, profile.clarify), "clarify")
        .otherwise("answer")
    )


def guarded(text: Column | str, valid: Column | str, profile: Profile = MACEDONIAN) -> Column:
    """A reply without a valid citation must say that it has nothing, or ask; else it is replaced."""
    t = F.lower(col(text))
    return F.when((F.size(col(valid)) == 0) & ~any_of(t, profile.guard_abstain) & ~any_of(t, profile.guard_request), profile.hard_abstention).otherwise(col(text))


def alternatives(value: Column) -> Column:
    return F.split(F.lower(value), "\\|")


def value_recall(text: Column | str, values: Column | str) -> Column:
    """Share of expected values that the text states in any of their forms; null without values."""
    t, v = F.lower(col(text)), col(values)
    found = F.filter(v, lambda x: F.exists(alternatives(x), lambda a: F.contains(t, a)))
    return F.when(F.size(v) > 0, F.size(found) / F.size(v))


def no_forbidden(text: Column | str, values: Column | str) -> Column:
    """1 unless a forbidden value is stated without a negation before it; null without values."""
    t, v = F.lower(col(text)), col(values)
    return F.when(F.size(v) > 0, F.when(F.exists(v, lambda x: F.exists(alternatives(x), lambda a: states(t, a))), 0.0).otherwise(1.0))


def pooled_text(records: DataFrame, blocks: DataFrame, ids: str, into: str) -> DataFrame:
    """(case_id, into): contents of the listed blocks, in the list's order."""
    one = records.select("case_id", F.posexplode(ids).alias("i", "chunk_id")).join(blocks.select("chunk_id", "content"), "chunk_id")
    return one.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "content"))), lambda x: x["content"]), " ").alias(into))


def groundedness(text: Column | str, pool: Column | str, query: Column | str) -> Column:
    """Share of stated numbers found in the pool, or typed by the user as an identifier; null without numbers."""
    stated = numbers_in(text)
    known = F.array_union(F.array_union(numbers_in(pool), number_parts(pool)), F.filter(numbers_in(query), lambda n: F.char_length(n).isin(*IDENTIFIER_LENGTHS)))
    return F.when(F.size(stated) > 0, F.size(F.filter(stated, lambda n: F.array_contains(known, n))) / F.size(stated))


def value_citation(text: Column | str, values: Column | str, cited: Column | str) -> Column:
    """Share of stated values that the cited text holds; alternatives aren't split here."""
    t, c = F.lower(col(text)), F.lower(F.coalesce(col(cited), F.lit("")))
    stated = F.filter(col(values), lambda v: F.contains(t, F.lower(v)))
    return F.when(F.size(stated) > 0, F.size(F.filter(stated, lambda v: F.contains(c, F.lower(v)))) / F.size(stated))


def scores(records: DataFrame, cases: DataFrame, blocks: DataFrame, profile: Profile = MACEDONIAN) -> DataFrame:
    """(case_id, metric, value): each defined component, and answer_score, their plain mean."""
    both = records.join(cases.select("case_id", "expect_behavior", "expect_values", "forbid_values"), "case_id")
    both = both.join(pooled_text(records, blocks, "docs", "pool"), "case_id", "left").join(pooled_text(records, blocks, "citations", "cited"), "case_id", "left")
    seen = behaviour("text", "citations", "asked_clarification", profile)
    parts = {
        "behavior_match": F.when(F.col("expect_behavior").isNotNull(), (seen == F.col("expect_behavior")).cast("double")),
        "value_recall": value_recall("text", "expect_values"),
        "no_forbidden": no_forbidden("text", "forbid_values"),
        "numeric_groundedness": groundedness("text", "pool", "query"),
        "value_citation": value_citation("text", "expect_values", "cited"),
        "citation_integrity": F.when(F.size(F.coalesce("invalid_citations", F.array().cast("array<string>"))) > 0, 0.0).otherwise(1.0),
    }
    rows = F.filter(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in parts.items()]), lambda x: x["value"].isNotNull())
    mean = F.aggregate("rows", F.lit(0.0), lambda s, x: s + x["value"]) / F.size("rows")
    whole = F.array(F.struct(F.lit("answer_score").alias("metric"), mean.alias("value")))
    return both.select("case_id", rows.alias("rows")).select("case_id", F.inline(F.concat("rows", whole)))


def turn_match(want: Column | str, got: Column | str) -> Column:
    """Turns that behave as expected, over the turns expected."""
    w = col(want)
    pairs = F.zip_with(w, F.slice(col(got), F.lit(1), F.size(w)), lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / F.size(w)
