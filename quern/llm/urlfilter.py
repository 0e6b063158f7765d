"""URL filters: given rules by host and path, and rules mined from labels by FP-growth.

Token combinations of labelled urls are mined together with the label.  Those
that mean a bad page with enough support, and more often than pages are bad at
all by more than chance explains, become rules; an inverted index from token to rules finds, for each url, the rules of which it holds all
tokens.  The main path is built-in functions only.

Defined results: a null url, or one without "://", has an empty host and path and
no tokens; it fits no rule and is allowed.  Repeated rows are each judged; labels
with several rows a page count as bad if any is; with no labels, or where `lift` times the share
of bad pages is over one, nothing is mined.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BAD = "label=bad"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Host labels, path words with numbers made alike, and keys of the query and fragment."""

    def marked(words: Column, mark: str) -> Column:
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(f"{mark}:"), w))

    tail = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1), F.lit(""))
    words = F.transform(F.split(path(url), "[/.]"), lambda w: F.regexp_replace(w, "[0-9]+", "#"))
    keys = F.transform(F.split(tail, "[?&#]"), lambda w: F.regexp_extract(w, "^([^=]*)", 1))
    return F.array_distinct(F.concat(marked(F.split(host(url), "[.]"), "h"), marked(words, "p"), marked(keys, "q")))


def given_rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) by the longest of the (verdict, host/path) rules that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, below = rule.partition("/")
        fits = ((host_ == at) | host_.endswith(f".{at}")) & path_.startswith(f"/{below}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def strength(hits: Column, held: Column, bad: int, n: int) -> Column:
    """held * KL(hits / held || bad / n): the negative logarithm of the bound on chance."""
    rest = held - hits
    return hits * F.ln(hits * n / (held * bad)) + F.when(rest > 0, rest * F.ln(rest * n / (held * (n - bad)))).otherwise(0.0)


def mine(urls: DataFrame, url_col: str, bad_col: str, support: float = 0.02, least: int = 3, lift: float = 1.5, alpha: float = 0.01) -> list[tuple[list[str], int, int]]:
    """(tokens, bad urls, urls) of the rules that mean a bad page.

    A rule holds in at least max(least, support * bad urls) bad urls, and its share
    of bad ones, the confidence, is at least `lift` times the share among all.
    Were its tokens independent of the label, so many bad urls among its urls would
    have a probability of at most exp(-urls * KL(confidence || share)), by
    Hoeffding's bound for draws without replacement.  That bound times the number
    of frequent token sets, all of which are tried, is at most `alpha`: with no
    true association, any rule at all is mined with probability alpha or less.

    Rules may have any number of tokens; those that a smaller rule implies are
    left out, since they change no verdict.  The support is relative, so the
    rules' number doesn't grow with the urls.
    """
    baskets = urls.select(F.concat(tokens(F.col(url_col)), F.when(F.col(bad_col), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"), F.col(bad_col).alias("bad")).persist()
    try:
        n, bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
        count = max(least, math.ceil(support * bad))
        if bad < count or lift * bad > n:  # where most pages are bad no share is that much larger
            return []
        model = FPGrowth(itemsCol="items", minSupport=(count - 0.5) / n, minConfidence=max(0.0, lift * bad / n - 1e-6)).fit(baskets.select("items"))
        tried = model.freqItemsets.where(F.array_contains("items", BAD) & (F.size("items") > 1) & (F.col("freq") >= count)).count()
        ruled = model.associationRules.where(F.col("consequent")[0] == BAD).select("antecedent", F.round(F.col("support") * n).alias("hits"), "confidence")
        ruled = ruled.select("antecedent", "hits", F.round(F.col("hits") / F.col("confidence")).alias("held"))
        rules = ruled.where(strength(F.col("hits"), F.col("held"), bad, n) >= math.log(max(tried, 1) / alpha) - 1e-9).collect()
    finally:
        baskets.unpersist()
    found = [(sorted(r["antecedent"]), int(r["hits"]), int(r["held"])) for r in rules]
    kept: list[tuple[list[str], int, int]] = []
    sets: list[frozenset[str]] = []
    for needed, hits, all_ in sorted(found, key=lambda r: (len(r[0]), r[0])):
        own = frozenset(needed)
        if hits >= count and hits * n >= lift * all_ * bad and not any(k < own for k in sets):
            kept.append((needed, hits, all_))
            sets.append(own)
    return kept


def holds_a_rule(words: Column, rules: list[tuple[list[str], int, int]]) -> Column:
    """Whether all tokens of a rule are among the words, by an index from token to rules."""
    if not rules:
        return F.lit(False)
    index: dict[str, list[int]] = {}
    for k, (needed, *_) in enumerate(rules):
        for word in needed:
            index.setdefault(word, []).append(k)
    lookup = F.map_from_arrays(F.array(*map(F.lit, index)), F.array(*[F.array(*map(F.lit, v)) for v in index.values()]))
    sizes = F.array(*[F.lit(len(needed)) for needed, *_ in rules])
    found = F.flatten(F.transform(F.filter(words, lambda w: F.map_contains_key(lookup, w)), lambda w: lookup[w]))
    return F.exists(F.array_distinct(found), lambda r: F.size(F.filter(found, lambda x: x == r)) == F.get(sizes, r))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", bad_col: str = "bad", **how) -> DataFrame:
    """(id, host, path, rule, verdict) of every page; labelled has urls and whether each is bad."""
    mined = mine(labelled, url_col, bad_col, **how)
    url = F.col(url_col)
    judged = pages.select(F.col(id_col), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("words"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(holds_a_rule(F.col("words"), mined), "block").otherwise("allow")
    return judged.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"))
