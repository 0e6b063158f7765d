"""Ranking metrics as one tall table, slices of it, and a regression gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_KS = (1, 3, 5, 10, 20)


def case_metrics(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = DEFAULT_KS) -> DataFrame:
    """(case_id, metric, value): hit, recall, precision, coverage, mrr and ndcg at each k.

    Only grade 2 is primary; ndcg uses all grades.  precision divides by the rows
    returned, coverage by what could have been found.  Cases are those of the gold.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "id"))
    ideal = gold.withColumn("place", place)
    top = max(ks)
    per_gold = ideal.groupBy("case_id").agg(
        F.count_if(F.col("grade") >= 2).alias("primary"),
        *[F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias(f"ideal{k}") for k in ks],
    )
    found = hits.where(F.col("rank") <= top).select(F.col("query_id").alias("case_id"), "id", "rank").join(gold, ["case_id", "id"], "left")
    within = lambda k: F.col("rank") <= k
    main = F.coalesce(F.col("grade"), F.lit(0)) >= 2
    per_hits = found.groupBy("case_id").agg(
        *[F.count_if(within(k)).alias(f"n{k}") for k in ks],
        *[F.count_if(within(k) & main).alias(f"found{k}") for k in ks],
        F.min(F.when(main, F.col("rank"))).alias("best"),
        *[F.sum(F.when(within(k) & F.col("grade").isNotNull(), gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg{k}") for k in ks],
    )
    both = per_gold.join(per_hits, "case_id", "left").na.fill(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    values: list[tuple[str, Column]] = []
    for k in ks:
        n = F.col(f"found{k}")
        values += [
            (f"hit@{k}", (n > 0).cast("double")),
            (f"recall@{k}", share(n, F.col("primary"))),
            (f"precision@{k}", share(n, F.col(f"n{k}"))),
            (f"coverage@{k}", share(n, F.least("primary", F.lit(k)))),
            (f"mrr@{k}", F.when((F.col("best") > 0) & (F.col("best") <= k), 1.0 / F.col("best")).otherwise(0.0)),
            (f"ndcg@{k}", share(F.col(f"dcg{k}"), F.col(f"ideal{k}"))),
        ]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values])
    return both.select("case_id", F.inline(rows))


def diagnostics(hits: DataFrame, cases: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(case_id, metric, value): service and type accuracy, and confusion with sibling variations.

    cases hold expect_service, expect_variation and expect_types; a metric is absent
    where its expectation is.  A shared row of the service counts for its variation.
    """
    own = hits.where(F.col("rank") <= k).select(F.col("query_id").alias("case_id"), "id", "rank").join(rows, hits["id"] == rows["chunk_id"])
    both = cases.join(own, "case_id", "left")
    service = F.col("id_service") == F.col("expect_service")
    shared = F.col("id_variation").isNull()
    sums = both.groupBy("case_id", "expect_service", "expect_variation", F.size("expect_types").alias("n_types")).agg(
        F.max(F.coalesce(service, F.lit(False)).cast("double")).alias("service_acc"),
        F.max(F.coalesce((F.col("rank") == 1) & service & (shared | (F.col("id_variation") == F.col("expect_variation"))), F.lit(False)).cast("double")).alias("variation_acc"),
        F.coalesce(F.count_if(service & ~shared & (F.col("id_variation") != F.col("expect_variation"))) / F.nullif(F.count("id"), F.lit(0)), F.lit(0.0)).alias("sibling_confusion"),
        F.coalesce(F.count_if(F.array_contains("expect_types", F.col("type"))) / F.nullif(F.count("id"), F.lit(0)), F.lit(0.0)).alias("type_precision"),
    )
    listed = F.array(
        F.struct(F.lit(f"service_acc@{k}").alias("metric"), F.when(F.col("expect_service").isNotNull(), F.col("service_acc")).alias("value")),
        F.struct(F.lit("variation_acc@1").alias("metric"), F.when(F.col("expect_variation").isNotNull(), F.col("variation_acc")).alias("value")),
        F.struct(F.lit(f"sibling_confusion@{k}").alias("metric"), F.when(F.col("expect_variation").isNotNull(), F.col("sibling_confusion")).alias("value")),
        F.struct(F.lit(f"type_precision@{k}").alias("metric"), F.when(F.col("n_types") > 0, F.col("type_precision")).alias("value")),
    )
    return sums.select("case_id", F.inline(listed)).where(F.col("value").isNotNull())


def sliced(metrics: DataFrame, cases: DataFrame, slices: tuple[str, ...]) -> DataFrame:
    """(slice, key, metric, n, mean): all cases and one level a slice, by grouping sets."""
    joined = metrics.join(cases.select("case_id", *slices), "case_id")
    sets = [[F.col("metric")], *[[F.col("metric"), F.col(s)] for s in slices]]
    out = joined.groupingSets(sets, F.col("metric"), *map(F.col, slices)).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.grouping_id().alias("g"))
    # bits of the grouping id, from the left: metric, then the slices; a set bit is rolled up
    width = len(slices)
    which, key = F.lit("all"), F.lit("all")
    for i, s in enumerate(slices):
        here = F.col("g").bitwiseAND(F.lit(1 << (width - 1 - i))) == 0
        which, key = F.when(here, F.lit(s)).otherwise(which), F.when(here, F.col(s).cast("string")).otherwise(key)
    return out.select(which.alias("slice"), key.alias("key"), "metric", "n", "mean")


def p95(rows: DataFrame, value: str, by: list[str], bins: int = 4096) -> DataFrame:
    """The value at place min(n - 1, int(0.95 n)) from 0, which isn't an interpolated percentile.

    Two passes: counts in equal bins between the smallest and largest finite value
    of each group tell the bin of that place; only the distinct values of this bin
    are then put in order.  Nulls don't count; NaN comes last.
    """
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), F.col(value).cast("double").alias("d"))
    finite = F.when(~F.isnan("d") & (F.abs("d") < float("inf")), F.col("d"))
    ends = _renamed(own.groupBy(*by).agg(F.min(finite).alias("lo"), F.max(finite).alias("hi")), by)
    inner = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("d") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))).otherwise(0)
    at = F.when(F.isnan("d") | (F.col("d") == float("inf")), bins).when(F.col("d") == float("-inf"), -1).otherwise(inner)
    binned = own.join(ends, _same(by)).select(*by, "v", at.cast("long").alias("bin"))
    counted = binned.groupBy(*by, "bin").agg(F.count("*").alias("m"))
    window = Window.partitionBy(*by)
    placed = counted.withColumn("end", F.sum("m").over(window.orderBy("bin"))).withColumn("wanted", F.least(F.sum("m").over(window) - 1, F.floor(F.sum("m").over(window) * 0.95)))
    first = F.col("end") - F.col("m")
    hit = placed.where((first <= F.col("wanted")) & (F.col("wanted") < F.col("end"))).select(*by, F.col("bin").alias("hit"), (F.col("wanted") - first).alias("left"))
    inside = binned.join(_renamed(hit, by), _same(by) & (F.col("bin") == F.col("hit"))).groupBy(*by, "left", "v").agg(F.count("*").alias("m"))
    near = inside.withColumn("end", F.sum("m").over(window.orderBy("v")))
    return near.where((F.col("end") - F.col("m") <= F.col("left")) & (F.col("left") < F.col("end"))).select(*by, F.col("v").alias("p95"))


def _renamed(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in by})


def _same(by: list[str]) -> Column:
    """Equal groups, nulls included, of a table and a renamed one."""
    return reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_{c}")), by, F.lit(True))


def compare(baseline: DataFrame, candidate: DataFrame, metric: str = "ndcg@10", tolerance: float = 0.01, least: int = 10) -> DataFrame:
    """(slice, key, base, cand, regressed) of two sliced tables; small families aren't judged.

    A family that the candidate lacks is reported as missing.
    """
    own = lambda df, name: df.where(F.col("metric") == metric).select("slice", "key", F.col("mean").alias(name), F.col("n").alias(f"{name}_n"))
    both = own(baseline, "base").join(own(candidate, "cand"), ["slice", "key"], "left").where((F.col("slice") == "all") | (F.col("base_n") >= least))
    return both.select("slice", "key", "base", "cand", (F.coalesce(F.col("cand"), F.lit(-1.0)) < F.col("base") - tolerance).alias("regressed"), F.col("cand").isNull().alias("missing"))


def worst(metrics: DataFrame, metric: str, n: int = 20) -> DataFrame:
    return metrics.where(F.col("metric") == metric).orderBy("value", "case_id").limit(n)


def drops(baseline: DataFrame, candidate: DataFrame, metric: str, n: int = 20) -> DataFrame:
    """Cases whose metric changed, the largest drop first."""
    own = lambda df, name: df.where(F.col("metric") == metric).select("case_id", F.col("value").alias(name))
    both = own(baseline, "base").join(own(candidate, "cand"), "case_id").withColumn("change", F.col("cand") - F.col("base"))
    return both.where("change <> 0").orderBy("change", "case_id").limit(n)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def answer_totals(answers: DataFrame, prices: dict[str, tuple[float, float]], by: str = "model") -> DataFrame:
    """(model, n, prompt_tokens, completion_tokens, cost_usd); prices are of a million prompt and completion tokens.

    A model without a price costs nothing.
    """
    price = lambda k: reduce(lambda c, kv: F.when(F.col(by) == kv[0], F.lit(float(kv[1][k]))).otherwise(c), prices.items(), F.lit(0.0))
    sums = answers.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("prompt_tokens").cast("long")).alias("prompt_tokens"), F.sum(F.col("completion_tokens").cast("long")).alias("completion_tokens"))
    return sums.withColumn("cost_usd", (F.col("prompt_tokens") * price(0) + F.col("completion_tokens") * price(1)) / 1e6)


def behaviour_counts(seen: DataFrame, by: list[str], kinds: tuple[str, ...] = ("answer", "abstain", "clarify", "error")) -> DataFrame:
    return seen.groupBy(*by).agg(*[F.count_if(F.col("behaviour") == k).alias(k) for k in kinds])


def save_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """A saved report (slice, key, metric, n, mean)."""
    return spark.read.schema("slice string, key string, metric string, n long, mean double").json(path)


def save_run(path: str, header: DataFrame, report: DataFrame, cases: DataFrame) -> None:
    """A whole run in three tables; the header, one row, comes last, so a run that broke off has none.

    report is (slice, key, metric, n, mean); cases hold case_id, metrics (a map) and
    top (ids in order), one row a case.
    """
    report.write.mode("overwrite").parquet(f"{path}/report")
    cases.write.mode("overwrite").parquet(f"{path}/cases")
    header.write.mode("overwrite").parquet(f"{path}/header")


def load_run(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(header, report, cases) of a saved run."""
    header, report, cases = (spark.read.parquet(f"{path}/{part}") for part in ("header", "report", "cases"))
    return header, report, cases


def case_rows(metrics: DataFrame, hits: DataFrame, most: int = 10) -> DataFrame:
    """(case_id, metrics, top): the values of each case by name, and its first ids; a case without hits has none."""
    values = metrics.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    first = hits.where(F.col("rank") <= most).groupBy(F.col("query_id").alias("case_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("top"))
    return values.join(first, "case_id", "left").withColumn("top", F.coalesce("top", F.array().cast("array<string>")))
