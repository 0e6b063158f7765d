"""Joins give no more rows than the answer needs, and tables are read no more often."""

import pytest
from pyspark.sql import functions as F

from quern.operators import structured, tools
from quern.sources import services


def _joined(df):
    """Rows out of each join of a collected table's plan."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            children = node.children()
            left += [children.apply(i) for i in range(children.size())]
        if name.endswith("JoinExec"):
            found.append(node.metrics().apply("numOutputRows").value())
    return found


@pytest.mark.parametrize("most", [6, 2])
def test_a_place_meets_its_questions_with_its_first_rows_only(spark, most):
    places = [("ХИКС", f"h{i}", i % 3 or None, [None, "b", "a"][i % 7 % 3]) for i in range(300)] + [("ИПСИЛОН", f"y{i}", 1, "b") for i in range(3)] + [(None, "none", 1, "a")]
    blocks = spark.createDataFrame(places, "municipality string, chunk_id string, part int, list_key string")
    text = {i: f"Адвокати во {'Хикс и Ипсилон' if i % 2 else 'Ипсилон, Хикс' if i % 3 else 'Хикс'}" for i in range(200)}
    got = structured.directory_rows(spark.createDataFrame(list(text.items()), "query_id int, query string"), blocks, most)
    rows = sorted(tuple(r) for r in got.collect())
    order = lambda p: (p[2] or 1, p[3] or "", p[0], p[1])
    want = []
    for i, q in text.items():
        own = sorted((p for p in places if p[0] and p[0].lower() in q.lower()), key=order)
        want += [(i, p[1], n + 1) for n, p in enumerate(own[:most])]
    assert rows == sorted(want)
    assert max(_joined(got)) <= 200 * 2 * most


def test_a_summary_reads_its_blocks_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(kind):
        read.add(1)
        return kind

    blocks = [("variation", "tariffs", 1, 2, " Name", "name"), ("variation", "access", 1, 2, None, "name"), ("variation", "access", 1, 3, "other", "name"), ("service", "faq", 1, None, None, "name"), ("variation", "faq", None, 0, "x", "X")]
    table = spark.createDataFrame(blocks, "scope string, type string, id_service long, id_variation long, variation_short_name string, service_name string")
    skipped = spark.createDataFrame([("a", "waf"), ("b", "waf")], "path string, kind string")
    got = {(r["measure"], r["key"]): r["n"] for r in services.summary(table.where(noted("type").isNotNull()), skipped).collect()}
    assert got == {
        ("scope", "variation"): 4, ("scope", "service"): 1, ("type", "tariffs"): 1, ("type", "access"): 2, ("type", "faq"): 2, ("blocks", ""): 5, ("services", ""): 1, ("variations", ""): 2, ("single form", ""): 2, ("skipped", "waf"): 2,
    }
    assert read.value == len(blocks)
    none = {(r["measure"], r["key"]): r["n"] for r in services.summary(table.limit(0), skipped.limit(0)).collect()}
    assert none == {("blocks", ""): 0, ("services", ""): 0, ("variations", ""): 0, ("single form", ""): 0}


def test_kinds_are_as_before_and_no_file_is_lost(spark):
    files = [("ok", '﻿ {"idService": 3}'), ("open", '"idService": 3}'), ("none", " \n"), ("null", None), ("waf", "<HTML>"), ("soft", "Ticket ID 4"), ("zero", '{"idService": 0}'), ("no", "{"), ("list", "[1]")]
    blocks, skipped = services.build_corpus(spark.createDataFrame(files, "path string, text string"))
    kinds = {r["path"]: r["kind"] for r in skipped.collect()}
    assert kinds == {"none": "empty", "null": "empty", "waf": "waf", "soft": "soft_error", "zero": "bad_json", "no": "bad_json", "list": "bad_json"}
    assert blocks.count() == 0


def test_dates_and_types_are_read_once_a_decision(spark):
    kinds, names = ["Упис", " бришење ", None], ["АД Прва", "Втора  дооел", "", None]
    decisions = [(f"n{i}", f"000{i % 7}", names[i % 4], kinds[i % 3], [["1.2.2024", "02.02.2024", "1.2.2024"], ["1 февруари 2024", "x"], [None], None][i % 4]) for i in range(40)]
    asked = [(0, "3", "", "", ""), (1, "003", "прва", "", "1.2.2024"), (2, "", "ДООЕЛ", "упис", ""), (3, "", "", "", "1.2.2024"), (4, "", "", "Бришење", "1.2.2024"), (5, "", "", "УПИС", ""), (6, "", "", "", "no day"), (7, "", "а", "", "2.2.2024"), (8, None, None, None, "2.2.2024"), (9, "", "", "упис", "no day")]
    rows = spark.createDataFrame(decisions, "number string, id string, name string, doc_type string, dates array<string>")
    queries = spark.createDataFrame([*asked, *((100 + i, "", "", "упис", "01.02.2024") for i in range(60))], "query_id int, by_id string, by_name string, by_type string, by_date string")
    got = tools.announcement_search(rows, queries)
    assert got.columns == [*rows.columns, "query_id"]
    days = {"1.2.2024": "01.02.2024", "01.02.2024": "01.02.2024", "1 февруари 2024": "01.02.2024", "02.02.2024": "02.02.2024", "2.2.2024": "02.02.2024"}
    norm = lambda t: " ".join((t or "").lower().split())
    want = []
    for q, by_id, by_name, by_type, by_date in (tuple(r) for r in queries.collect()):
        for number, i, name, kind, dates in decisions:
            if by_id and i.lstrip("0") != by_id.lstrip("0") or norm(by_name) not in norm(name) or by_type and norm(kind) != norm(by_type):
                continue
            if by_date and (by_date not in days or days[by_date] not in [days.get(d) for d in dates or []]):
                continue
            want.append((q, number))
    assert sorted((r["query_id"], r["number"]) for r in got.collect()) == sorted(want)
    # a date is parsed where it is stored, never for each pair
    assert "regexp_extract" not in got._jdf.queryExecution().optimizedPlan().toString()
