"""Payloads, directories, crawl plans, files, upkeep, answers, tools, dialog and streams."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quern.operators import answers, dialog, gold, maintenance, tools
from quern.sources import corpus, crawl, directory, payloads, services
from quern.streaming import flows


@pytest.mark.parametrize(
    "text,kind",
    [("", "empty"), (" \n", "empty"), (None, "empty"), ("<html>x", "waf"), ("Request Rejected. id", "waf"), ("Error, Ticket ID 5", "soft_error"), ('{"idService": 5', "bad_json"), ('{"a": 1}', "bad_json"), ('{"idService": 0}', "bad_json"), ('﻿{"idService": 7}', "ok"), ('"idService": 7}', "ok"), ('{"idService": 7, "t": "you are blocked"}', "waf")],
)
def test_guard(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(payloads.classified("t")).first()[0] == kind


def test_tables_describe_themselves(spark):
    table = {"Columns": [{"Column": "a", "Title": " Такса ", "Format": "Curency"}, {"Column": "b", "Title": "", "Format": None}], "Data": [{"a": "12,50", "b": "x", "Order": "2", "Id": "9"}, {"a": "0.0", "b": "", "Order": "bad"}, {"a": "free", "c": "y", "Order": "1"}]}
    rows = spark.createDataFrame([(json.dumps(table),), (json.dumps({"Columns": [], "Data": None}),)], "t string").select(payloads.decoded("t").alias("d"))
    first, second = [r["d"] for r in rows.collect()]
    assert second is None
    text = spark.createDataFrame([(json.dumps(table),)], "t string").select(F.transform(payloads.decoded("t"), payloads.row_text).alias("x")).first()["x"]
    assert text == ["Такса: 0", "Такса: free | c: y", "Такса: 12.5 | b: x"] and len(first) == 3


def test_corpus_of_payloads(spark):
    """Names, access, order of questions, siblings, the standalone service, first and last files, and the skip report."""
    t = lambda *v: {"Columns": [{"Column": "c", "Title": "K", "Format": "String"}], "Data": [{"c": x, "Order": i} for i, x in enumerate(v)]}
    one = {"idService": 1, "name": "wrong", "serviceName": " Упис ", "isOnline": True}
    files = [
        ("b_1.json", {**one, "terminology": t("старо")}), ("b_2.json", {**one, "serviceDescription": "<p>За <b>упис</b></p>", "terminology": json.dumps(t("основа")), "faQs": [{"question": "Б?", "answer": "2", "orderQ": 5}, {"question": "А?", "answer": "<i>1</i>"}, {"question": ""}]}),
        ("v_1.json", {**one, "idServiceVariation": 10, "variationShortName": "АД", "onlineURL": "https://x/", "paymentMethods": [{"name": " картичка "}, {"name": "каса"}], "process": t("a", "", 0)}), ("v_2.json", {**one, "idServiceVariation": 10, "process": t("later")}),
        ("v_3.json", {"idService": 2, "idServiceVariation": 7, "serviceName": "Промена на АД", "variationShortName": "АД", "legalBasis": "Закон", "process": t("в")}), ("w.json", {"idService": 3, "serviceShortName": "Кратко", "process": t("x"), "legalBasis": "Член"}),
    ]
    rows = [(p, json.dumps(x)) for p, x in files] + [("waf.json", "<html>Request Rejected</html>"), ("none.json", " "), ("half.json", json.dumps({"idService": 4, "process": t("y")})[1:])]
    blocks, skipped = services.build_corpus(spark.createDataFrame(rows, "path string, text string"))
    got = {r["chunk_id"]: r for r in blocks.collect()}
    assert {k: r["content"] for k, r in got.items()} == {
        "srv_1_shared_description": "За упис", "srv_1_shared_terminology_1": "K: основа", "srv_1_shared_faq_1": "Прашање: А?\nОдговор: 1", "srv_1_shared_faq_2": "Прашање: Б?\nОдговор: 2",
        "srv_1_v10_access": "Услугата е достапна онлајн: https://x/\nНачини на плаќање: картичка; каса", "srv_1_v10_process_1": "K: a", "srv_1_v10_process_3": "K: 0",
        "srv_2_shared_legalBasis": "Закон", "srv_2_v7_process_1": "K: в", "srv_3_v0_process_1": "K: x", "srv_3_v0_legalBasis": "Член", "srv_4_v0_process_1": "K: y",
    }
    assert got["srv_1_v10_process_1"]["context"] == "Услуга: Упис — АД | Постапка" and got["srv_2_v7_process_1"]["context"] == "Услуга: Промена на АД | Постапка"
    assert got["srv_3_v0_process_1"]["context"] == "Услуга: Кратко | Постапка" and got["srv_4_v0_process_1"]["context"] == "Услуга: услуга 4 | Постапка"
    assert got["srv_1_shared_description"]["applies_to_variations"] == [10] and got["srv_1_v10_access"]["online_url"] == "https://x/"
    assert {(r["path"], r["kind"]) for r in skipped.collect()} == {("waf.json", "waf"), ("none.json", "empty")}
    told = {(r["measure"], r["key"]): r["n"] for r in services.summary(blocks, skipped).collect()}
    assert told["blocks", ""] == 12 and told["variations", ""] == 2 and told["scope", "service"] == 5 and told["skipped", "waf"] == 1
    lists = spark.createDataFrame([("a/doo_2024.csv",), ("a/doo_2025.csv",), ("b/ad_1.csv",), ("c/other.csv",)], "path string")
    assert {(r["prefix"], r["path"]) for r in services.newest(lists, ("doo_", "ad_")).collect()} == {("doo_", "a/doo_2025.csv"), ("ad_", "b/ad_1.csv")}


def test_directories(spark):
    agents = spark.createDataFrame([("АЕРОДРОM", f"Име {n:03}") for n in range(81)] + [("Ѓорче Петров", "Еден")], "m string, name string")
    clean = agents.select(directory.same_letters(directory.clean_cell("m")).alias("municipality"), "name", F.col("name").alias("line"))
    got = {r["chunk_id"]: r for r in directory.blocks(clean, "doo").collect()}
    assert {k: (r["first"], r["last"], r["n_agents"]) for k, r in got.items()} == {"agents_doo_aerodrom_p1": (1, 40, 81), "agents_doo_aerodrom_p2": (41, 80, 81), "agents_doo_aerodrom_p3": (81, 81, 81), "agents_doo_gjorche_petrov_p1": (1, 1, 1)}
    assert got["agents_doo_aerodrom_p2"]["content"].startswith("АЕРОДРОМ: 81. 2/3 (41-80).\n41. Име 040\n")
    assert spark.createDataFrame([("ТЕТОВО+A1403:E1404",)], "t string").select(directory.clean_cell("t")).first()[0] == "ТЕТОВО"


def test_crawl_plans(spark):
    log = spark.createDataFrame([("a", "failed", 1), ("a", "ok", 2), ("b", "failed", 3)], "key string, status string, at int")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "key string")
    assert sorted(r[0] for r in crawl.frontier(wanted, log).collect()) == ["b", "c"]
    menus = spark.createDataFrame([(1, "x", "/uslugi/1", 3, 0), (1, "x again", "/uslugi/1", 3, 1), (2, "y", "/uslugi/2", 4, 2), (3, "z", "/other", 3, 3)], "id int, title string, url string, template int, pos int")
    assert [(r["id"], r["title"]) for r in crawl.menu_leaves(menus).collect()] == [(1, "x")]
    edges = spark.createDataFrame([("r", "a", "A"), ("a", "b", "B")], "parent string, child string, title string")
    assert {r["path"] for r in crawl.tree_paths(edges, spark.createDataFrame([("r", "R")], "node string, title string")).collect()} == {"R", "R > A", "R > A > B"}
    services = spark.createDataFrame([(1, [(5, "", " Long "), (6, "Short", "Long")])], "id_category int, services array<struct<idService:int,shortName:string,name:string>>")
    assert [r["name"] for r in crawl.category_services(services).collect()] == ["Long", "Short"]
    portal = crawl.Portal("b/", "/m", "/c", "/s/%s", 2)
    assert list(spark.range(1).select(portal.menus(), portal.category(F.lit(4)), portal.service(F.lit(3), F.lit(4), F.lit(0)), portal.service(F.lit(3), F.lit(4), F.lit(5))).first()) == ["b/m?ln=2", "b/c?idC=4&idL=2", "b/s/3?idSC=4&idV=&idL=2&idr=", "b/s/3?idSC=4&idV=5&idL=2&idr="]


def test_gate_and_files(spark, tmp_path):
    good = {"chunk_id": "srv_1_v2_process_1", "context": "c", "content": "x", "embedding_text": "c\nx", "metadata": {"scope": "variation", "type": "process", "id_service": 1, "id_variation": 2, "service_name": "s", "variation_short_name": "v", "is_online": True, "row": 1}}
    bad = {**good, "chunk_id": "srv_9_v2_process_2", "content": "gone", "metadata": {**good["metadata"], "type": "strange"}}
    path = tmp_path / "blocks.jsonl"
    path.write_text("\n".join(json.dumps(b, ensure_ascii=False) for b in (good, good, bad)))
    rows = corpus.read_blocks(spark, str(path))
    assert {(r["chunk_id"], r["problem"]) for r in corpus.block_problems(rows).collect()} == {("srv_1_v2_process_1", "key repeats"), ("srv_9_v2_process_2", "unknown type"), ("srv_9_v2_process_2", "id not in key"), ("srv_9_v2_process_2", "content not embedded")}
    with pytest.raises(ValueError, match="key repeats"):
        corpus.gate(rows)
    assert corpus.gate(rows.limit(1)).count() == 1
    cases = tmp_path / "cases.jsonl"
    cases.write_text('// note\n\n{"case_id": "c", "query": "q", "gold": {"srv_1_v2_process_1": 2, "old": 1}}\n')
    own = corpus.read_cases(spark, str(cases))
    assert [(r["case_id"], r["problem"]) for r in corpus.case_problems(own, rows).collect()] == [("c", "stale id")]
    cases.write_text('{"case_id": "c", "unknown": 1}\n')
    with pytest.raises(ValueError, match="line 1"):
        corpus.read_cases(spark, str(cases))
    corpus.write_lines(rows.select("chunk_id", "pos"), str(tmp_path / "out"), "pos")
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_upkeep_of_an_index(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d"), (5, None)], "id int, t string")
    assert {r["id"]: r["action"] for r in maintenance.difference(old, new, "id", "t").collect()} == {1: "unchanged", 2: "updated", 3: "pruned", 4: "added", 5: "added"}
    cache = spark.createDataFrame([], "key string, vector array<float>")

    def encode(texts):
        if len(texts) > 2:
            raise ValueError("too many")
        return [[float(len(t))] for t in texts]

    rows, fresh = maintenance.embedded(new, cache, encode, "m", 1, "id", "t")
    assert {r["id"]: r["vector"] for r in rows.collect()} == {1: [1.0], 2: [1.0], 4: [1.0], 5: [1.0]} and fresh.count() == 4
    assert list(maintenance.batches_of(["aa", "b", "cccc", "d"], 3, 4)) == [(0, 2), (2, 3), (3, 4)]
    maintenance.write_manifest(spark, str(tmp_path / "m"), model="m", dims=1, embed_field="t")
    assert not maintenance.needs_rebuild(maintenance.read_manifest(spark, str(tmp_path / "m")), "m", 1, "t") and maintenance.needs_rebuild(maintenance.read_manifest(spark, str(tmp_path / "none")), "m", 1, "t")


def test_answer_scores(spark):
    blocks = spark.createDataFrame([("s_1", "Таксата е 2452 денари, рок 15.3."), ("s_2", "друго")], "chunk_id string, content string")
    records = spark.createDataFrame([("a", "Колку? 7405855", "Чини 2452 МКД до 15 март за 7405855, и 999.", ["s_1"], ["s_1", "s_2"], False, []), ("b", "q", "Нема информација.", [], ["s_2"], False, ["x_y"]), ("c", "q", "За каква правна форма?", [], [], False, []), ("d", "q", "", [], [], False, [])], "case_id string, query string, text string, citations array<string>, docs array<string>, asked_clarification boolean, invalid_citations array<string>")
    cases = spark.createDataFrame([("a", "answer", ["2452|две илјади", "нема"], ["3000"]), ("b", "abstain", [], ["информација"]), ("c", "clarify", [], []), ("d", None, [], [])], "case_id string, expect_behavior string, expect_values array<string>, forbid_values array<string>")
    got = {(r["case_id"], r["metric"]): r["value"] for r in answers.scores(records, cases, blocks).collect()}
    assert got["a", "behavior_match"] == got["b", "behavior_match"] == got["c", "behavior_match"] == 1.0 and ("d", "behavior_match") not in got
    assert got["a", "value_recall"] == 0.5 and got["a", "no_forbidden"] == 1.0 and got["b", "no_forbidden"] == 0.0 and got["a", "numeric_groundedness"] == 0.75
    assert got["b", "citation_integrity"] == 0.0 and ("a", "value_citation") not in got or got.get(("a", "value_citation")) == 1.0
    guard = records.select("case_id", answers.guarded("text", "citations").alias("t"))
    assert {r["case_id"]: r["t"] for r in guard.collect()}["c"].startswith("Во документацијата")


def test_gold_families(spark):
    blocks = spark.createDataFrame([("f1", 0, "faq", 1, None, None, "s", "Прашање: Што е ова прашање?\nОдговор: да"), ("f2", 1, "faq", 2, None, None, "t", "Прашање: Што е ова прашање?\nОдговор: не"), ("t1", 2, "terminology", 1, None, None, "s", "Термин: Залог (ЗЛГ) | Објаснување: x"), ("p1", 3, "process", 1, 5, "АД", "s", "c"), ("p2", 4, "process", 1, 6, "ТП", "s", "c")], "chunk_id string, pos long, type string, id_service int, id_variation int, variation_short_name string, service_name string, content string")
    cases = gold.generate([gold.faq(blocks), gold.terminology(blocks), gold.variation(blocks, {"process": "Како %s за %s?"})]).collect()
    assert sorted((c["family"], tuple(sorted(c["gold"].items()))) for c in cases) == [("faq", (("f1", 2), ("f2", 2))), ("terminology", (("t1", 2),)), ("variation", (("f1", 1), ("p1", 2), ("t1", 1))), ("variation", (("f1", 1), ("p2", 2), ("t1", 1)))]
    placed = blocks.selectExpr("*", "CAST(NULL AS STRING) AS municipality", "CAST(NULL AS STRING) AS list_key")
    specs = spark.createDataFrame([("x", 1, 5, [(1, 5, ["process"])], ["t1"])], "case_id string, id_service int, id_variation int, targets array<struct<id_service int, id_variation int, types array<string>>>, ids array<string>").selectExpr("*", "CAST(array() AS array<struct<municipality string, list_key string>>) AS places", "false AS pinned", "CAST(array() AS array<int>) AS also_services")
    assert {(r["id"], r["grade"]) for r in gold.curated(specs, placed).collect()} == {("p1", 2), ("t1", 2), ("f1", 1)}
    with pytest.raises(ValueError, match="name no rows"):
        gold.curated(specs.withColumn("targets", F.slice("targets", 1, 0)).withColumn("ids", F.slice("ids", 1, 0)), placed)


def test_lookup_tools(spark):
    profiles = spark.createDataFrame([("07405855", "АЛФА ДОО")], "id string, name string")
    decisions = spark.createDataFrame([("7405855", "АЛФА старо"), ("1234567", "Бета")], "id string, name string")
    index = tools.entity_index(profiles, decisions)
    assert {(r["number"], r["name"], r["has_profile"], r["n_decisions"]) for r in index.collect()} == {("7405855", "АЛФА ДОО", True, 1), ("1234567", "Бета", False, 1)}
    asked = spark.createDataFrame([(0, "", "алфа  доо"), (1, "0007405855", ""), (2, "7405855", "бета"), (3, "", "")], "query_id int, by_id string, by_name string")
    assert sorted((r["query_id"], r["number"]) for r in tools.entity_search(index, asked).collect()) == [(0, "7405855"), (1, "7405855")]
    d = spark.createDataFrame([("7405855", "Алфа", "Упис", ["10 септ. 2026"])], "id string, name string, doc_type string, dates array<string>")
    q = spark.createDataFrame([(0, "", "алфа", "", "10.09.2026"), (1, "", "алфа", "", "11.09.2026"), (2, "007405855", "", "упис", "")], "query_id int, by_id string, by_name string, by_type string, by_date string")
    assert sorted(r["query_id"] for r in tools.announcement_search(d, q).collect()) == [0, 2]
    bad = spark.createDataFrame([("123", "1" * 14, "1.1.2020")], "n string, c string, d string").select(tools.argument_problems("n", "c", "d").alias("p")).first()["p"]
    assert bad == ["identifier", "date"]


TURNS = [(1, 0, "Како се запишува залог"), (1, 1, "а рокот?"), (1, 2, "Колку чини потврда банкарска"), (2, 0, "ок"), (2, 1, "Регистрација на возило сакам денес")]


def test_turns_are_planned_in_order(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, text string")
    got = {(r["conv_id"], r["turn"]): (r["query"], r["how"]) for r in dialog.plan(turns).collect()}
    assert got[1, 1] == ("Како се запишува залог а рокот?", "topic") and got[1, 2][1] == "plain" and got[2, 1][0].startswith("ок ") or got[2, 1][1] == "plain"
    state = dialog.State()
    assert dialog.planned(state, "чини?", False, True, True) == ("чини?", "plain") and dialog.planned(state, "АД", False, False, False) == ("чини? АД", "reply") and state.topic == "АД"
    state = dialog.State()
    assert [dialog.planned(state, t, False, True, a) for t, a in (("чини?", True), ("не знам", True), ("АД", False))] == [("чини?", "plain"), ("чини? не знам", "reply"), ("чини? АД", "reply")]


def test_scopes_follow_the_last_service(spark):
    kinds = [(7, ["АД", "акционерско друштво"]), (8, ["ДОО", "друштво со ограничена одговорност"])]
    rows = [(1, 0, "Колку чини упис", True, 5, kinds), (1, 1, "акционерско друштво", False, 5, kinds), (1, 2, "а за доо?", False, None, None), (2, 0, "Упис на ДОО во регистар", False, None, None), (3, 0, "а за доо?", False, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string, ambiguous boolean, service long, variations array<struct<id long, names array<string>>>")
    named = spark.createDataFrame([(2, 0, ["ДОО"]), (1, 1, ["АД"])], "conv_id long, turn long, forms array<string>")
    got = {(r["conv_id"], r["turn"]): tuple(r)[3:] for r in dialog.scopes(dialog.plan(turns, ambiguous="ambiguous"), turns, named).collect()}
    assert got == {(1, 0): ("plain", None, None, None), (1, 1): ("reply", 5, 7, None), (1, 2): ("topic", None, 8, None), (2, 0): ("plain", None, None, ["ДОО"]), (3, 0): ("plain", None, None, None)}


def test_curated_rules_that_name_nothing_raise(spark):
    blocks = spark.createDataFrame([("a", 1, None, "faq", "x", None, None), ("b", 2, 3, "faq", "x", "m", "l"), ("c", 1, 4, "process", "y", None, None)], "chunk_id string, id_service long, id_variation long, type string, content string, municipality string, list_key string")
    kind = "case_id string, id_service long, id_variation long, targets array<struct<id_service long, id_variation long, types array<string>>>, ids array<string>, places array<struct<municipality string, list_key string>>, pinned boolean, also_services array<long>"
    rule = ("k", 1, None, [(1, None, ["faq"])], [], [], None, [])
    assert {tuple(r) for r in gold.curated(spark.createDataFrame([rule], kind), blocks).collect()} == {("k", "a", 2), ("k", "b", 2), ("k", "c", 1)}
    for n, wrong in ((3, [(1, None, ["faq", "forms"])]), (4, ["z"]), (5, [("m", "other")])):
        with pytest.raises(ValueError):
            gold.curated(spark.createDataFrame([(*rule[:n], wrong, *rule[n + 1 :])], kind), blocks)


def test_streams(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for n, lines in enumerate([[("a", "failed"), ("b", "ok")], [("a", "ok"), ("b", "ok")]]):
        (log / f"{n}.json").write_text("\n".join(json.dumps({"key": k, "status": s}) for k, s in lines))
        time.sleep(0.01)
    done = flows.manifest_stream(spark, str(log), 1).writeStream.format("memory").queryName("done").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    done.awaitTermination()
    assert sorted(r["key"] for r in spark.table("done").collect()) == ["a", "b"]
    docs = tmp_path / "docs"
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(str(docs))
    index = tmp_path / "index"
    spark.createDataFrame([(1, "a")], "id long, text string").write.parquet(str(index / "generation=-1"))
    flows.upkeep(spark.readStream.schema("doc_id long, text string").parquet(str(docs)), str(index), "doc_id", "text", str(tmp_path / "c3")).processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert sorted(r["id"] for r in spark.read.parquet(str(index)).where("generation >= 0").collect()) == [2]
