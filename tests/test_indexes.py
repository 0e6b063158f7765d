"""Stored postings, names by automata, index generations, probing, planner state and poisoned contexts."""

import math
import random
import re
import time
import uuid

import pytest
from pyspark.sql import functions as F

from quern.functions import text as text_functions
from quern.functions.batches import Terms
from quern.operators import ambiguity, bm25, dialog, generations, injection, phrases, postings, probing, structured, tools
from quern.plans.queries import LATIN
from quern.profile import MACEDONIAN
from quern.streaming import flows


def test_terms_equal_the_column_function(spark):
    r = random.Random(3)
    texts = ["Документите на друштвото се во Скопје", "ﬁne Ⅷ ÀB è İstanbul ẞ", "", "x" * 50, "регистрирање ување ација 12.5 ЃорЃи"] + ["".join(r.choice("абвгите отоиот ЖШ aZ9 .,") for _ in range(80)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    for profile in (MACEDONIAN, LATIN):
        for stems in (True, False):
            own = Terms(profile, stems)
            for row in df.select("t", text_functions.tokens("t", profile, stems).alias("want")).collect():
                assert own(row["t"]) == row["want"]


def plain_bm25(rows, query, k, k1=1.2, b=0.75):
    split, out = {i: t.split() for i, t in rows}, {}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    for w in query.split():
        df = sum(w in s for s in split.values())
        for i, s in split.items():
            if tf := s.count(w):
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(s) / mean))
    return sorted(((round(s, 9), i) for i, s in out.items()), key=lambda x: (-x[0], x[1]))[:k]


def test_stored_postings_give_exact_results_and_skip_blocks(spark, tmp_path, monkeypatch):
    r = random.Random(1)
    rows = [(i, " ".join(f"w{min(r.randrange(1, 200), r.randrange(1, 200))}" for _ in range(r.randrange(0, 30)))) for i in range(600)]
    rows += [(600 + i, "rare " * (5 + i % 3)) for i in range(12)] + [(700, ""), (701, None), (None, "rare rare"), (702, "same"), (703, "same")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, term string, block int").repartition(1).sortWithinPartitions("doc_id")
    index = postings.build(table, "doc_id", "text", path=str(tmp_path / "index"), block_rows=16)
    assert index.rows == 616
    again = postings.opened(spark, str(tmp_path / "index"))
    assert (again.rows, again.mean) == (index.rows, index.mean)
    queries = ["rare", "w1 w2 w2", "w150", "same", "unknown words", "", "w3 rare w77"]
    asked = spark.createDataFrame([(n, q) for n, q in enumerate(queries)] + [(99, None)], "query_id int, query string")
    chosen, own = [], postings.stored

    def spy(df, name):
        out = own(df, name)
        if name in ("bounds", "able"):
            chosen.append((name, out.where("q = 0").count()))
        return out

    monkeypatch.setattr(postings, "stored", spy)
    for at in (index, again):
        for many in (256, 2):
            got = {}
            for x in postings.search(at, asked, 10, digits=9, at_once=many).collect():
                got.setdefault(x["query_id"], []).append((x["rank"], round(x["score"], 9), x["id"]))
            clean = [(i, t or "") for i, t in rows if i is not None]
            for n, q in enumerate(queries):
                assert [(s, i) for _, s, i in sorted(got.get(n, []))] == plain_bm25(clean, q, 10), q
    # common words: most blocks can't reach the tenth score
    asked = spark.createDataFrame([(0, "w1 rare")], "query_id int, query string")
    chosen.clear()
    assert postings.search(index, asked, 5, digits=9).count() == 5
    assert dict(chosen)["able"] < dict(chosen)["bounds"] / 2
    plan = spark._jvm.PythonSQLUtils.explainString(index.postings.where(F.col("bucket").isin([3, 4])).where("term = 'w1'")._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*EqualTo\(term,w1\)", plan)


def test_postings_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id int, query string")
    assert bm25.search(none, asked, 3).count() == 0 and bm25.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), asked.limit(0), 3).count() == 0


@pytest.mark.parametrize("bounds", ["anywhere", "start", "whole"])
def test_names_equal_one_pattern_a_pair(spark, bounds):
    r = random.Random(7)
    letters = "abЦж _-.é"
    names = sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, 5))) for _ in range(60)} | {"Ab", "aB"})
    texts = ["".join(r.choice(letters.upper() + letters) for _ in range(r.randrange(0, 60))) for _ in range(80)] + ["", "ab" * 5000]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x")], "i int, t string, name string").repartition(3)
    known = spark.createDataFrame([(n,) for n in [*names, "", None]], "name string")
    got = {tuple(x) for x in phrases.find(rows, known, "t", "name", ("i",), bounds).collect()}
    before, after = {"anywhere": ("", ""), "start": (r"(?<!\w)", ""), "whole": (r"(?<!\w)", r"(?!\w)")}[bounds]
    want = {(i, n, m.start(), m.start() + len(n)) for i, t in enumerate(texts) for n in names for m in re.finditer(rf"{before}(?={re.escape(n.lower())}{after})", t.lower())}
    assert got == want


def test_longer_names_come_first(spark):
    rows = spark.createDataFrame([(1, "Газии Баба и Гази, стар Гази Бабин крај")], "i int, t string")
    names = spark.createDataFrame([("ГАЗИ",), ("ГАЗИ БАБА",), ("ГАЗИИ БАБА",), ("БАБА",), ("Гази Баби",)], "name string")
    got = sorted((r["begin"], r["name"]) for r in phrases.find(rows, names, "t", "name", ("i",), longest=True).collect())
    assert got == [(0, "ГАЗИИ БАБА"), (13, "ГАЗИ"), (24, "Гази Баби")]
    few = phrases.NAMES
    try:
        phrases.NAMES = 2
        every = phrases.find(rows, names, "t", "name", ("i",))
        assert {r["name"] for r in every.collect()} == {"ГАЗИ", "ГАЗИИ БАБА", "БАБА", "Гази Баби"}
        with pytest.raises(ValueError, match="longest"):
            phrases.find(rows, names, "t", "name", ("i",), longest=True)
    finally:
        phrases.NAMES = few
    assert phrases.find(rows, names.limit(0), "t", "name", ("i",)).count() == 0


def test_lookups_have_no_nested_loops(spark):
    names = spark.createDataFrame([("ЦЕНТАР",), ("КАРПОШ",)], "municipality string")
    asked = spark.createDataFrame([(0, "агенти во Центар"), (1, "предцентар"), (2, "Карпошка улица")], "query_id int, query string")
    found = structured.named_places(asked, names)
    entities = spark.createDataFrame([("0012", "Алфа ДОО", 5)], "id string, name string, number int")
    q = spark.createDataFrame([(0, "12", ""), (1, "", "алфа"), (2, "12", "бета"), (3, "", ""), (4, "13", "алфа")], "query_id int, by_id string, by_name string")
    searched = tools.entity_search(entities, q)
    replies = spark.createDataFrame([(0, "ад"), (1, "адвокат"), (2, "друштво со ограничена одговорност")], "query_id int, reply string")
    offered = spark.createDataFrame([(7, "АД", ["акционерско друштво"], 1), (8, "ДОО, ДООЕЛ", ["друштво со ограничена одговорност"], 2)], "id int, label string, synonyms array<string>, pos int")
    matched = ambiguity.matched_variation(replies, offered)
    assert sorted(map(tuple, found.collect())) == [(0, "ЦЕНТАР"), (2, "КАРПОШ")]
    assert sorted((r["query_id"], r["number"]) for r in searched.collect()) == [(0, 5), (1, 5)]
    assert sorted((r["query_id"], r["id"]) for r in matched.collect()) == [(0, 7), (2, 8)]
    for df in (found, searched, matched):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_only_anchored_services_vote(spark):
    docs = spark.createDataFrame([(0, 5, 1, "упис на залог"), (0, 6, 2, "бришење на фондација"), (1, 5, 1, "упис на залог")], "query_id int, id_service long, rank int, content string")
    blocks = spark.createDataFrame([(5, "Залог"), (6, "Фондација")], "id_service long, service_name string")
    asked = spark.createDataFrame([(0, "чекори за фондација"), (1, "нешто сосема друго")], "query_id int, query string")
    anchored = ambiguity.anchored_docs(asked, docs, blocks)
    assert {tuple(r) for r in ambiguity.anchored_votes(docs, anchored).collect()} == {(0, 6), (1, 5)}
    assert {tuple(r) for r in ambiguity.anchored_votes(docs, anchored.limit(0)).collect()} == {(0, 5), (1, 5)}


def test_cue_words_are_no_subject(spark):
    turns = spark.createDataFrame([(1, 0, "потребни документи"), (1, 1, "документи за залог"), (1, 2, "залог и хипотека"), (1, 3, None)], "conv_id long, turn long, text string")
    frequency = spark.createDataFrame([("залог", 3), ("хипотек", 90), ("документ", 5), ("потребн", 5)], "term string, df long")
    assert {tuple(r) for r in dialog.subject_terms(turns, frequency, 100).collect()} == {(1, 1, "залог"), (1, 2, "залог")}
    marked = {r["turn"]: r["subject"] for r in dialog.with_subject(turns, frequency, 100).collect()}
    assert marked == {0: False, 1: True, 2: True, 3: False}
    plans = {r["turn"]: r["query"] for r in dialog.plan(dialog.with_subject(turns, frequency, 100), subject="subject").collect()}
    assert plans[2] == "документи за залог залог и хипотека"


def test_point_ids_are_name_based(spark):
    names = ["a", "srv_1_v2_process_3", "агент", "x" * 300]
    own = uuid.UUID("12345678-1234-5678-1234-567812345678")
    for space in (uuid.NAMESPACE_URL, own):
        got = {r["n"]: r["p"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", generations.point_id("n", space).alias("p")).collect()}
        assert got == {n: str(uuid.uuid5(space, n)) for n in names}


def test_generations(spark, tmp_path):
    schema = "id string, text string, vector array<float>"
    rows = lambda *x: spark.createDataFrame([(i, t, [float(len(t or "")), 1.0]) for i, t in x], schema)
    index = generations.Generations(spark, str(tmp_path), rows().schema, model="m", dims=2, buckets=4, most=3)
    held = lambda v=None: {r["id"]: r["text"] for r in index.current(v).collect()}
    assert held() == {} and index.compact() is None
    one = index.apply(rows(("a", "1"), ("b", "1"), ("b", "1"), (None, "x"), ("e", None)), 0)
    assert held() == {"a": "1", "b": "1", "e": ""}
    two = index.apply(rows(("a", "2"), ("c", "2")), 1)
    assert held() == {"a": "2", "b": "1", "c": "2", "e": ""} and held(one.version) == {"a": "1", "b": "1", "e": ""}
    assert index.apply(rows(("a", "other")), 1) == two  # the batch ran before
    assert index._read(two).where("generation = 1").count() == 2  # only what changed is written
    with pytest.raises(ValueError, match="size"):
        index.apply(spark.createDataFrame([("z", "z", [1.0])], schema), 2)
    with pytest.raises(ValueError, match="anew"):
        generations.Generations(spark, str(tmp_path), rows().schema, model="m", dims=3).apply(rows(), 2)
    assert held() == {"a": "2", "b": "1", "c": "2", "e": ""} and index.versions() == [0, 1]
    index.apply(rows(("c", "2"), ("b", "3")), 2, whole=True)
    assert held() == {"b": "3", "c": "2"}
    four = index.apply(rows(("a", "4")), 3)  # compacts first: three generations were there
    assert held() == {"a": "4", "b": "3", "c": "2"} and len(four.generations) == 2
    back = index.rollback(two.version)
    assert held() == {"a": "2", "b": "1", "c": "2", "e": ""} and back.batch == 1
    with pytest.raises(RuntimeError, match="another writer"):
        index._publish(two.generations, 9, two)
    index.compact()
    before = held()
    assert index.purge(keep=1) and held() == before and len(index.versions()) == 1
    (tmp_path / "data" / "broken off").mkdir()
    assert held() == before and index.purge(keep=1) == ["broken off"]
    assert {r["point_id"] for r in index.current().collect()} == {str(uuid.uuid5(uuid.NAMESPACE_URL, i)) for i in before}


def test_probing(spark):
    records = spark.createDataFrame([("7405855", "7405855", None), ("07000001", "7000002", "7000001"), ("7000003", "7000004", "7000005"), (None, "1", "1"), ("0000012", "12", "12"), ("12", "12", "12")], "key string, read string, again string")
    asked = spark.createDataFrame([(0, "07405855"), (1, "7000001"), (2, "7000003"), (3, "9999999"), (4, "no digits"), (5, None), (6, "7405855"), (7, "12")], "q int, number string")
    got = {r["q"]: (r["key"], r["place"], r["reading"], r["outcome"]) for r in probing.probe(asked, records).collect()}
    assert got == {
        0: ("7405855", 2, 1, "found"), 1: ("07000001", 2, 2, "found"), 2: ("7000003", 1, None, "mismatch"), 3: (None, None, None, "missing"), 4: (None, None, None, "malformed"), 5: (None, None, None, "malformed"), 6: ("7405855", 1, 1, "found"), 7: ("12", 1, 1, "found"),
    }
    shown, refused = probing.split(probing.probe(asked, records))
    assert (shown.count(), refused.count()) == (4, 4)


def test_poisoned_contexts_read_back_as_they_were(spark):
    from quern.operators.context import rendered

    docs = spark.createDataFrame([(1, "plain <b>text</b> & \"quotes\"\n\nline", "s\"1'"), (2, None, None), (3, "", "x")], "id int, text string, source string")
    bad = injection.poisoned(docs, "text", "source")
    assert bad.count() == 18
    keyed = bad.select(F.concat_ws("|", F.col("id").cast("string"), "kind").alias("query_id"), "id", "kind", F.col("text").alias("content"), "source", F.lit(1).alias("position"))
    want = {r["query_id"]: r for r in keyed.collect()}
    for r in injection.parsed(rendered(keyed, attributes=("source",)), attributes=("source",)).collect():
        (doc,) = r["documents"]
        assert (doc["id"], doc["source"], doc["content"] or "") == (str(want[r["query_id"]]["id"]), want[r["query_id"]]["source"], want[r["query_id"]]["content"])
    # without escaping the suite finds the breakout
    raw = keyed.select("query_id", "kind", F.concat(F.lit('<documents><document id="1">\n'), "content", F.lit("\n</document></documents>")).alias("context"))
    sizes = {r["query_id"]: len(r["documents"] or []) for r in injection.parsed(raw).where("kind = 'tag breakout' AND query_id NOT LIKE '1|%'").collect()}
    assert set(sizes.values()) == {2}


def test_sessions_end_in_streams_as_in_batches(spark, tmp_path):
    kinds = [(7, ["АД", "акционерско друштво"]), (8, ["ДОО"])]
    rows = [(1, 0, 0, "Колку чини упис", True, True, 5, kinds, None), (1, 1, 10, "АД", False, False, None, None, None), (1, 2, 200, "а рокот?", False, False, None, None, None), (2, 0, 5, "Упис на ДОО", True, False, None, None, ["ДОО"]), (3, 0, 190, "Залог на возило", True, False, 6, kinds, None), (3, 1, 195, "акционерско друштво", False, False, None, None, None), (None, 0, 190, "no conversation", True, False, None, None, None)]
    schema = "conv_id long, turn long, minute int, text string, subject boolean, ambiguous boolean, service long, variations array<struct<id long, names array<string>>>, forms array<string>"
    turns = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("minute") * 60)).drop("minute")
    for n, part in enumerate(("ts < timestamp_seconds(1700000000 + 3600)", "ts >= timestamp_seconds(1700000000 + 3600)")):
        turns.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    with flows.rocksdb(spark):
        plans = flows.plan_stream(spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), idle="1 hour")
        query = plans.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    got = {(r["conv_id"], r["turn"], r["how"]): (r["query"], r["service_scope"], r["variation_scope"], r["form_scope"]) for r in spark.read.schema(plans.schema).parquet(str(tmp_path / "out")).collect()}
    none = (None, None, None, None)
    assert got == {
        (1, 0, "plain"): ("Колку чини упис", None, None, None), (1, 1, "reply"): ("Колку чини упис АД", 5, 7, None), (1, 1, "expired"): none, (1, 2, "plain"): ("а рокот?", None, None, None),
        (2, 0, "plain"): ("Упис на ДОО", None, None, ["ДОО"]), (2, 0, "expired"): none, (3, 0, "plain"): ("Залог на возило", None, None, None), (3, 1, "topic"): ("Залог на возило акционерско друштво", None, 7, None),
    }
    state = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: __import__("json").loads(p.json), query.recentProgress) if p["stateOperators"]]
    assert state[-1] == 2  # the conversation that stayed away holds no state
    batch = {(r["conv_id"], r["turn"], r["how"]) for r in dialog.plan_sessions(turns, 3_600_000).collect()}
    assert batch == set(got) - {(2, 0, "expired")}


def test_headers_are_located_by_their_labels(spark):
    from quern.sources import directory

    rows = [
        ("a", 0, ["Општина листа"]), ("a", 1, [None, " "]), ("a", 2, ["Име", None, "ОПШТИНА", "Телефон"]), ("a", 3, [" Ана  Б ", "x", "CKOПJE", "070"]), ("a", 4, ["", "x", "Битола", ""]), ("a", 5, ["В", None, None, None]), ("a", 6, ["Г", "", "Штип + $A$1:$B$2", None]),
        ("b", 0, ["no header"]), ("b", 1, ["x", "y"]), ("c", 0, None),
    ]
    found, lacking = directory.located(spark.createDataFrame(rows, "file string, row int, cells array<string>"))
    assert sorted((r["row"], r["municipality"], r["name"], r["place"], r["phone"]) for r in found.collect()) == [(3, "СКОПЈЕ", "Ана Б", None, "070"), (6, "ШТИП", "Г", None, "")]
    assert sorted(r["file"] for r in lacking.collect()) == ["b", "c"]


def test_refusals_wait_within_a_budget(spark):
    from quern.operators.maintenance import Refused, patient

    waits, left = [], [3]

    def encode(texts):
        if texts == ["never"] or left[0] > 0:
            left[0] -= 1
            raise Refused
        return [[1.0]] * len(texts)

    run = patient(encode, tries=5, budget=6, first=1.0, most=3.0, sleep=waits.append)
    assert run(["a", "b"]) == [[1.0], [1.0]] and len(waits) == 3 and 0.5 <= waits[0] <= 1 and 1 <= waits[1] <= 2 and 1.5 <= waits[2] <= 3
    assert run(["never"]) == [None] and len(waits) == 6  # the budget is used up
    assert run(["never"]) == [None] and len(waits) == 6 and run(["c"]) == [[1.0]]
