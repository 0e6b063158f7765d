"""Stages against plain versions, on whole small tables."""

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from quern.llm import decontam  # noqa: E402
from quern.llm.queries import QUERIES, table  # noqa: E402


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in at.collect()}
        at = spark.createDataFrame(stage(spark, at, sf).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in at.collect()}
        assert at.columns == docs.columns and set(after) <= set(before)
        if name == "quality":
            scores = {r["doc_id"]: r["predicted"] for r in QUERIES["op2_quality"](spark, sf).collect()}
            assert set(after) == {i for i in before if scores[i]}
        if name == "near_duplicates":
            assert len(set(after.values())) == len(after)
        if name == "decontamination":
            gone = {r["doc_id"] for r in decontam.contaminated(docs, table(spark, sf, "benchmark")).collect()}
            assert set(after) == set(before) - gone
        if name == "personal_data":
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in at.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf).collect()
    assert {r["doc_id"] for r in packed} == set(after) <= set(rows)
    assert sum(r["length"] for r in packed) == sum({r["doc_id"]: r["doc_tokens"] for r in packed}.values())


ODD = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, fp string, score double, entities string"


def test_stages_take_nulls_repeats_and_clashing_names(spark, sf):
    long = " ".join(f"word{i % 700}" for i in range(60_000))
    texts = [(None, None), (None, "several words without an id stand here"), (None, "other words without an id stand here too"), (1, ""), (2, " \n"), (3, "twice the same row here, in full"), (3, "twice the same row here, in full"), (4, long), (5, "mail joe.doe@mail.example.com or +44 20 1234 5678"), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 7, 7, "x", 0.5, "e") for i, t in texts], ODD)
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf).collect()
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0
        if name == "packing":
            assert len({r["sequence_id"] for r in rows}) > 1 and {r["doc_id"] for r in rows} == {i for i, _ in texts}
            continue
        assert none.columns == docs.columns
        kept = sorted(((r["doc_id"], r["text"]) for r in rows), key=str)
        if name == "quality":
            assert set(kept) <= set(texts)
        elif name == "near_duplicates":
            assert kept == sorted([(None, texts[1][1]), (None, texts[2][1]), (1, ""), texts[5], texts[7], texts[8]], key=str)
        elif name == "decontamination":
            assert kept == sorted(texts, key=str)
        else:
            assert [k for k, _ in kept] == [k for k, _ in sorted(texts, key=str)] and sum(t != u for (_, t), (_, u) in zip(kept, sorted(texts, key=str))) == 1
