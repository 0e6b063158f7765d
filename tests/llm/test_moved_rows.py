"""What the near-duplicates stage moves: each pair once, no texts, no meeting of two nodes by every shingle they share."""

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402
from quern.llm import nearcopies  # noqa: E402
from test_crowds import found  # noqa: E402


def test_a_pair_is_told_by_one_task(spark):
    """Close pairs share many of the 42 tables, in cells that lie in several tasks."""
    r = np.random.default_rng(5)
    codes = r.integers(0, 2**64, (3000, nearcopies.WORDS), np.uint64)
    bits = np.unpackbits(codes.view(np.uint8), axis=1)
    for row in bits:
        row[r.choice(len(row), 40, replace=False)] ^= 1
    rows = found(spark, np.concatenate([codes, np.packbits(bits, axis=1).view(np.uint64)])).collect()
    assert {(x["u"], x["v"]) for x in rows} == {(i, 3000 + i) for i in range(3000)}
    assert len(rows) < 1.2 * 3000


def test_texts_stay_where_they_are(spark, capsys):
    docs = spark.range(0, 40_000, 1, 5).select("id", F.concat(F.lit("text "), "id").alias("text"))
    own = nearcopies._in_chunks(docs)
    rows = own.where("id % 7 = 0 OR id >= 39990").select(F.col(nearcopies._ROW).alias("row"))
    got = nearcopies._marked(own, rows)
    assert sorted(x["id"] for x in got.collect()) == [i for i in range(40_000) if i % 7 == 0 or i >= 39_990]
    assert nearcopies._marked(own, rows.limit(0)).count() == 0
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nearcopies._marked(own, rows).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    blocks = capsys.readouterr().out.split("\n\n")
    assert any("Scan parquet" in x and "text#" in x and "Bucketed: true" in x for x in blocks)
    moved = [x for x in blocks if "Exchange" in x.partition("\nInput")[0]]
    assert moved and not any("text#" in x for x in moved)


def test_nodes_of_a_crowd_meet_few_times(spark):
    """Texts that share most of their shingles, no two of one root: a pair met by each shingle that both have early."""
    r = np.random.default_rng(8)
    base = r.integers(0, 2**62, 300)
    rows = []
    for i in range(40):
        own = base.copy()
        new = r.integers(5, 26)
        own[r.choice(300, new, replace=False)] = r.integers(0, 2**62, new)
        own = np.unique(own)
        odd = np.packbits(np.bincount((own.view(np.uint64) & nearcopies._BUCKET).astype(np.int64), minlength=512) & 1).view(np.int64)
        rows.append((i, i, own.tolist(), odd.tolist()))
    rest = spark.createDataFrame(rows, "node long, root long, shingles array<long>, parity array<long>")
    met = [(x["u"], x["v"]) for x in nearcopies._meetings(rest, 0.8).collect()]
    sets = [set(x[2]) for x in rows]
    want = {(i, j) for j in range(40) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want and want <= set(met)
    assert len(met) < 4 * len(set(met))
