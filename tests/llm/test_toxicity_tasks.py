"""Documents are read in parallel, a bounded sample meets in one task, settings come from training documents alone."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm import toxicity


def test_training_reads_documents_in_many_tasks(spark, tmp_path):
    folder = str(tmp_path)

    def noted(batches):
        from pyspark import TaskContext

        open(os.path.join(folder, str(TaskContext.get().partitionId())), "w").close()
        yield from batches

    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} {'vile' if i % 2 else 'fine'}") for i in range(80)], "doc_id long, text string")
    docs = docs.repartition(4).mapInArrow(noted, docs.schema)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).constant is None
    assert len(os.listdir(folder)) == 4
    assert toxicity.train(docs.where("doc_id < 0"), labels).constant == 0.0


def labelled(n):
    """Texts of common words; toxic ones hold one of two words, some clean ones a word that chance made look toxic."""
    r = random.Random(3)
    rows = []
    for i in range(n):
        own = [f"w{r.randrange(60)}" for _ in range(20)] + (["vile"] if i % 3 == 0 else ["odd"] if i % 50 == 1 else [])
        r.shuffle(own)
        rows.append((i, " ".join(own), int(i % 3 == 0)))
    return rows


def test_validation_equals_plain_folds(spark):
    sample = spark.createDataFrame(labelled(90), "id long, text string, label long")
    own = {r["id"]: r["own"] for r in sample.select("id", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(3)).alias("own")).collect()}
    settings = ((0.7, 0.0), (0.9, 0.01))
    got = {(r["setting"], r["part"]): (r["n"], r["loss"]) for r in toxicity.validation(sample, settings, 3, rounds=20).collect()}
    assert len(got) == 6
    for (setting, part), (n, loss) in got.items():
        kept = [x for x in labelled(90) if own[x[0]] != part]
        out = [x for x in labelled(90) if own[x[0]] == part]
        chain = toxicity.fit(pa.array([x[1] for x in kept]), np.array([x[2] > 0 for x in kept]), rounds=20, purity=settings[setting][0], doubt=settings[setting][1])
        q = np.clip(toxicity.predicted(pa.array([x[1] for x in out]), chain), 1e-4, 1 - 1e-4)
        plain = -sum(np.log(p) if x[2] else np.log(1 - p) for p, x in zip(q, out))
        assert n == len(out) and abs(loss - plain) < 1e-6 * max(1.0, plain)
    sums = {s: sum(v[1] for k, v in got.items() if k[0] == s) for s in (0, 1)}
    assert toxicity.chosen(sample, settings, 3, rounds=20) == settings[min(sums, key=lambda s: (round(sums[s], 6), s))]
    assert toxicity.chosen(sample.limit(0), settings) == settings[0]


def test_held_out_labels_change_nothing(spark):
    rows = labelled(200)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    results = []
    for turned in (False, True):
        labels = spark.createDataFrame([(i, y ^ (turned and out(i))) for i, _, y in rows], "doc_id long, toxic int")
        results.append({r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()})
    assert results[0] == results[1]


def test_sample_is_bounded_in_bytes_and_toxic_rows_alone(spark):
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(600)] + [(700, None), (701, "x" * 5_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(700, 1), (701, 1), (None, 1)], "doc_id long, toxic int")
    sample = toxicity.picked(docs, labels, max_bytes=2_000, max_total=60_000)
    by_class = {r["label"]: r["b"] for r in sample.groupBy("label").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    assert set(by_class) == {0, 1} and all(15_000 < b < 45_000 for b in by_class.values())
    assert sample.where("id = 701").count() == 0
    assert toxicity.train(docs, labels.where("toxic = 1")).constant == 1.0
    twice = docs.unionByName(spark.createDataFrame([(1, "other text")], docs.schema))
    assert toxicity.picked(twice, labels).where("id = 1").count() == 2
