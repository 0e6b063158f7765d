"""The near-duplicates stage against brute force."""

import random

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from quern.llm.queries import table  # noqa: E402


def plain_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """Indices of the rows that stay, without regard to rows equal in id and text."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or min(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                root[find(i)] = find(j)
    classes = {}
    for i, (k, _) in enumerate(rows):
        classes.setdefault(find(i), []).append((k is None, k or 0, i))
    return [min(c) for c in classes.values()]


def stage(spark, docs):
    return dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, None)


def near_texts(seed, groups=12, copies=12):
    r = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{r.randrange(400)}" for _ in range(r.randint(60, 260))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 30))):
                own[r.randrange(len(own))] = f"new{r.random()}"
            out.append(" ".join(own))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_stage_equals_brute_force(spark, seed):
    rows = [*enumerate(near_texts(seed)), (900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "one two three")]
    docs = spark.createDataFrame([(k, t, "en") for k, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = stage(spark, docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(k for _, k, _ in plain_kept(rows))


def test_stage_on_a_given_table(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in stage(spark, docs).collect()) == sorted(k for _, k, _ in plain_kept(rows))


def test_one_row_stays_of_null_and_shared_ids(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text), (None, text), (None, text + " more"), (None, "other words"), (7, "some text here"), (7, "some text here"), (7, "a text apart")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in stage(spark, docs).collect()]
    assert len(got) == 4 and {t for _, t in got} >= {"other words", "some text here", "a text apart"}
    got = [tuple(r) for r in stage(spark, docs.unionByName(spark.createDataFrame([(3, text + " end")], docs.schema))).collect()]
    assert len(got) == 4 and (3, text + " end") in got
