"""Spelling variants, centroid clustering and byte-pair encoding against plain versions and libraries."""

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from quern.llm import bytepair, clustering, spelling
from quern.llm.queries import tokenizer

DOCS = "doc_id long, text string, word string, gram string, n long, ids string, root string"


def made(spark, texts):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", "r") for i, t in texts], DOCS)


# 11


def plain_words(texts):
    counts = Counter()
    for key, text in texts:
        for run in spelling.RUN.findall(text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                word = "".join(c for i, c in enumerate(word) if i != h % len(word))
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [] for w in words}
    for a, b in combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def rows_of(df):
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


def edited(word, r, letters="abcÀÿz"):
    at, c = r.randrange(len(word) + 1), r.choice(letters)
    return r.choice([word[:at] + c + word[at:], word[: max(0, at - 1)] + word[at:], word[: max(0, at - 1)] + c + word[at:]])


@pytest.mark.parametrize("frequent", [0, 3, 10**9])
def test_variants_equal_brute_force(spark, frequent):
    r = random.Random(frequent)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randrange(5, 12))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "A" * 9]
    pool = [w for b in base for w in [b] * r.randrange(1, 9) + [x for x in (edited(b, r) for _ in range(4)) for _ in range(r.randrange(1, 6))]]
    texts = [(i, " ".join(r.choice(pool) for _ in range(60)) + r.choice([" × Ünïcode", "-x1y", ""])) for i in range(60)]
    texts += [(None, "nullid nullid nullid"), (7, None), (8, ""), (8, "twice twice twice"), (9, "veryveryvery" * 4000 + " " + "veryveryvery" * 4000), (10, ("veryveryvery" * 4000 + " ") * 2), (11, ("veryveryverz" + "veryveryvery" * 3999 + " ") * 9)]
    words = plain_words(texts)
    got = rows_of(spelling.variants(made(spark, texts).repartition(3), frequent=frequent, share=1e-4))
    assert len(got) == len(words) and set(got) == plain_variants(words)
    assert any(g[1] for g in got) and any(g[2] != g[1] and g[1] for g in got)


def test_grams_left_by_an_edit_are_at_least_as_many_as_the_bound_says():
    """Over random dictionaries: decompose a word and an edited one, count what stays in place."""
    r = random.Random(5)
    for trial in range(300):
        letters = "ab" if trial % 2 else "abcd"
        text = ["".join(r.choice(letters) for _ in range(r.randrange(5, 14))) for _ in range(30)]
        often = Counter(p[i : i + q] for w in text for p in ["\x01\x01\x01" + w + "\x02\x02\x02"] for q in (2, 3, 4) for i in range(len(p) - q + 1))
        grams = spelling.Grams({g: n for g, n in often.items() if n >= r.choice([1, 2, 8])}, 2, 4, r.choice([0, 4, 20]))
        for word in text:
            other = edited(word, r, letters)
            if other == word or len(other) < 5:
                continue
            for a, b in ((word, other), (other, word)):
                p, q = grams.padded(a), grams.padded(b)
                of_a, of_b = grams.decomposed(p), grams.decomposed(q)
                from_front, from_end = {(x, q[x:y]) for x, y in of_b}, {(len(q) - y, q[x:y]) for x, y in of_b}
                most = 0
                for cut in range(len(p) + 1):  # the best place to change from counting at the front to counting at the end
                    most = max(most, sum((x, p[x:y]) in from_front if y <= cut else (len(p) - y, p[x:y]) in from_end for x, y in of_a))
                least = len(of_a) - grams.bound(p, of_a)
                assert 1 <= least <= most, (a, b)


def test_variants_without_words(spark):
    assert rows_of(spelling.variants(made(spark, []))) == []
    assert rows_of(spelling.variants(made(spark, [(1, "once only"), (2, None)]))) == []
    with pytest.raises(ValueError, match="characters"):
        spelling.near_pairs(spark.createDataFrame([("abc", 3)], "word string, n long"), least=3)


def test_chains_end_at_their_roots(spark):
    forms = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(37)] + [("x", "w05")], "word string, form string")
    assert {r["root"] for r in spelling.last_of(forms).collect()} == {"w37"}


# 12


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(centroids)]
    out = [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept]
    most = 2**63 - 1
    of = lambda c: min(sum(d for _, n, d in out if n == c), most)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, min(d, most), of(c), min(sum(d for *_, d in out), most), digest[c]) for i, c, d in out)


@pytest.mark.parametrize("size", [1.0, 1e4, 1e9, 1e30])
def test_clusters_equal_plain_numbers(spark, size):
    r = np.random.default_rng(int(math.log10(size)))
    v = (r.integers(-4, 5, (120, 6)) * size / 8).tolist()
    v[50:90] = [v[50]] * 40  # one very common vector
    rows = [*enumerate(v), (None, v[3]), (5, v[5]), (5, v[6]), (200, v[0][:5]), (201, None), (202, [*v[0][:5], None]), (203, [*v[0][:5], float("nan")]), (204, [*v[0][:5], float("-inf")])]
    table = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, id long, cluster int").repartition(5)
    got = clustering.cluster(table, k=5, rounds=4, dims=6)
    want = plain_clusters(rows, 5, 4, 6)
    assert sorted((str(r["vec_id"]), *list(r)[1:]) for r in got.collect()) == want


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert clustering.cluster(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [0.5] * 64), (2, [0.5] * 64)]  # equal centroids: the smaller number has both
    got = clustering.cluster(spark.createDataFrame(rows, schema)).collect()
    assert {(r["vec_id"], r["cluster"], r["distance"], r["inertia"]) for r in got} == {(1, 0, 0, 0), (2, 0, 0, 0)}


def test_tournament_ties_and_limbs():
    t = clustering.Tournament([[0, 0], [2, 0], [0, 2], [2, 0]])
    x = np.array([[1.0, 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 2.0]])
    assert t.nearest(x, 2).tolist() == [0, 0, 1, 2] and t.distances(x, t.nearest(x, 2), 2).tolist() == [2, 1, 0, 1]
    for v in (0, -1, 5, 2**47, -(2**47), 2**200 + 3, -(2**190) + 17):
        assert sum(limb << 48 * i for i, limb in clustering.limbs(v)) == v


# 13


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer()["tokenizer_file"])


def strange_texts():
    r = random.Random(13)
    alphabet = "abcdeABC 0123  \n\t.,'!?éßЖж中文字ーกำ🙂  ‍́꟎\U000323b1\U0003d001"
    texts = ["", " ", "  ", "a", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "it's we'LL they're I'd", " " * 300 + "x", "\n" * 99, "a" * 5000, "ab" * 4000 + " ", "=" * 700, "the " * 3000, "͸ Ᲊ꟎", "x\r\n\r\n y"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 120))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x370, 0x2000), r.randrange(0x10000, 0x20000)])) for _ in range(60)) for _ in range(300)]
    texts.append(" ".join(texts[20:900]) * 3 + "z" * 70_000)
    texts.append((" ".join(texts[20:300]) + "wordwithoutbreak" * 40_000) * 2)
    return texts


def test_ids_and_texts_equal_the_library(spark, library):
    texts = strange_texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, None, 1, "x")], "doc_id long, text string, ids long, at string").repartition(3)
    file = tokenizer()["tokenizer_file"]
    coded = bytepair.encode(docs, file)
    got = {r["doc_id"]: r["ids"] for r in coded.collect()}
    for i, t in enumerate(texts):
        assert got[i] == library.encode(t, add_special_tokens=False).ids, repr(t[:60])
    assert got[None] == []
    back = bytepair.decode(coded.drop("text"), file)
    assert back.columns == ["doc_id", "at", "ids", "text"] and back.where("at <> 'x'").count() == 0
    for r in back.collect():
        assert r["text"] == (library.decode(r["ids"], skip_special_tokens=False) if r["ids"] else "")
        assert r["doc_id"] is None or r["text"] == texts[r["doc_id"]]


def test_documents_of_a_given_table_equal_the_library(spark, sf, library):
    from quern.llm.queries import op13_bytepair

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op13_bytepair(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_token_is_the_encoding_of_its_own_bytes_and_pairs_are_decided_right(library):
    own = bytepair.vocabulary_of(tokenizer()["tokenizer_file"])
    assert all(own.word(own.bytes[i]) == [i] for i in range(50_256))
    r, checked = random.Random(1), 0
    while checked < 3000:
        a, b = r.randrange(50_256), r.randrange(50_256)
        text = own.bytes[a] + own.bytes[b]
        if text.isalpha() and text.isascii():  # one word for the library too
            checked += 1
            assert own.apart(a, b) == (library.encode(text.decode()).ids == [a, b])


def test_odd_ids_are_passed_over(spark, library):
    file = tokenizer()["tokenizer_file"]
    rows = [(1, [64, None, -5, 10**6, 65]), (2, None), (3, []), (4, [50256, 64]), (5, [140, 245, 64])]
    got = {r["k"]: r["text"] for r in bytepair.decode(spark.createDataFrame(rows, "k int, ids array<int>"), file).collect()}
    assert got == {1: library.decode([64, 65]), 2: "", 3: "", 4: library.decode([50256, 64], skip_special_tokens=False), 5: library.decode([140, 245, 64])}
    assert bytepair.encode(spark.createDataFrame([], "text string"), file).count() == 0


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="plain byte-level"):
        bytepair.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
