"""The thin queries of the operators over the standard tables, and their SQL."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bytepair, clustering, decontam, packing, pii, quality, repeats, secretscan, simhash, spelling, topk, toxicity, urlfilter
from quern.llm.common import only


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


OP1_SQL = """
WITH bits AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS b FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
codes AS (SELECT id, array_to_string(b, '')::BIT AS code FROM bits),
pairs AS (
  SELECT q.id AS query_id, r.id AS neighbor_id, bit_count(xor(q.code, r.code)) AS distance
  FROM codes q JOIN codes r ON q.id % 100 = 0 AND q.id <> r.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, neighbor_id, distance::BIGINT AS distance, rank FROM ranked WHERE rank <= 10
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer() -> dict[str, str]:
    """The tokenizer's file, and the same vocabulary as ranks."""
    import public_tokenizers

    return {"tokenizer_file": public_tokenizers.path("byte_bpe_50k.json"), "ranks_file": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), **tokenizer())


#: (verdict, host and path)
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a page's path is its document's, whose quality label marks the page."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    marks = labels.groupBy(F.col("doc_id").alias("number")).agg((F.min("quality") == 0).alias("bad")).where("bad IS NOT NULL")
    numbered = pages.select("url", F.expr("try_cast(regexp_extract(url, '^.*?://[^/?#]*/[^?#]*?([0-9]+)', 1) AS BIGINT)").alias("number"))
    labelled = numbered.join(marks, "number").select("url", "bad")
    return urlfilter.judge(pages, labelled, URL_RULES)


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
         coalesce(regexp_extract(url, '^.*?://[^?#]*(.*)$', 1, 's'), '') AS tail,
         try_cast(regexp_extract(url, '^.*?://[^/?#]*/[^?#]*?([0-9]+)', 1) AS BIGINT) AS number
  FROM pages),
worded AS (
  SELECT *, list_distinct(list_concat(list_concat(
      list_transform(list_filter(string_split(host, '.'), lambda w: w <> ''), lambda w: 'h:' || w),
      list_transform(list_filter(list_transform(regexp_split_to_array(path, '[/.]'), lambda w: regexp_replace(w, '[0-9]+', '#', 'g')), lambda w: w <> ''), lambda w: 'p:' || w)),
      list_transform(list_filter(list_transform(regexp_split_to_array(tail, '[?&#]'), lambda w: regexp_extract(w, '^([^=]*)', 1)), lambda w: w <> ''), lambda w: 'q:' || w))) AS words
  FROM parts),
marks AS (SELECT doc_id AS number, min(quality) = 0 AS bad FROM labels GROUP BY 1 HAVING min(quality) IS NOT NULL),
baskets AS (SELECT row_number() OVER () AS b, words, bad FROM worded JOIN marks USING (number)),
whole AS (SELECT count(*) AS n_all, count(*) FILTER (bad) AS bad_all, greatest(3, ceil(0.02 * count(*) FILTER (bad))) AS least FROM baskets),
masks AS (SELECT b, list_sort(words) AS w, unnest(generate_series(1, (2 ** len(words))::BIGINT - 1)) AS mask FROM baskets WHERE bad),
subsets AS (SELECT list_filter(w, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS needed FROM masks),
often AS (SELECT needed, count(*) AS hits FROM subsets GROUP BY 1 HAVING count(*) >= (SELECT least FROM whole)),
counted AS (SELECT needed, hits, count(*) AS n FROM often JOIN baskets ON list_has_all(words, needed) GROUP BY 1, 2),
strong AS (
  SELECT needed, hits * ln(hits * n_all / (n * bad_all)::DOUBLE) + CASE WHEN n > hits THEN (n - hits) * ln((n - hits) * n_all / (n * (n_all - bad_all))::DOUBLE) ELSE 0 END AS strength
  FROM counted, whole WHERE hits * n_all >= 1.5 * n * bad_all),
mined AS (SELECT needed FROM strong WHERE strength >= ln((SELECT count(*) FROM often) / 0.01) - 1e-9),
given(rule, verdict, rhost, rpath) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
best AS (
  SELECT url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT url, host, path FROM parts) JOIN given ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN EXISTS (SELECT 1 FROM mined WHERE list_has_all(words, needed)) THEN 'block' ELSE 'allow' END) AS verdict
FROM worded LEFT JOIN best ON worded.url = best.url
"""


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), window=20)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret in spark.quern.surrogateKey; a random one for this run alone where that is unset."""
    own = spark.conf.get("spark.quern.surrogateKey", None)
    return own.encode() if own else secrets.token_bytes(32)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_documents(table(spark, sf_dir, "documents"), surrogate_key(spark))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.find_secrets(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: crc32 byte by byte, over a table made by its rule; near words share what is left when a character of one, or of both at one place, is taken out.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda c: list_reduce(list_concat([c::BIGINT], range(8)), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT)) AS t),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS key, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per_doc AS (SELECT key, run, count(*) AS n, hex(encode(key || ':' || run)) AS hx FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])::BIGINT)) AS h
  FROM per_doc, crc),
formed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM formed WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY 1),
found AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best ON w.word = best.word),
chain(word, place) AS (SELECT word, word FROM found UNION ALL SELECT chain.word, found.form FROM chain JOIN found ON chain.place = found.word WHERE found.form IS NOT NULL),
roots AS (SELECT chain.word, chain.place AS root FROM chain JOIN found ON chain.place = found.word WHERE found.form IS NULL)
SELECT found.word, form, root, n, n_near, form_n FROM found JOIN roots ON found.word = roots.word
"""


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed="3")


def op12_sql(k: int = 8, rounds: int = 10) -> str:
    """Each round in two steps: all distances, then the means."""
    steps = ["""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""", f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INT AS cluster, v AS c FROM kept ORDER BY cluster LIMIT {k})"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT r, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept CROSS JOIN c{i}) GROUP BY r)""")  # fmt: skip
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m
    FROM (SELECT cluster, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY 1, 2) GROUP BY 1) USING (cluster))""")  # fmt: skip
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


def op13_bytepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = tokenizer()["tokenizer_file"]
    ids = bytepair.encode(only(table(spark, sf_dir, "documents"), "doc_id", "text"), file).drop("text")
    return bytepair.decode(ids, file).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


QUERIES = {f.__name__: f for f in (op1_topk, op2_quality, op3_packing, op4_url_filter, op5_repeats, op6_simhash, op7_pii, op8_decontamination, op9_secrets, op10_toxicity, op11_spelling, op12_clustering, op13_bytepair)}
ORACLE_SQL: dict[str, str] = {"op1_topk": OP1_SQL, "op4_url_filter": OP4_SQL, "op11_spelling": OP11_SQL, "op12_clustering": op12_sql()}
