"""SQL of the registered queries, in DuckDB's dialect."""

from __future__ import annotations

from quern.plans.queries import LATIN
from quern.profile import MACEDONIAN

_STOP = ", ".join(f"'{w}'" for w in LATIN.stopwords)


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def words(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[0-9A-Za-zЀ-ӿ]+'), lambda w: w NOT IN ({_STOP}))"


def _bm25(name: str, k: int, queries: str = "SELECT item_id AS query_id, text AS query FROM benchmark", k1: float = 1.2, b: float = 0.75) -> str:
    """CTEs that end in `name` (query_id, id, score, rank)."""
    return f"""
{name}_t AS (SELECT doc_id, {words('text')} AS w FROM documents),
{name}_n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {name}_t),
{name}_tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM {name}_t) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY 1),
{name}_q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({words('query')}) AS term FROM ({queries})) GROUP BY ALL),
{name}_s AS (
  SELECT query_id, doc_id AS id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / mean))), 6) AS score
  FROM {name}_q JOIN {name}_tf USING (term) JOIN {name}_df USING (term), {name}_n GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


def _dense(name: str, k: int, queries: str, where: str = "true") -> str:
    return f"""
{name}_p AS (SELECT q.query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM ({queries}) q, embeddings e WHERE {where}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_p) WHERE rank <= {k})"""


def _rrf(arms: list[str], k: int, name: str = "fused") -> str:
    union = " UNION ALL ".join(f"SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part FROM {a}" for a in arms)
    return f"""
{name}_s AS (SELECT query_id, id, round(sum(part), 9) AS score FROM ({union}) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


_GOLD = """
gold AS (
  SELECT b.item_id AS case_id, l.doc_id AS id, CASE WHEN l.toxic = 0 THEN 2 ELSE 1 END AS grade
  FROM benchmark b JOIN labels l ON l.quality = 1 AND l.doc_id % 40 = b.item_id % 40)"""


def _metrics(hits: str, name: str, ks: tuple[int, ...] = (1, 3, 5, 10, 20)) -> str:
    ideal = ", ".join(f"sum(CASE WHEN place <= {k} THEN (2.0 ^ grade - 1) / log2(place + 1) ELSE 0 END) AS i{k}" for k in ks)
    found = ", ".join(f"count(*) FILTER (rank <= {k}) AS n{k}, count(*) FILTER (rank <= {k} AND grade >= 2) AS f{k}, coalesce(sum((2.0 ^ grade - 1) / log2(rank + 1)) FILTER (rank <= {k} AND grade IS NOT NULL), 0) AS d{k}" for k in ks)
    rows = " UNION ALL ".join(
        f"SELECT case_id, '{m}@{k}' AS metric, {v} AS value FROM {name}_w"
        for k in ks
        for m, v in (
            ("hit", f"(coalesce(f{k}, 0) > 0)::INT::DOUBLE"), ("recall", f"coalesce(f{k} / nullif(main, 0)::DOUBLE, 0)"), ("precision", f"coalesce(f{k} / nullif(n{k}, 0)::DOUBLE, 0)"),
            ("coverage", f"coalesce(f{k} / nullif(least(main, {k}), 0)::DOUBLE, 0)"), ("mrr", f"CASE WHEN best <= {k} THEN 1.0 / best ELSE 0 END"), ("ndcg", f"coalesce(d{k} / nullif(i{k}, 0), 0)"),
        )
    )
    return f"""
{name}_g AS (SELECT case_id, count(*) FILTER (grade >= 2) AS main, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, id) AS place FROM gold) GROUP BY 1),
{name}_h AS (SELECT query_id AS case_id, min(rank) FILTER (grade >= 2) AS best, {found} FROM {hits} LEFT JOIN gold ON gold.case_id = query_id AND gold.id = {hits}.id WHERE rank <= {max(ks)} GROUP BY 1),
{name}_w AS (SELECT * FROM {name}_g LEFT JOIN {name}_h USING (case_id)),
{name} AS ({rows})"""


def _sliced(metric: str, name: str) -> str:
    return f"""
{name} AS (
  SELECT CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'all' END AS slice,
         CASE WHEN grouping(family) = 0 THEN family WHEN grouping(difficulty) = 0 THEN difficulty ELSE 'all' END AS key, metric, count(value) AS n, avg(value) AS mean
  FROM {metric} JOIN (SELECT item_id AS case_id, 'family' || item_id % 3 AS family, 'level' || item_id % 2 AS difficulty FROM benchmark) USING (case_id)
  GROUP BY GROUPING SETS ((metric), (metric, family), (metric, difficulty)))"""


def numbers(column: str) -> str:
    t = rf"regexp_replace(coalesce({column}, ''), '\[[^\]]*\](?:\([^)]*\))?', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?m)^\s*\**\s*\d+[.)]\s', '', 'g')"
    return rf"list_filter(list_transform(regexp_extract_all({t}, '\d[\d.,/\-]*\d|\d\d+'), lambda n: regexp_replace(n, '\D', '', 'g')), lambda n: length(n) >= 2)"


def _cues(column: str, cues: tuple[str, ...]) -> str:
    return rf"regexp_matches(lower({column}), '(^|[^\p{{L}}\p{{N}}_])({'|'.join(cues)})')"


_INTENTS = ", ".join(f"CASE WHEN {_cues('text', c)} THEN '{k}' END" for k, c in LATIN.intents.items())
_ADDED = "[]::VARCHAR[]"
for _word, _terms in LATIN.aliases.items():
    _ADDED = f"list_concat({_ADDED}, CASE WHEN {_cues('query', (_word,))} THEN [{', '.join(repr(t) for t in _terms)}] ELSE [] END)"

_ENTITIES = f"""
e_asked AS (SELECT DISTINCT item_id AS query_id, unnest({words('text')}) AS term FROM benchmark),
e_held AS (SELECT DISTINCT doc_id, unnest({words('text')}) AS term FROM documents),
e_rare AS (SELECT term FROM e_held GROUP BY 1 HAVING count(*) <= 8),
e_n AS (SELECT query_id, doc_id AS id, count(*) AS n FROM e_asked JOIN e_rare USING (term) JOIN e_held USING (term) WHERE length(term) >= 4 GROUP BY ALL),
e_best AS (SELECT *, max(n) OVER (PARTITION BY query_id) AS best FROM e_n),
e_rows AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS place FROM e_best WHERE n = best AND n >= 2)"""

_LISTED = """
listed AS (SELECT lang, doc_id, source, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank, doc_id % 2 = 0 AS injected FROM documents)"""

_BLOCKS = "SELECT l_suppkey AS id_service, l_linenumber AS id_variation, l_returnflag AS type, lower(l_linestatus || ' ' || l_quantity::INT) AS content FROM lineitem"


def _guard(of: str, key: str, column: str) -> str:
    waf = " OR ".join(f"contains(head, '{m}')" for m in ("access denied", "signature id", "request rejected", "request unsuccessful", "blocked", "<html"))
    soft = " OR ".join(f"contains(head, '{m}')" for m in ("ticket id", "not available at the moment", "contact support"))
    return f"""
SELECT '{of}' AS "of", id, CASE WHEN t = '' THEN 'empty' WHEN starts_with(head, '<') OR {waf} THEN 'waf' WHEN length(t) < 2000 AND ({soft}) THEN 'soft_error'
  WHEN coalesce(json_extract_string(try_cast(CASE WHEN t[1] IN ('{{', '[') THEN t ELSE '{{' || t END AS JSON), '$.idService'), '') IN ('', '0', 'false', 'null') THEN 'bad_json' ELSE 'ok' END AS kind
FROM (SELECT id, t, lower(t[1:600]) AS head FROM (SELECT {key} AS id, regexp_replace({column}, '^[﻿\\s]+|\\s+$', '', 'g') AS t FROM {of}))"""


_XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

ORACLE_SQL = {
    "tokens_per_doc": f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, {words('text')} AS w FROM documents)",
    "doc_freq": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({words('text')}) AS term FROM documents) GROUP BY 1",
    "rare_terms": f"SELECT term, count(*) AS df, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM (SELECT DISTINCT doc_id, unnest({words('text')}) AS term FROM documents) WHERE length(term) >= 4 GROUP BY 1 HAVING count(*) <= 8",
    "numbers_in": f"SELECT doc_id, array_to_string({numbers('text')}, ',') AS numbers FROM documents",
    "citations": r"""
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(t, '\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\[\]\s]+)\]', 1), lambda c: contains(c, '_') AND NOT regexp_matches(lower(c), '^(http://|https://|www\.)')), ',') AS cited
FROM (SELECT doc_id, text || ' [' || source || '_' || doc_id || '] [here_there](https://example.org)' AS t FROM documents)""",
    "intent_detect": f"SELECT conv_id, turn, array_to_string(list_filter([{_INTENTS}], lambda x: x IS NOT NULL), ',') AS intents FROM conversations",
    "followups": f"""
SELECT conv_id, turn, len(w) > 0 AND (len(w) <= 3 OR w[1] IN ({', '.join(repr(x) for x in LATIN.openers)}) OR list_has_any(w, [{', '.join(repr(x) for x in LATIN.anaphors)}])
  OR {' OR '.join(f"contains(lower(text), '{x}')" for x in LATIN.continuations)}) AS followup
FROM (SELECT *, regexp_extract_all(lower(text), '[0-9A-Za-zЀ-ӿ]+') AS w FROM conversations)""",
    "printed_dates": "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS printed, epoch_us(date_trunc('day', o_orderdate)::TIMESTAMP) * 10 + 621355968000000000 AS ticks FROM orders",
    "row_signatures": r"""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN array_to_string(regexp_extract_all(c, '\d[\d.,]*'), '|') ELSE trim(regexp_replace(lower(c), '\s+', ' ', 'g')) END AS signature
FROM (SELECT *, p_name || '  ' || p_size || '  ' || p_type AS c FROM part)""",
    "bm25_topk": f"WITH {_bm25('hits', 10)} SELECT query_id, id, score, rank FROM hits",
    "dense_topk": f"WITH {_dense('hits', 10, 'SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0')} SELECT query_id, id, score, rank FROM hits",
    "dense_topk_by_label": f"WITH {_dense('hits', 10, 'SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 100 = 0', 'q.label = e.label AND q.query_id <> e.vec_id')} SELECT query_id, id, score, rank FROM hits WHERE score >= 0.05",
    "hybrid_rrf": f"WITH {_bm25('lexical', 50)}, {_dense('vector', 50, 'SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id')}, {_rrf(['lexical', 'vector'], 10)} SELECT query_id, id, score, rank FROM fused",
    "alias_rrf": f"""
WITH wide AS (SELECT item_id AS query_id, text AS query, list_filter({_ADDED.replace('query', 'text')}, lambda t: NOT contains(lower(text), t)) AS added FROM benchmark),
more AS (SELECT query_id, query || ' ' || array_to_string(added[1:6], ' ') AS query FROM wide WHERE len(added) > 0),
{_bm25('plain', 30)}, {_bm25('added', 30, 'SELECT * FROM more')},
touched AS (SELECT * FROM plain WHERE query_id IN (SELECT query_id FROM more)), {_rrf(['touched', 'added'], 10)}
SELECT query_id, id, score, rank FROM fused UNION ALL SELECT query_id, id, score, rank FROM plain WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM more)""",
    "entity_rows": f"WITH {_ENTITIES} SELECT query_id, id, place FROM e_rows WHERE place <= 4",
    "structured_rrf": f"""
WITH {_bm25('plain', 30)}, {_ENTITIES}, injected AS (SELECT query_id, id, place AS rank FROM e_rows WHERE place <= 4),
touched AS (SELECT * FROM plain WHERE query_id IN (SELECT query_id FROM injected)), {_rrf(['touched', 'injected'], 10)}
SELECT query_id, id, score, rank FROM fused UNION ALL SELECT query_id, id, score, rank FROM plain WHERE rank <= 10 AND query_id NOT IN (SELECT query_id FROM injected)""",
    "filtered_hits": f"""
WITH {_bm25('plain', 50)}, kept AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM plain JOIN documents ON doc_id = id
  WHERE lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9'))
SELECT query_id, id, score, rank FROM kept WHERE rank <= 10""",
    "normalized_hits": """
WITH hits AS (SELECT user_id AS query_id, event_type AS id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
one AS (SELECT query_id, id, min(r) AS r, max(value) AS score FROM hits GROUP BY ALL)
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM one) WHERE rank <= 3""",
    "attribution_votes": f"""
WITH {_bm25('hits', 30)}, votes AS (SELECT query_id, rank, lang, source FROM hits JOIN documents ON doc_id = id),
langs AS (SELECT query_id, lang, sum(1.0::DOUBLE / (60 + rank)) AS s, min(rank) AS best FROM votes GROUP BY ALL),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, best, lang) AS n FROM langs) WHERE n = 1),
sources AS (SELECT v.query_id, v.lang, f.best, source, count(*) AS c, min(rank) AS r FROM votes v JOIN first f ON v.query_id = f.query_id AND v.lang = f.lang GROUP BY ALL),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, r, source) AS n FROM sources) WHERE n = 1),
known AS (SELECT lang, count(DISTINCT source) AS k FROM documents GROUP BY 1)
SELECT query_id, chosen.lang, CASE WHEN k <= 1 OR c >= 2 THEN source END AS source, CASE WHEN k <= 1 OR c >= 2 THEN r ELSE best END AS rank FROM chosen JOIN known ON chosen.lang = known.lang""",
    "vote_top_per_group": "SELECT * FROM (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "dedup_content": f"""
WITH {_LISTED}, one AS (SELECT lang, text, arg_min(doc_id, rank) AS doc_id, arg_min(source, rank) AS own, min(rank) AS rank, bool_and(injected) AS injected, list(DISTINCT source) AS sources FROM listed GROUP BY ALL)
SELECT lang, doc_id, rank, injected, array_to_string(list_sort(list_filter(sources, lambda s: s <> own)), ',') AS also_in FROM one""",
    "identical_content": "SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY text) AS copies, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents",
    "trim_pinned": """
WITH hits AS (SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, value > 50 AS pinned FROM events),
first AS (SELECT *, row_number() OVER (PARTITION BY user_id, pinned ORDER BY rank) AS n FROM hits),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN pinned AND n <= 5 THEN 0 ELSE 1 END, rank) AS place FROM first)
SELECT user_id, id, rank, pinned FROM placed WHERE place <= 8""",
    "reading_order": """
WITH hits AS (SELECT l_suppkey AS query_id, l_orderkey || '-' || l_linenumber AS id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem),
best AS (SELECT *, min(rank) OVER (PARTITION BY query_id, l_orderkey) AS s FROM hits)
SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY s, l_orderkey, l_linenumber, rank, id) AS position FROM best""",
    "section_coverage": "SELECT 'bulk' AS query_id, l_orderkey, count(*) FILTER (l_quantity >= 25) AS present, count(*) AS total FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 AND count(*) FILTER (l_quantity >= 25) > 0",
    "differing_sections": f"""
WITH sets AS (SELECT id_service, type, id_variation, list_sort(list(content)) AS rows FROM ({_BLOCKS}) GROUP BY ALL)
SELECT id_service, type, count(DISTINCT rows) AS n_kinds, count(*) AS n_variations FROM sets GROUP BY ALL HAVING count(DISTINCT rows) >= 2""",
    "universal_rows": """
WITH b AS (SELECT l_suppkey AS id_service, l_linenumber AS id_variation, l_returnflag AS type, l_linestatus AS content FROM lineitem),
a AS (SELECT id_service, type, count(DISTINCT id_variation) AS n_all FROM b GROUP BY ALL HAVING count(DISTINCT id_variation) >= 2),
h AS (SELECT id_service, type, content, count(DISTINCT id_variation) AS n_held FROM b GROUP BY ALL)
SELECT id_service, type, content, n_held, n_all FROM h JOIN a USING (id_service, type) WHERE n_held = n_all""",
    "context_render": f"""
WITH {_bm25('hits', 3)}, parts AS (SELECT query_id, rank, '<document id="' || id || '" lang="' || lang || '" source="' || source || '">' || chr(10) || {_XML.format('text')} || chr(10) || '</document>' AS e FROM hits JOIN documents ON doc_id = id)
SELECT query_id, '<documents>' || chr(10) || string_agg(e, chr(10) ORDER BY rank) || chr(10) || '</documents>' AS context FROM parts GROUP BY 1""",
    "ranking_metrics": f"WITH {_bm25('hits', 20)}, {_GOLD}, {_metrics('hits', 'm')} SELECT case_id, metric, round(value, 6) AS value FROM m",
    "eval_slices": f"WITH {_bm25('hits', 20)}, {_GOLD}, {_metrics('hits', 'm')}, {_sliced('m', 's')} SELECT slice, key, metric, n, round(mean, 6) AS mean FROM s",
    "p95": """
WITH placed AS (SELECT l_returnflag, l_linestatus, l_extendedprice, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice))
SELECT l_returnflag, l_linestatus, l_extendedprice AS p95 FROM placed WHERE place = least(n - 1, floor(n * 0.95::DOUBLE))""",
    "regression_gate": f"""
WITH {_bm25('h1', 20)}, {_bm25('h2', 20, k1=0.4, b=0.0)}, {_GOLD}, {_metrics('h1', 'm1')}, {_metrics('h2', 'm2')}, {_sliced('m1', 's1')}, {_sliced('m2', 's2')}
SELECT s1.slice, s1.key, round(s1.mean, 6) AS base, round(s2.mean, 6) AS cand, coalesce(s2.mean, -1) < s1.mean - 0.01 AS regressed, s2.mean IS NULL AS missing
FROM s1 LEFT JOIN s2 ON s1.slice = s2.slice AND s1.key = s2.key AND s1.metric = s2.metric WHERE s1.metric = 'ndcg@10' AND (s1.slice = 'all' OR s1.n >= 10)""",
    "oracle_ceiling": f"""
WITH {_GOLD}, hits AS (SELECT * FROM (SELECT case_id AS query_id, id, row_number() OVER (PARTITION BY case_id ORDER BY grade DESC, id) AS rank FROM gold) WHERE rank <= 20), {_metrics('hits', 'm', (10,))}
SELECT case_id, metric, round(value, 6) AS value FROM m""",
    "answer_behaviour": f"""
SELECT conv_id, turn, CASE WHEN text = '' THEN 'error' WHEN len({numbers('text')}) > 0 THEN 'answer' WHEN contains(lower(text), 'worthless') OR contains(lower(text), 'loser') THEN 'abstain'
  WHEN contains(lower(text), 'stupid') OR contains(lower(text), 'clown') THEN 'clarify' ELSE 'answer' END AS behaviour FROM conversations""",
    "answer_groundedness": rf"""
WITH c AS (SELECT conv_id, turn, {numbers('text')} AS stated, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS pool FROM conversations),
k AS (SELECT *, list_concat({numbers('pool')}, list_filter(flatten(list_transform(regexp_extract_all(pool, '\d[\d.,/\-]*\d'), lambda n: regexp_split_to_array(n, '[.,/\-]+'))), lambda p: length(p) >= 2)) AS known FROM c)
SELECT conv_id, turn, CASE WHEN len(stated) > 0 THEN round(len(list_filter(stated, lambda n: list_contains(known, n))) / len(stated)::DOUBLE, 6) END AS grounded FROM k""",
    "history_window": "SELECT conv_id, turn, len(coalesce(h, [])) AS n, sha256(coalesce(array_to_string(h, '|'), '')) AS sha FROM (SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS h FROM conversations)",
    "topic_carry": "SELECT conv_id, turn, last_value(CASE WHEN length(text) > 100 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS topic FROM conversations",
    "seen_docs": f"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(flatten(coalesce(h, [])))), ',') AS seen
FROM (SELECT conv_id, turn, list({words('text')}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM conversations)""",
    "turn_plan": f"""
WITH t AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), '[0-9A-Za-zЀ-ӿ]+') AS w FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL),
f AS (SELECT *, len(w) > 0 AND (len(w) <= 3 OR w[1] IN ({_listed(MACEDONIAN.openers)}) OR list_has_any(w, [{_listed(MACEDONIAN.anaphors)}]) OR {' OR '.join(f"contains(lower(text), '{x}')" for x in MACEDONIAN.continuations)}) AS followup,
  len(list_filter(w, lambda x: length(x) >= 4 AND x NOT IN ({_listed((*MACEDONIAN.stopwords, *MACEDONIAN.generic_words))}))) > 0 AS subject FROM t),
p AS (SELECT *, coalesce(last_value(CASE WHEN subject THEN text END IGNORE NULLS) OVER o, first_value(text) OVER o) AS topic FROM f WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CASE WHEN topic <> '' AND (followup OR NOT subject) THEN 'topic' ELSE 'plain' END AS how FROM p)
SELECT conv_id, turn, CASE how WHEN 'topic' THEN trim(topic || ' ' || text) ELSE text END AS query, how FROM h""",
    "incremental_diff": """
WITH o AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, sha256(text) AS sha FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'pruned' WHEN o.sha = n.sha THEN 'unchanged' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
    "embedding_estimate": "SELECT count(*) AS rows, sum(length(text))::BIGINT AS characters, round(sum(length(text)) / 2.0::DOUBLE, 6) AS tokens, round(sum(length(text)) / 2.0::DOUBLE * 0.02 / 1e6, 9) AS cost FROM documents",
    "payload_guard": " UNION ALL ".join([_guard("pages", "page_id", "html"), _guard("events", "event_id", "props"), _guard("conversations", "conv_id", "text")]),
    "decode_tabular": """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity) AS place,
  'Amount: ' || CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE round(l_quantity, 2)::VARCHAR END || ' | Flag: ' || l_returnflag AS body FROM lineitem""",
    "page_links": """SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1), ' ') AS links FROM pages""",
    "page_plain_text": r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<li[^>]*>', chr(10) || '- ', 'g'), '(?i)<br[^>]*>|</(p|div|tr|h1|h2|h3|h4|ul|ol)>', chr(10), 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '[ \t' || chr(160) || ']+', ' ', 'g') AS t FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(t, ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM c)
SELECT page_id, trim(regexp_replace(t, '^\n+|\n+$', '', 'g')) AS plain FROM d""",
    "html_to_text": r"""
WITH a AS (SELECT page_id, array_to_string(list_transform(string_split(html, '</script>'), lambda part:
    regexp_extract(part, '(?is)^(.*?)(<script[^>]*>|$)', 1) || translate(regexp_extract(part, '(?is)<script[^>]*>(.*)$', 1), '<&', chr(1) || chr(2))), '') AS t FROM pages),
b AS (SELECT page_id, string_split(regexp_replace(t, '(?s)<!--.*?-->', '', 'g'), '</a>') AS parts FROM a),
c AS (SELECT page_id, array_to_string(list_transform(list_transform(parts, lambda part: {
    before: CASE WHEN regexp_matches(part, '<a\s') THEN regexp_extract(part, '(?s)^(.*?)<a\s', 1) ELSE part END, href: trim(regexp_extract(part, '(?s)<a\s[^>]*href="([^"]*)"', 1)), said: trim(regexp_replace(regexp_extract(part, '(?s)<a\s[^>]*>(.*)$', 1), '\s+', ' ', 'g'))}),
    lambda x: x.before || x.said || CASE WHEN x.href = '' OR contains(x.said, x.href) THEN '' WHEN x.said = '' THEN x.href ELSE ' (' || x.href || ')' END), '') AS t FROM b),
u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g') AS t FROM c),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<li[^>]*>', chr(10) || '- ', 'g'), '<br[^>]*>|</(p|div|tr|h1|h2|h3|h4|ul|ol)>', chr(10), 'g'), '</?[a-z!][^>]*>', '', 'gi') AS t FROM u),
e AS (SELECT page_id, translate(t, chr(1) || chr(2), '<&') AS t FROM d),
f AS (SELECT page_id, array_to_string(list_transform(string_split(regexp_replace(t, '[ \t' || chr(160) || ']+', ' ', 'g'), chr(10)), lambda line: trim(line)), chr(10)) AS t FROM e)
SELECT page_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS plain FROM f""",
    "directory_blocks": """
WITH a AS (SELECT n_name AS municipality, c_name AS name, c_name || ' | место: ' || c_mktsegment || ' | телефон: не е наведен' AS line FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT *, row_number() OVER (PARTITION BY municipality ORDER BY name) AS number, count(*) OVER (PARTITION BY municipality) AS n_agents FROM a),
g AS (SELECT municipality, (number - 1) // 40 + 1 AS part, ceil(n_agents / 40.0)::BIGINT AS n_parts, n_agents, min(number) AS first, max(number) AS last, string_agg(number || '. ' || line, chr(10) ORDER BY number) AS body FROM p GROUP BY ALL)
SELECT 'agents_customers_' || trim(regexp_replace(lower(municipality), '[^\\p{L}\\p{N}]+', '_', 'g'), '_') || '_p' || part AS chunk_id, 'customers' AS list_key, municipality, n_agents, part, n_parts, first, last,
  municipality || ': ' || n_agents || '.' || CASE WHEN n_parts > 1 THEN ' ' || part || '/' || n_parts || ' (' || first || '-' || last || ').' ELSE '' END || chr(10) || body AS content FROM g""",
    "menu_paths": """
WITH RECURSIVE edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, n_name AS title FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_name FROM supplier),
walk AS (SELECT 'r' || r_regionkey AS node, r_name AS path, 0::BIGINT AS depth FROM region UNION ALL SELECT child, path || ' > ' || title, depth + 1 FROM walk JOIN edges ON parent = node)
SELECT node, path, depth FROM walk""",
    "crawl_frontier": "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "crawl_latest": "SELECT user_id AS key, CASE WHEN event_type = 'purchase' THEN 'ok' ELSE 'failed' END AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "corpus_gate": """
WITH b AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY text) AS first FROM documents),
k AS (SELECT *, 'srv_' || first % 50 || '_' || first AS key FROM b)
SELECT doc_id, 'unknown type' AS problem FROM k WHERE lang = 'fr'
UNION ALL SELECT doc_id, 'id not in key' FROM k WHERE NOT contains(key, 'srv_' || doc_id % 50 || '_')
UNION ALL SELECT doc_id, 'no variation' FROM k WHERE lang NOT IN ('en', 'de')
UNION ALL SELECT doc_id, 'key repeats' FROM k WHERE key IN (SELECT key FROM k GROUP BY 1 HAVING count(*) > 1)""",
    "entity_search": "SELECT n_nationkey AS query_id, c_custkey::VARCHAR AS id, c_name AS name FROM customer JOIN nation ON contains(lower(c_name), 'customer#0000' || lpad((n_nationkey * 4)::VARCHAR, 3, '0'))",
    "entity_index": """
WITH every AS (SELECT ltrim(c_custkey::VARCHAR, '0') AS number, lpad(c_custkey::VARCHAR, 7, '0') AS id, c_name AS name, 1 AS p, 0 AS d FROM customer UNION ALL SELECT ltrim(s_suppkey::VARCHAR, '0'), s_suppkey::VARCHAR, s_name, 0, 1 FROM supplier)
SELECT number, arg_max(id, p * 10) AS id, arg_max(name, p * 10) AS name, max(p) = 1 AS has_profile, sum(d)::BIGINT AS n_decisions FROM every WHERE number <> '' GROUP BY 1""",
    "stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
