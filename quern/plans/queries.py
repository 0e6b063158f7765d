"""The reference operators applied to the standard tables: one registered query each.

Every query works on its whole tables; limits are only those of top-k results.
The vocabulary of these tables is Latin, so cues come from LATIN below.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import dates, html, text
from quern.operators import answers, bm25, context, dense, dialog, maintenance, metrics, postings, ranking, structured, tools
from quern.profile import MACEDONIAN
from quern.sources import corpus, crawl, directory, payloads
from quern.streaming import flows
from quern.tables import new_path, stored

K = 10
LATIN = replace(
    MACEDONIAN,
    intents={"process": ("then", "onth"), "documents": ("erst", "lich"), "tariffs": ("ment", "ción"), "access": ("the", "que")},
    aliases={"ther": ("inging", "ouould"), "cióng": ("osque",), "gege": ("enund", "lichkeit"), "mentm": ("eauxle",)},
    abstain=("worthless", "loser"),
    clarify=("stupid", "clown"),
)
ENGLISH_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _hits(spark: SparkSession, d: str, k: int = K, **how) -> DataFrame:
    return bm25.search(table(spark, d, "documents"), _items(spark, d), k, digits=6, profile=LATIN, **how)


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents of the same remainder by 40 as the item; good ones are primary."""
    labels = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("r"), F.when(F.col("toxic") == 0, 2).otherwise(1).alias("grade"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), (F.col("item_id") % 40).alias("r"))
    return items.join(labels, "r").select("case_id", "id", "grade")


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _six(c: str) -> Column:
    return F.round(F.col(c), 6).alias(c)


# text and statistics


def tokens_per_doc(spark, d):
    w = text.content_words("text")
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


def doc_freq(spark, d):
    return bm25.document_frequency(table(spark, d, "documents"), "doc_id", "text")


def rare_terms(spark, d):
    return _long(bm25.rare_terms(table(spark, d, "documents"), "doc_id", "text"), "df").select("term", "df", F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).alias("ids"))


def numbers_in(spark, d):
    n = text.numbers_in("text")
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", n).alias("numbers"))


def citations(spark, d):
    """Each text gets one citation of itself and one link, as an answer would have."""
    marked = F.concat("text", F.lit(" ["), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("] [here_there](https://example.org)"))
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", text.citations(marked)).alias("cited"))


def intent_detect(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(",", text.intents("text", LATIN)).alias("intents"))


def followups(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.is_followup("text").alias("followup"))


def printed_dates(spark, d):
    worded = F.date_format("o_orderdate", "d MMM yyyy")
    return table(spark, d, "orders").select("o_orderkey", dates.printed_date(worded, ENGLISH_MONTHS).alias("printed"), dates.date_ticks(F.date_format("o_orderdate", "dd.MM.yyyy"), "UTC").alias("ticks"))


def row_signatures(spark, d):
    rows = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 2 == 0, "tariffs").otherwise("documents")
    return rows.select("p_partkey", text.row_signature(kind, F.concat_ws("  ", "p_name", F.col("p_size").cast("string"), "p_type")).alias("signature"))


# retrieval


def bm25_topk(spark, d):
    return _long(_hits(spark, d), "rank")


def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _long(dense.search(e, asked, K), "rank")


def dense_topk_by_label(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("group"))
    return _long(dense.search(e, asked, K, group_col="label", threshold=0.05, exclude_self=True), "rank")


def _hybrid(spark, d, k, depth=50):
    e = table(spark, d, "embeddings")
    asked = _items(spark, d).join(e.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    return ranking.rrf([(_hits(spark, d, depth), 1.0), (dense.search(e, asked, depth), 1.0)], k, digits=9)


def hybrid_rrf(spark, d):
    return _long(_hybrid(spark, d, K), "rank")


def alias_rrf(spark, d):
    docs, items = table(spark, d, "documents"), _items(spark, d)
    wide = structured.expanded(items, profile=LATIN)
    more = wide.where(F.size("added") > 0).select("query_id", F.col("expanded").alias("query"))
    index = postings.build(docs, "doc_id", "text")
    first = stored(postings.search(index, items, 30, digits=6), "hits")
    second = postings.search(index, more, 30, digits=6)
    both = ranking.rrf([(first.join(more, "query_id", "left_semi"), 1.0), (second, 1.0)], K, digits=9)
    return _long(both.unionByName(first.join(more, "query_id", "left_anti").where(F.col("rank") <= K)), "rank")


def entity_rows(spark, d):
    docs = table(spark, d, "documents")
    return _long(structured.entity_rows(_items(spark, d), docs, "text", "doc_id", "doc_id"), "place")


def structured_rrf(spark, d):
    docs, items = table(spark, d, "documents"), _items(spark, d)
    rows = stored(structured.injected([structured.entity_rows(items, docs, "text", "doc_id", "doc_id")]), "rows")
    return _long(structured.fused(stored(_hits(spark, d, 30), "hits"), rows, K, digits=9), "rank")


def filtered_hits(spark, d):
    """Cut to 50 first, then filtered: the order matters."""
    keep = ranking.payload_filter({"lang": ["en", "de"], "source": [f"src{i}" for i in range(10)]})
    return _long(ranking.filtered(_hits(spark, d, 50), table(spark, d, "documents"), keep, K, "doc_id"), "rank")


def normalized_hits(spark, d):
    e = table(spark, d, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    hits = e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("id"), F.col("value").alias("score"), rank.alias("rank"))
    return _long(ranking.normalized_hits(hits, 3), "rank")


def attribution_votes(spark, d):
    """Whose question is it: the language by fused votes, the source by count."""
    blocks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source")
    return _long(structured.attribution(stored(_hits(spark, d, 30), "hits"), blocks, owner="lang", variant="source"), "rank")


def vote_top_per_group(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return _long(ranking.top(o, 3), "rank")


# context


def _listed(spark, d):
    """Each language's documents in order, with the digest of the text: texts don't move."""
    own = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), "source", F.sha2(F.col("text").cast("binary"), 256).alias("content"))
    return ranking.numbered(own, ["query_id"], ["id"]).withColumn("injected", F.col("id") % 2 == 0)


def dedup_content(spark, d):
    kept = context.without_copies(_listed(spark, d), "content", "source")
    return kept.select(F.col("query_id").alias("lang"), F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "injected", F.concat_ws(",", F.sort_array("also_in")).alias("also_in"))


def identical_content(spark, d):
    return context.identical(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "digest", "copies", "first_id")


def trim_pinned(spark, d):
    e = table(spark, d, "events")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    hits = e.select("user_id", F.col("event_id").alias("id"), rank.alias("rank"), (F.col("value") > 50).alias("pinned"))
    return _long(context.trimmed(hits, 8, by="user_id"), "rank")


def reading_order(spark, d):
    li = table(spark, d, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    hits = li.select(F.col("l_suppkey").alias("query_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), "l_orderkey", F.col("l_linenumber").alias("row"), rank.alias("rank"))
    return _long(context.reading_order(hits, ["l_orderkey"]), "rank", "position").select("query_id", "id", "rank", "position")


def section_coverage(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    found = li.where("l_quantity >= 25").withColumn("query_id", F.lit("bulk"))
    return context.section_coverage(found, li, ["l_orderkey"], profile=None)


def _as_blocks(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("id_service"), F.col("l_linenumber").alias("id_variation"), F.col("l_returnflag").alias("type"), F.concat_ws(" ", "l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("content"))


def differing_sections(spark, d):
    return context.differing_sections(_as_blocks(spark, d), "id_service", "id_variation", "type", "content")


def universal_rows(spark, d):
    """Rows whose content is the line's status alone, so that suppliers do share some."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("id_service"), F.col("l_linenumber").alias("id_variation"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("content"))
    return context.universal_rows(rows, "id_service", "id_variation", "type", "content")


def context_render(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source")
    hits = _hits(spark, d, 3).withColumn("position", F.col("rank"))
    return context.rendered(hits.join(docs, "id"), attributes=("lang", "source"))


# evaluation


def _metrics(spark, d, **how):
    return metrics.case_metrics(_hits(spark, d, 20, **how), _gold(spark, d))


def _cases(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.concat(F.lit("family"), (F.col("item_id") % 3).cast("string")).alias("family"), F.concat(F.lit("level"), (F.col("item_id") % 2).cast("string")).alias("difficulty"))


def ranking_metrics(spark, d):
    return _metrics(spark, d).select("case_id", "metric", _six("value"))


def eval_slices(spark, d):
    return metrics.sliced(_metrics(spark, d), _cases(spark, d), ("family", "difficulty")).select("slice", "key", "metric", "n", _six("mean"))


def p95(spark, d):
    return metrics.p95(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


def regression_gate(spark, d):
    slices = ("family", "difficulty")
    base = metrics.sliced(_metrics(spark, d), _cases(spark, d), slices)
    cand = metrics.sliced(_metrics(spark, d, k1=0.4, b=0.0), _cases(spark, d), slices)
    return metrics.compare(base, cand, "ndcg@10").select("slice", "key", _six("base"), _six("cand"), "regressed", "missing")


def oracle_ceiling(spark, d):
    return metrics.case_metrics(ranking.oracle_ceiling(_gold(spark, d), 20), _gold(spark, d), (10,)).select("case_id", "metric", _six("value"))


def answer_behaviour(spark, d):
    c = table(spark, d, "conversations")
    none = F.array().cast("array<string>")
    return c.select("conv_id", "turn", answers.behaviour("text", none, F.lit(False), LATIN).alias("behaviour"))


def answer_groundedness(spark, d):
    """Numbers of each turn against those of the turn before it."""
    c = table(spark, d, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("pool", F.coalesce(before, F.lit(""))).select("conv_id", "turn", F.round(answers.groundedness("text", "pool", F.lit("")), 6).alias("grounded"))


# dialog


def history_window(spark, d):
    h = dialog.history(table(spark, d, "conversations"))
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n"), F.sha2(F.array_join("history", "|").cast("binary"), 256).alias("sha"))


def topic_carry(spark, d):
    c = table(spark, d, "conversations").withColumn("subject", F.when(F.char_length("text") > 100, F.col("text")))
    return dialog.topic(c, "subject").select("conv_id", "turn", "topic")


def seen_docs(spark, d):
    c = table(spark, d, "conversations").withColumn("docs", text.content_words("text"))
    return dialog.seen(c, "docs").select("conv_id", "turn", F.concat_ws(",", F.sort_array("seen")).alias("seen"))


def turn_plan(spark, d):
    """The fold over each conversation's turns; without open questions its topic is a window in SQL."""
    return dialog.plan(table(spark, d, "conversations").where("role = 'user'"))


# index upkeep, sources


def incremental_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return maintenance.difference(old, docs.where("doc_id % 11 <> 0"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def embedding_estimate(spark, d):
    e = maintenance.estimate(table(spark, d, "documents"), "text")
    return e.select("rows", "characters", _six("tokens"), F.round("cost", 9).alias("cost"))


def payload_guard(spark, d):
    rows = [("pages", "page_id", "html"), ("events", "event_id", "props"), ("conversations", "conv_id", "text")]
    parts = [table(spark, d, t).select(F.lit(t).alias("of"), F.col(i).alias("id"), payloads.classified(c).alias("kind")) for t, i, c in rows]
    return metrics.union_all(parts)


def decode_tabular(spark, d):
    """Lines of each order as a self-describing table, and decoded again."""
    li = table(spark, d, "lineitem")
    line = F.struct("l_linenumber", "l_returnflag", "l_quantity")
    row = lambda x: F.create_map(F.lit("c1"), x["l_returnflag"], F.lit("c2"), F.replace(F.format_string("%.2f", x["l_quantity"]), F.lit("."), F.lit(",")), F.lit("Order"), x["l_linenumber"].cast("string"), F.lit("Id"), F.lit("x"))
    columns = F.array(*[F.struct(F.lit(c).alias("Column"), F.lit(t).alias("Title"), F.lit(f).alias("Format")) for c, t, f in (("c1", " Flag ", "String"), ("c2", "Amount", "Curency"))])
    packed = li.groupBy("l_orderkey").agg(F.to_json(F.struct(columns.alias("Columns"), F.transform(F.array_sort(F.collect_list(line)), row).alias("Data"))).alias("packed"))
    rows = packed.select("l_orderkey", F.posexplode(payloads.decoded("packed")).alias("i", "cells"))
    return rows.select("l_orderkey", (F.col("i") + 1).cast("long").alias("place"), payloads.row_text(F.array_sort("cells")).alias("body"))


def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.concat_ws(" ", html.links("html")).alias("links"))


def page_plain_text(spark, d):
    return table(spark, d, "pages").select("page_id", html.plain_html("html").alias("plain"))


def html_to_text(spark, d):
    """Parsed, not matched: entities and nesting as a reader sees them."""
    return table(spark, d, "pages").select("page_id", html.fix_links(html.html_to_text("html")).alias("plain"))


def directory_blocks(spark, d):
    named = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    one = directory.line(F.col("c_name"), F.lit(""), F.col("c_mktsegment"), F.col("n_name"), F.lit(""))
    return _long(directory.blocks(named.select(F.col("n_name").alias("municipality"), F.col("c_name").alias("name"), one.alias("line")), "customers"), "n_agents", "part", "n_parts", "first", "last")


def menu_paths(spark, d):
    """Region, nation, supplier as a tree of menus."""
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    key = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    edges = n.select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"), F.col("n_name").alias("title"))
    edges = edges.unionByName(s.select(key("n", "s_nationkey").alias("parent"), key("s", "s_suppkey").alias("child"), F.col("s_name").alias("title")))
    return _long(crawl.tree_paths(edges, r.select(key("r", "r_regionkey").alias("node"), F.col("r_name").alias("title"))), "depth")


def _log(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "purchase", "ok").otherwise("failed").alias("status"), "ts", "event_id")


def crawl_frontier(spark, d):
    return crawl.frontier(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), _log(spark, d))


def crawl_latest(spark, d):
    return crawl.latest(_log(spark, d), "key", "ts", "event_id").select("key", "status", "event_id")


def corpus_gate(spark, d):
    """Problems of documents read as blocks: a copy's key is its first one's, so keys repeat."""
    docs = table(spark, d, "documents")
    first = F.min("doc_id").over(Window.partitionBy("text"))
    blocks = docs.select(
        F.concat(F.lit("srv_"), (first % 50).cast("string"), F.lit("_"), first.cast("string")).alias("chunk_id"), F.col("doc_id").alias("pos"),
        F.when(F.col("lang") == "en", "service").otherwise("variation").alias("scope"), F.when(F.col("lang") == "fr", "other").otherwise("faq").alias("type"),
        (F.col("doc_id") % 50).alias("id_service"), F.when(F.col("lang") == "de", F.col("doc_id")).alias("id_variation"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("n_parts"),
        F.col("text").alias("content"), F.concat_ws("\n", "source", "text").alias("embedding_text"),
    )
    return corpus.block_problems(blocks).select(F.col("pos").alias("doc_id"), "problem")


def entity_search(spark, d):
    n = table(spark, d, "nation")
    asked = n.select(F.col("n_nationkey").alias("query_id"), F.lit("").alias("by_id"), F.concat(F.lit("CUSTOMER#0000"), F.lpad((F.col("n_nationkey") * 4).cast("string"), 3, "0")).alias("by_name"))
    found = tools.entity_search(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")), asked)
    return found.select("query_id", "id", "name")


def entity_index(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return _long(tools.entity_index(c.select(F.format_string("%07d", F.col("c_custkey")).alias("id"), F.col("c_name").alias("name")), s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))), "n_decisions")


def stream_windows(spark, d):
    """Daily counts by a stream of the events, run until all is read.

    Each batch tells only the windows that it changed, so windows older than the
    watermark leave the state; the last word on a window is that of its last batch.
    """
    at = new_path(spark, "stream")
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")  # a pattern may be a file or a folder
    counts = flows.windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), width="1 day")
    query = counts.writeStream.outputMode("update").option("checkpointLocation", f"{at}/log").trigger(availableNow=True)
    query.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")).start().awaitTermination()
    told = spark.read.parquet(f"{at}/out").groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return told.select(F.col("window.start").alias("day"), "event_type", "x.n", F.round("x.total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (
    tokens_per_doc, doc_freq, rare_terms, numbers_in, citations, intent_detect, followups, printed_dates, row_signatures,
    bm25_topk, dense_topk, dense_topk_by_label, hybrid_rrf, alias_rrf, entity_rows, structured_rrf, filtered_hits, normalized_hits, attribution_votes, vote_top_per_group,
    dedup_content, identical_content, trim_pinned, reading_order, section_coverage, differing_sections, universal_rows, context_render,
    ranking_metrics, eval_slices, p95, regression_gate, oracle_ceiling, answer_behaviour, answer_groundedness,
    history_window, topic_carry, seen_docs, turn_plan, incremental_diff, embedding_estimate, payload_guard, decode_tabular,
    page_links, page_plain_text, html_to_text, directory_blocks, menu_paths, crawl_frontier, crawl_latest, corpus_gate, entity_search, entity_index, stream_windows,
)}
