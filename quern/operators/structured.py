"""Deterministic lookup beside search: whose question is it, and which rows does it ask for.

blocks are (chunk_id, pos, type, id_service, id_variation, variation_short_name,
service_name, content, list_key, municipality, part); pos is the order of the
registry.  hits are (query_id, id, rank).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import anchor_terms, content_words, intents, starts_word, stem, tokens
from quern.operators import phrases
from quern.operators.ranking import RRF_K, batch, rrf
from quern.profile import MACEDONIAN, Profile

MAX_ROWS, ENTITY_DF, ENTITY_TERMS = 15, 8, 2


def budget(k: int, most: int = MAX_ROWS) -> int:
    """Rows that may be injected: about half of k."""
    return min(most, max(3, k // 2 + 1))


def anchored_services(queries: DataFrame, hits: DataFrame, blocks: DataFrame, profile: Profile = MACEDONIAN) -> DataFrame:
    """(query_id, id_service) of hits that share a stem with the query's own anchor terms."""
    asked = queries.select("query_id", F.explode(anchor_terms("query", profile)).alias("term"))
    own = blocks.select(F.col("chunk_id").alias("id"), "id_service", F.array_distinct(tokens(F.concat_ws(" ", "service_name", "content"), profile)).alias("ts"))
    held = hits.select("query_id", "id").join(own, "id").where("id_service IS NOT NULL").select("query_id", "id_service", F.explode("ts").alias("term"))
    return held.join(asked, ["query_id", "term"], "left_semi").select("query_id", "id_service").distinct()


def attribution(hits: DataFrame, blocks: DataFrame, anchored: DataFrame | None = None, owner: str = "id_service", variant: str = "id_variation") -> DataFrame:
    """(query_id, owner, variant, rank): the owner by fused votes, then its variant by count.

    Only rows with a variant vote.  A variant needs two votes unless its owner has
    but one.  Without votes the first hit gives the owner alone.
    """
    rows = hits.select("query_id", "id", "rank").join(blocks.select(F.col("chunk_id").alias("id"), owner, variant), "id").where(F.col(owner).isNotNull())
    if anchored is not None:
        named = anchored.select("query_id", owner, F.lit(True).alias("named"))
        some = anchored.select("query_id").distinct().withColumn("some", F.lit(True))
        rows = rows.join(named, ["query_id", owner], "left").join(some, "query_id", "left").where("named OR some IS NULL").drop("named", "some")
    votes = rows.where(F.col(variant).isNotNull() & (F.col(variant) != 0)) if dict(blocks.dtypes)[variant] != "string" else rows.where(F.col(variant).isNotNull())
    by_owner = votes.groupBy("query_id", owner).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"), F.min("rank").alias("owner_rank"))
    first = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "owner_rank", owner)
    best = by_owner.withColumn("n", F.row_number().over(first)).where("n = 1").select("query_id", owner, "owner_rank")
    by_variant = votes.join(best, ["query_id", owner]).groupBy("query_id", owner, "owner_rank", variant).agg(F.count("*").alias("votes"), F.min("rank").alias("variant_rank"))
    second = Window.partitionBy("query_id").orderBy(F.desc("votes"), "variant_rank", variant)
    chosen = by_variant.withColumn("n", F.row_number().over(second)).where("n = 1")
    known = blocks.where(F.col(variant).isNotNull()).groupBy(owner).agg(F.count_distinct(variant).alias("n_variants"))
    sure = (F.coalesce("n_variants", F.lit(0)) <= 1) | (F.col("votes") >= 2)
    voted = chosen.join(known, owner, "left").select("query_id", owner, F.when(sure, F.col(variant)).alias(variant), F.when(sure, F.col("variant_rank")).otherwise(F.col("owner_rank")).alias("rank"))
    rest = rows.join(voted.select("query_id"), "query_id", "left_anti").groupBy("query_id").agg(F.min_by(owner, "rank").alias(owner), F.min("rank").alias("rank"))
    return voted.unionByName(rest.select("query_id", owner, F.lit(None).cast(dict(voted.dtypes)[variant]).alias(variant), "rank"))


def resolved(attributed: DataFrame, blocks: DataFrame, differing: DataFrame) -> DataFrame:
    """attributed with the variation to read, and refused where a choice would change the rows.

    Given, else the only one, else the first if the asked section doesn't differ.
    attributed has the asked type; differing is (id_service, type).
    """
    known = blocks.where("id_variation IS NOT NULL").groupBy("id_service").agg(F.min("id_variation").alias("first_variation"), F.count_distinct("id_variation").alias("n_variations"))
    marked = attributed.join(known, "id_service", "left").join(differing.select("id_service", "type", F.lit(True).alias("differs")), ["id_service", "type"], "left")
    many = F.coalesce("n_variations", F.lit(0)) > 1
    refused = F.col("id_variation").isNull() & many & F.coalesce("differs", F.lit(False))
    return marked.withColumn("refused", refused).withColumn("id_variation", F.when(~refused, F.coalesce("id_variation", "first_variation"))).drop("first_variation", "n_variations", "differs")


def section_rows(queries: DataFrame, attributed: DataFrame, blocks: DataFrame, differing: DataFrame, most: int = MAX_ROWS, profile: Profile = MACEDONIAN) -> DataFrame:
    """(query_id, id, place): rows of the section that the question asks for, in registry order.

    form_scope, an array in queries, overrides the attribution; a service without
    such a form gives no rows.  Without rows of the variation its shared rows serve.
    """
    asked = queries.withColumn("type", F.get(intents("query", profile, top_only=True), F.lit(0))).where("type IS NOT NULL")
    base = asked.join(attributed, "query_id").where("id_service IS NOT NULL")
    if "form_scope" in queries.columns:
        forms = blocks.where("id_variation IS NOT NULL").select("id_service", F.col("id_variation").alias("v"), F.col("variation_short_name").alias("f")).distinct()
        named = base.where("form_scope IS NOT NULL").join(forms, "id_service").where(F.array_contains("form_scope", F.col("f")))
        named = named.groupBy("query_id", "type", "id_service").agg(F.min("v").alias("id_variation"))
        base = base.where("form_scope IS NULL").select("query_id", "type", "id_service", "id_variation").unionByName(named)
    use = resolved(base.select("query_id", "type", "id_service", "id_variation"), blocks, differing).where("NOT refused")
    rows = blocks.select("chunk_id", "pos", "type", "id_service", F.col("id_variation").alias("of"))
    met = use.join(rows, ["id_service", "type"]).where("of IS NULL OR id_variation IS NULL OR of = id_variation")
    own = F.max(F.col("of").isNotNull()).over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "chunk_id"))
    kept = met.withColumn("any_own", own).where("NOT any_own OR of IS NOT NULL")
    return kept.withColumn("place", place).where(F.col("place") <= most).select("query_id", F.col("chunk_id").alias("id"), "place")


def entity_rows(queries: DataFrame, blocks: DataFrame, text_col: str = "embedding_text", id_col: str = "chunk_id", pos_col: str = "pos", most: int = 4, profile: Profile = MACEDONIAN) -> DataFrame:
    """(query_id, id, place): rows tied at most rare terms of the query, at least two.

    Only the batch's terms are counted in the rows.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens("query", profile))).alias("term"))
    asked = asked.where((F.char_length("term") >= 4) & ~F.col("term").isin(list(profile.generic_words)))
    wanted = batch(asked.select("term").distinct())
    own = blocks.select(F.col(id_col).alias("id"), F.col(pos_col).alias("pos"), F.explode(F.array_distinct(content_words(text_col, profile))).alias("term")).withColumn("term", stem("term", profile))
    held = own.join(wanted, "term", "left_semi").distinct()
    rare = held.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= ENTITY_DF)
    counted = held.join(rare, "term").join(asked, "term").groupBy("query_id", "id", "pos").agg(F.count("*").alias("n"))
    by_query = Window.partitionBy("query_id")
    tied = counted.withColumn("best", F.max("n").over(by_query)).where((F.col("n") == F.col("best")) & (F.col("n") >= ENTITY_TERMS))
    return tied.withColumn("place", F.row_number().over(by_query.orderBy("pos", "id"))).where(F.col("place") <= most).select("query_id", "id", "place")


def named_places(queries: DataFrame, places: DataFrame, profile: Profile = MACEDONIAN) -> DataFrame:
    """(query_id, municipality): names at a word's left boundary; a group's name stands for its members."""
    known = places.select("municipality").where("municipality IS NOT NULL").distinct()
    out = phrases.find(queries, known, "query", "municipality", ("query_id",)).select("query_id", F.col("name").alias("municipality"))
    q = queries.select("query_id", F.lower("query").alias("q"))
    for group, members in profile.municipality_groups.items():
        hit = q.where(starts_word(F.col("q"), (group.lower(),)))
        out = out.unionByName(hit.select("query_id", F.explode(F.array(*map(F.lit, members))).alias("municipality")).join(known, "municipality", "left_semi").select("query_id", "municipality"))
    return out.distinct()


def directory_rows(queries: DataFrame, blocks: DataFrame, most: int = 6, profile: Profile = MACEDONIAN) -> DataFrame:
    """(query_id, id, place): directory blocks of the named places, if the question asks for the directory.

    First parts of all lists come before second parts of any.  A question's first
    rows are among the first of each place, so no more of a place meet its questions.
    """
    own = blocks.where("municipality IS NOT NULL")
    order = (F.coalesce("part", F.lit(1)), F.coalesce("list_key", F.lit("")), "municipality", "chunk_id")
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("municipality").orderBy(*order))).where(F.col("place") <= most).drop("place")
    asked = queries.where(starts_word(F.lower("query"), profile.directory_cues))
    met = named_places(asked, own, profile).join(first, "municipality")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= most).select("query_id", F.col("chunk_id").alias("id"), "place")


def injected(parts: list[DataFrame]) -> DataFrame:
    """Ordered union: earlier parts first, each id once; (query_id, id, rank)."""
    marked = [p.select("query_id", "id", F.lit(i).alias("part"), "place") for i, p in enumerate(parts)]
    both = marked[0]
    for m in marked[1:]:
        both = both.unionByName(m)
    first = both.groupBy("query_id", "id").agg(F.min(F.struct("part", "place")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id"))).select("query_id", "id", "rank")


def fused(semantic: DataFrame, rows: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """Search results with injected rows by reciprocal ranks; queries without such rows stay as they are."""
    with_rows = rows.select("query_id").distinct()
    touched = rrf([(semantic.join(with_rows, "query_id", "left_semi"), 1.0), (rows, 1.0)], k, digits=digits)
    rest = semantic.join(with_rows, "query_id", "left_anti").where(F.col("rank") <= k)
    return touched.unionByName(rest.select("query_id", "id", "score", "rank"))


def expanded(queries: DataFrame, aliases: dict[str, tuple[str, ...]] | None = None, most: int = 6, profile: Profile = MACEDONIAN) -> DataFrame:
    """queries with added: at most six corpus terms whose user words the query has and they aren't in it."""
    table = profile.aliases if aliases is None else aliases
    q = F.lower("query")
    terms = F.flatten(F.filter(F.array(*[F.when(starts_word(q, (word,)), F.array(*map(F.lit, to))) for word, to in table.items()]), lambda x: x.isNotNull()))
    new = F.filter(F.array_distinct(terms), lambda t: ~F.contains(q, F.lower(t)))
    return queries.withColumn("added", F.slice(new, 1, most)).withColumn("expanded", F.concat_ws(" ", "query", F.array_join("added", " ")))
