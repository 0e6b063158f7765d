"""Retrievers by composition: each takes a batch of queries and gives ranked hits."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import dense, postings, structured
from quern.operators.context import differing_sections
from quern.operators.ranking import rrf
from quern.profile import MACEDONIAN, Profile
from quern.tables import stored

#: Rows that each arm gives before fusion, and the wrappers ask for.
ARM_DEPTH, WRAP_DEPTH, OVERFETCH = 50, 30, 4

Retriever = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Corpus:
    rows: DataFrame
    id_col: str = "chunk_id"
    text_col: str = "embedding_text"
    vectors: DataFrame | None = None  # (id_col, embedding)
    profile: Profile = MACEDONIAN


def lexical(corpus: Corpus) -> Retriever:
    """The index is built at the first search and kept for the others."""
    held: list[postings.Index] = []

    def run(queries: DataFrame, k: int) -> DataFrame:
        if not held:
            held.append(postings.build(corpus.rows, corpus.id_col, corpus.text_col, corpus.profile))
        return postings.search(held[0], queries, k)

    return run


def vector(corpus: Corpus) -> Retriever:
    """Queries carry their embedding."""
    return lambda queries, k: dense.search(corpus.vectors, queries.select("query_id", "embedding"), k, corpus.id_col, "embedding")


def hybrid(corpus: Corpus, depth: int = ARM_DEPTH, lexical_weight: float = 1.0, vector_weight: float = 1.0) -> Retriever:
    """Both arms at full depth, fused by ranks, then cut."""
    a, b = lexical(corpus), vector(corpus)
    return lambda queries, k: rrf([(a(queries, depth), lexical_weight), (b(queries, depth), vector_weight)], k)


def aliased(inner: Retriever, profile: Profile = MACEDONIAN, depth: int = WRAP_DEPTH) -> Retriever:
    """A second arm with added vocabulary, for the queries that get any."""

    def run(queries: DataFrame, k: int) -> DataFrame:
        wide = structured.expanded(queries, profile=profile)
        more = wide.where(F.size("added") > 0).drop("query").withColumnRenamed("expanded", "query")
        first, second = stored(inner(queries, max(k, depth)), "hits"), inner(more, max(k, depth))
        both = rrf([(first.join(more, "query_id", "left_semi"), 1.0), (second, 1.0)], k)
        return both.unionByName(first.join(more, "query_id", "left_anti").where(F.col("rank") <= k))

    return run


def with_structure(inner: Retriever, corpus: Corpus, depth: int = WRAP_DEPTH) -> Retriever:
    """Directory, entity and section rows beside the search, fused by ranks."""

    def run(queries: DataFrame, k: int) -> DataFrame:
        blocks, profile, most = corpus.rows, corpus.profile, structured.budget(k)
        found = stored(inner(queries, max(k, depth)), "hits")
        anchored = stored(structured.anchored_services(queries, found, blocks, profile), "anchored")
        owner = stored(structured.attribution(found, blocks, anchored), "owner")
        differs = differing_sections(blocks, "id_service", "id_variation", "type", "content")
        rows = stored(structured.injected([
            structured.directory_rows(queries, blocks, most, profile),
            structured.entity_rows(queries, blocks, corpus.text_col, corpus.id_col, profile=profile),
            structured.section_rows(queries, owner.select("query_id", "id_service", "id_variation"), blocks, differs, most, profile),
        ]), "rows")
        return structured.fused(found, rows, k)

    return run


BUILT_IN: dict[str, Callable[[Corpus], Retriever]] = {
    "bm25": lexical,
    "dense": vector,
    "hybrid": hybrid,
    "alias": lambda c: aliased(hybrid(c), c.profile),
    "lexical_alias": lambda c: aliased(lexical(c), c.profile),
    "structured": lambda c: with_structure(aliased(hybrid(c), c.profile), c),
    "lexical_structured": lambda c: with_structure(lexical(c), c),
}


def build(spec: str, corpus: Corpus) -> Retriever:
    """A built-in name, or module:function of a factory that takes the corpus."""
    if spec in BUILT_IN:
        return BUILT_IN[spec](corpus)
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)(corpus)
