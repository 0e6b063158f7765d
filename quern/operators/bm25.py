"""BM25 over rows of text, and statistics of their terms; queries come in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import content_words, distinct_tokens, stem
from quern.operators import postings
from quern.profile import MACEDONIAN, Profile
from quern.tables import spread


def terms(rows: DataFrame, id_col: str, text_col: str, profile: Profile = MACEDONIAN, do_stem: bool = True) -> DataFrame:
    """(id, length, term), one row for each token; stems are made after the explode, in compiled code."""
    own = rows.select(F.col(id_col).alias("id"), content_words(text_col, profile).alias("w"))
    one = own.select("id", F.size("w").alias("length"), F.explode("w").alias("term"))
    return one.withColumn("term", stem("term", profile)) if do_stem else one


def document_lengths(rows: DataFrame, id_col: str, text_col: str, profile: Profile = MACEDONIAN) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.size(content_words(text_col, profile)).alias("length"))


def distinct_terms(rows: DataFrame, id_col: str, text_col: str, profile: Profile = MACEDONIAN) -> DataFrame:
    """(id, term), once for each row and term: repeats go before anything is shuffled."""
    own = spread(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return own.select("id", F.explode(distinct_tokens("text", profile)).alias("term"))


def document_frequency(rows: DataFrame, id_col: str, text_col: str, profile: Profile = MACEDONIAN) -> DataFrame:
    """(term, df): rows that hold the term; each row counts once."""
    return distinct_terms(rows, id_col, text_col, profile).groupBy("term").agg(F.count("*").alias("df"))


def rare_terms(rows: DataFrame, id_col: str, text_col: str, most: int = 8, letters: int = 4, profile: Profile = MACEDONIAN) -> DataFrame:
    """(term, df, ids) of terms in at most so many rows.

    Counts are summed before the shuffle, and only rare terms' ids are gathered.
    """
    seen = distinct_terms(rows, id_col, text_col, profile).where(F.char_length("term") >= letters)
    rare = seen.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") <= most)
    return seen.join(rare, "term").groupBy("term").agg(F.max("df").alias("df"), F.sort_array(F.collect_list("id")).alias("ids"))


def search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, profile: Profile = MACEDONIAN, do_stem: bool = True, digits: int | None = None, at_once: int = postings.QUERIES) -> DataFrame:
    """(query_id, id, score, rank) for a batch (query_id, query): builds the index of the rows and searches it.

    Keep the index (postings.build) where one table is searched again.
    """
    return postings.search(postings.build(rows, id_col, text_col, profile, do_stem), queries, k, k1, b, digits, at_once)
