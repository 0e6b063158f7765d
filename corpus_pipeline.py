"""From raw documents to packed sequences: quality, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of documents, further ones included,
whatever their names.

Defined results in every stage: a null or empty text is scored like an empty one
by the first stage and, if kept, passes the others unchanged (all of them are one
class of near duplicates); rows without an id, or with a shared one, are documents
of their own; repeated rows are near duplicates, of which one stays; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, nearcopies, packing, pii, quality
from quern.llm.common import stored
from quern.llm.queries import surrogate_key, table, tokenizer

_SCORE = "quern quality score"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, into=_SCORE).where(quality.accepted(score=f"`{_SCORE}`")).drop(_SCORE)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles of similarity 0.8 or more the document with the smallest id stays."""
    return nearcopies.keep_one(docs, width=5, least=0.8)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced; n_chars follows the text."""
    return pii.anonymise(docs, surrogate_key(spark), length_col="n_chars", into=None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **tokenizer())


STAGES = [("quality", good_quality), ("near_duplicates", no_near_duplicates), ("decontamination", no_benchmark), ("personal_data", no_personal_data), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express these stages; the tests hold each against a plain version.
ORACLE_SQL = None
