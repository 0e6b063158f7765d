"""Saved records by identifier, whatever the zero padding: candidates, one second reading, refusals.

A request may be spelled with or without leading zeros, and so may the key under
which a record was saved.  Each request gives four keys; the first that exists wins.
A record whose own identifier is another's is read once more (by another reader or
another column); if it still names another, it is refused, not returned.

Defined results: a request without digits is malformed; one without a record is
missing; requests that repeat are each answered; of records that share a key the
first by their text counts; null keys are left out; an empty table gives missing rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import digits, same_number


def candidates(number: Column | str) -> Column:
    """(place, key): the number as it was typed, without leading zeros, and padded to 8 and to 7 digits; each once."""
    typed = F.col(number) if isinstance(number, str) else number
    bare = F.regexp_replace(digits(typed), "^0+(?=.)", "")
    padded = lambda n: F.when(F.char_length(bare) < n, F.lpad(bare, n, "0")).otherwise(bare)
    forms = F.array_distinct(F.array(F.trim(typed), bare, padded(8), padded(7)))
    return F.transform(forms, lambda k, i: F.struct((i + 1).alias("place"), k.alias("key")))


def probe(requests: DataFrame, records: DataFrame, number: str = "number", key: str = "key", read: str = "read", again: str = "again") -> DataFrame:
    """requests with (key, place, reading, outcome): found, mismatch, missing or malformed.

    records are (key, read, again): the identifier that each reading of a saved
    record gave.  reading is 1 or 2: which one agreed with the request.
    """
    own = requests.withColumn("_request", F.monotonically_increasing_id())
    asked = own.where(F.coalesce(digits(F.col(number)), F.lit("")) != "").select("_request", number, F.inline(candidates(number)))
    saved = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.struct(F.col(read).alias("one"), F.col(again).alias("two"))).alias("x"))
    met = asked.join(saved, "key").groupBy("_request").agg(F.min_by(F.struct("key", "place", "x", number), "place").alias("m"))
    same = lambda c: F.coalesce(same_number(F.col(c)) == same_number(F.col(f"m.{number}")), F.lit(False))
    read_as = met.select("_request", "m.key", "m.place", F.when(same("m.x.one"), 1).when(same("m.x.two"), 2).alias("reading"))
    out = own.join(read_as, "_request", "left")
    malformed = F.coalesce(digits(F.col(number)), F.lit("")) == ""
    outcome = F.when(malformed, "malformed").when(F.col("key").isNull(), "missing").when(F.col("reading").isNull(), "mismatch").otherwise("found")
    return out.withColumn("outcome", outcome).drop("_request")


def split(probed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What may be shown, and the refusals with their reason."""
    return probed.where("outcome = 'found'"), probed.where("outcome <> 'found'")
