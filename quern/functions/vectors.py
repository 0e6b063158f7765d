"""Vectors as arrays: products, and a deterministic embedding for tests and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import col, tokens


def dot(a: Column | str, b: Column | str) -> Column:
    """In the arrays' order, in doubles."""
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """Length one; a zero vector stays zero."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(col(v), lambda x: x / length)).otherwise(col(v))


def hash_embedding(text: Column | str, dims: int = 256, seed: int = 11) -> Column:
    """Sum of signed hash directions of the text's tokens, of length one; no tokens give zeros.

    The text should be in normal form: this runs inside lambdas, where Python can't.
    """
    zeros = F.array_repeat(F.lit(0.0), dims)

    def direction(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.pmod(F.xxhash64(t, i, F.lit(seed)), F.lit(2001)).cast("double") / 1000 - 1)

    return unit(F.aggregate(tokens(text, is_normal=True), zeros, lambda s, t: F.zip_with(s, direction(t), lambda a, b: a + b)))


def embedding_key(model: str, dims: int, text: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(dims)), col(text)).cast("binary"), 256)


def embedding_input(text: Column | str, most: int = 24_000) -> Column:
    """What is embedded: at most so many characters, never empty."""
    t = F.substring(F.coalesce(col(text), F.lit("")), 1, most)
    return F.when(t == "", F.lit(" ")).otherwise(t)
