"""Payloads of services: the guard, tolerant reading, and tables that describe themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import any_of, col, once

# They decide results and are stated as given.
WAF_MARKERS = ("access denied", "signature id", "request rejected", "request unsuccessful", "blocked", "<html")
SOFT_MARKERS = ("ticket id", "not available at the moment", "contact support")
META_KEYS = ("Id", "Order", "Require", "IdValueType", "isSubPageId")
NUMERIC_FORMATS = ("curency", "currency", "number", "decimal")
SHARED_SECTIONS = ("terminology", "legalBasis")
VARIATION_SECTIONS = ("process", "documents", "forms", "tariffs", "deadlines", "documentsLocations", "instructions", "discounts")

ROWS = "array<map<string,string>>"
TABLE = f"struct<Columns:array<struct<Column:string,Title:string,Format:string>>,Data:{ROWS}>"


def cleaned(text: Column | str) -> Column:
    """Without byte-order mark and outer white space."""
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), "(?U)^[﻿\\s]+|\\s+$", "")


def tolerant_json(text: Column | str) -> Column:
    """As a variant; a missing first brace is put back."""
    t = cleaned(text)
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(F.concat(F.lit("{"), t)), F.try_parse_json(F.concat(F.lit("{"), t, F.lit("}"))))


def is_soft_error(text: Column | str) -> Column:
    return (F.octet_length(col(text)) <= 2000) & any_of(F.lower(col(text)), SOFT_MARKERS)


def classified(text: Column | str) -> Column:
    """empty, waf, soft_error, bad_json or ok, in this order; markers count in the first 600 characters."""

    def kind(x: Column) -> Column:
        t, head = x["t"], x["head"]
        begun = F.when(F.substring(t, 1, 1).isin("{", "["), t).otherwise(F.concat(F.lit("{"), t))
        service = F.try_variant_get(F.try_parse_json(begun), "$.idService", "string")
        return (
            F.when(t == "", "empty")
            .when(head.startswith("<") | any_of(head, WAF_MARKERS), "waf")
            .when((F.char_length(t) < 2000) & any_of(head, SOFT_MARKERS), "soft_error")
            .when(once(service, lambda s: s.isNull() | s.isin("", "0", "false", "null")), "bad_json")
            .otherwise("ok")
        )

    return once(cleaned(text), lambda t: once(F.struct(t.alias("t"), F.lower(F.substring(t, 1, 600)).alias("head")), kind))


def read_payloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) archived files, each with its kind, digest and text."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("sha256"))
    kinds = files.withColumn("kind", classified("text"))
    return kinds.where("kind = 'ok'"), kinds.where("kind <> 'ok'")


def number(value: Column | str) -> Column:
    """Comma to dot, whole amounts whole; what is no number stays as it is."""
    v = F.trim(F.replace(col(value), F.lit(","), F.lit(".")))
    return once(v.try_cast("double"), lambda n: F.when(n.isNull(), col(value)).when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string")))


def decoded(table: Column | str) -> Column:
    """Rows of a {Columns, Data} table, or of its JSON, as arrays of (title, value), by Order, ties in their order.

    Null if there is no data; an Order that is no number counts as zero.
    """

    def described(c: Column) -> Column:
        kind = F.lower(F.trim(F.coalesce(c["Format"], F.lit("string"))))
        return F.struct(c["Column"].alias("key"), F.trim(F.nullif(c["Title"], F.lit(""))).alias("title"), kind.isin(*NUMERIC_FORMATS).alias("counts"))

    def cell(columns: Column, e: Column) -> Column:
        told = lambda c: F.struct(F.coalesce(c["title"], F.trim(e["key"])).alias("title"), F.when(c["counts"], number(e["value"])).otherwise(e["value"]).alias("value"))
        return once(F.get(F.filter(columns, lambda c: c["key"] == e["key"]), F.lit(0)), told)

    def row(columns: Column, r: Column, i: Column) -> Column:
        entries = F.filter(F.map_entries(r), lambda e: ~e["key"].isin(*META_KEYS))
        order = F.coalesce(F.try_element_at(r, F.lit("Order")).try_cast("double"), F.lit(0.0))
        return F.struct(order.alias("order"), i.alias("i"), F.transform(entries, lambda e: cell(columns, e)).alias("cells"))

    def rows(t: Column) -> Column:
        data = once(F.transform(t["Columns"], described), lambda columns: F.transform(t["Data"], lambda r, i: row(columns, r, i)))
        return F.when(F.size(t["Data"]) > 0, F.transform(F.sort_array(data), lambda x: x["cells"]))

    return once(F.from_json(col(table), TABLE) if isinstance(table, str) else table, rows)


def row_text(cells: Column) -> Column:
    """title: value of the cells that aren't empty; a zero is shown."""
    shown = F.filter(cells, lambda c: c["value"].isNotNull() & (c["value"] != "") & ~c["title"].startswith("_"))
    return F.array_join(F.transform(shown, lambda c: F.concat_ws(": ", c["title"], c["value"])), " | ")
