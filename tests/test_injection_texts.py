"""The injection suite over texts that XML, its reader or a key of ids could lose; its SQL is the measure."""

import duckdb

import __spark_entry__

TEXTS = [(1, "plain <b>&", "s"), (2, "", "s"), (3, " ", 'a"\tb\r\n'), (4, "\n\n", " s "), (5, "a\r\nb\r", "s"), (6, "\x00a\x01\x0bA0￾", "\x1f"), (7, "same", "s"), (7, "same", "s"), (7, "other", None), (8, None, "s"), (9, "xx\r\nyy\r\n", ""), (None, "no id", "s")]


def test_injection_suite_equals_its_sql_on_odd_texts(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame(TEXTS, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()["injection_suite"](spark, d).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(__spark_entry__.oracle_sql()["injection_suite"]).fetchall()))
    assert len(got) == 6 * len(TEXTS)
