"""The archive: a crawl that breaks off, bodies once, pacing, retries, commits."""

import os
import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quern.sources import archive, payloads
from quern.tables import new_path

WANTED = "kind string, key string, url string"


def portal(folder, broken=None):
    """Bodies by the last digit, so that ten serve all; every request leaves a file that the test can count."""

    def fetch(url):
        n = int(url.rsplit("/", 1)[1])
        if n == broken and not os.path.exists(f"{folder}/mended"):
            raise RuntimeError("no OSError: it ends the task, as a lost executor does")
        open(f"{folder}/{n}-{uuid.uuid4().hex}", "w").close()
        return 200, b"body %d" % (n % 10), None

    return fetch


def test_a_crawl_that_breaks_off_goes_on(spark, tmp_path):
    """Batches before the break are not requested again; the archive ends as that of an unbroken crawl."""
    at, asked = new_path(spark, "archive"), tmp_path / "asked"
    asked.mkdir()
    rows = [("page", f"k{i:02}", f"https://x/{i}") for i in range(60)] + [("page", "k07", "https://x/7"), ("page", None, "https://x/0")]
    archive.released(spark.createDataFrame(rows, WANTED).coalesce(1).orderBy("key"), f"{at}/blocks", size=10)

    def crawl():
        replies = archive.fetched(archive.requests(spark, f"{at}/blocks", 1), portal(str(asked), 35), per_second=1e9, lanes=2)
        archive.keep(replies, f"{at}/kept", f"{at}/log").awaitTermination()

    with pytest.raises(StreamingQueryException):
        crawl()
    before = {r["key"] for r in archive.manifest(spark, f"{at}/kept").collect()} if os.path.exists(f"{at}/kept/commits") else set()
    assert len(before) < 60
    (asked / "mended").touch()
    crawl()
    got = archive.manifest(spark, f"{at}/kept").collect()
    assert sorted(r["key"] for r in got) == [f"k{i:02}" for i in range(60)] and {r["status"] for r in got} == {"ok"}
    kept = archive.bodies(spark, f"{at}/kept").collect()
    assert len(kept) == 10 and all(r["sound"] for r in kept) and {r["sha256"] for r in kept} == {r["sha256"] for r in got}
    requested = [f.name.split("-")[0] for f in asked.iterdir()]
    assert all(requested.count(str(int(k[1:]))) == 1 for k in before)
    crawl()
    assert archive.manifest(spark, f"{at}/kept").count() == 60


def test_rows_without_a_commit_do_not_exist(spark):
    at = new_path(spark, "archive")
    replies = spark.createDataFrame([("p", "a", "ok", 200, 1, "t", None, bytearray(b"x")), ("p", "b", "failed", None, 5, "t", "deaf", None), ("p", "c", "ok", 200, 1, "t", None, bytearray(b""))], archive.REPLY)
    archive.keep(replies, at)
    assert {(r["key"], r["bytes"]) for r in archive.manifest(spark, at).collect()} == {("a", 1), ("b", None), ("c", 0)}
    archive.ArchiveWriter(at).write(iter(replies.toArrow().to_batches()))  # a task whose job never ended
    assert archive.manifest(spark, at).count() == 3
    writer = archive.ArchiveStreamWriter(at, "again")
    for _ in range(2):  # the same batch twice
        writer.commit([writer.write(iter(replies.toArrow().to_batches())), None], 4)
    assert archive.manifest(spark, at).count() == 6
    part = writer.write(iter(replies.toArrow().to_batches()))
    writer.abort([part, None], 5)
    assert not os.path.exists(f"{at}/manifest/{part.name}")
    assert {r["content"]: r["sound"] for r in archive.bodies(spark, at).select(F.col("content").cast("string"), "sound").collect()} == {"x": True, "": True}
    archive.keep(replies.limit(0), at)
    assert archive.manifest(spark, at).count() == 6


def test_pace_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = archive.Pace(0.25, lambda: now[0], sleep)
    for late in (0, 0, 5, 0):
        now[0] += late
        pace.wait()
    assert slept == [0.25, 0.25]  # the late start isn't made up for

    def run(*replies, tries=4):
        slept.clear()
        left = list(replies)

        def fetch(url):
            r = left.pop(0)
            if isinstance(r, Exception):
                raise r
            return r

        return archive.answered(fetch, "https://x/1", archive.Pace(0, lambda: now[0], sleep), tries=tries, first=1.0)

    assert run((200, b"a", None)) == ("ok", 200, b"a", 1, None) and slept == []
    assert run((404, b"", None)) == ("error", 404, b"", 1, None)
    assert run((503, b"", None), OSError("cut"), (200, b"b", None)) == ("ok", 200, b"b", 3, None)
    assert 1 <= slept[0] <= 1.25 and 2 <= slept[1] <= 2.5
    assert run((429, b"", 7.0), (200, b"c", None))[:2] == ("ok", 200) and slept == [7.0]
    assert run(*[(200, b"Please CONTACT SUPPORT", None)] * 4)[:2] == ("error", 200) and len(slept) == 3
    assert run(*[OSError("deaf")] * 4) == ("failed", None, None, 4, "deaf")
    assert run((429, b"", 1e9), (200, b"", None)) == ("ok", 200, b"", 2, None) and slept == [60.0]
    assert archive.answered(None, None, pace) == ("failed", None, None, 0, "no address")


def test_soft_errors_as_in_columns(spark):
    texts = ["", "Ticket ID 5", "x" * 2000 + "ticket id", "ticket id" + "x" * 1991, "ticket id" + "x" * 1992, "ж" * 995 + "ticket id", "ok"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", payloads.is_soft_error("t").alias("soft")).collect()
    assert [archive.is_soft_error(r["t"].encode()) for r in rows] == [r["soft"] for r in rows]
