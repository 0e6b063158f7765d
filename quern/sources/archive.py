"""A throttled crawl into an archive: requests released in blocks, paced in the tasks, bodies kept under their digest.

released() -> requests() -> fetched() -> keep().  The stream's offsets are those of
Spark's file source over the blocks, so a stopped crawl goes on where it was; the
sink is a data source with commit messages, so what a lost task wrote is not seen.

Layout of an archive: bodies/<two digits>/<sha256> is a body as it came, once,
however many keys have it; manifest/ has a file a task, one row a request;
commits/ has a file a batch that names its manifest files.  Rows of files that no
commit names don't exist.  A batch that runs again replaces its own commit.

Defined results: a request without an address has failed; repeated keys of one
release are requested once; an empty body is a body; an empty table writes a commit
without rows.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming.query import StreamingQuery

from quern.sources.payloads import SOFT_MARKERS

# The replies after which a request is made again.
RETRIED = (429, 500, 502, 503, 504)
REQUEST = "kind string, key string, url string"
REPLY = "kind string, key string, status string, http_status int, attempts int, fetched_at string, error string, body binary"
KEPT = pa.schema([("kind", pa.string()), ("key", pa.string()), ("status", pa.string()), ("http_status", pa.int32()), ("bytes", pa.int64()), ("sha256", pa.string()), ("attempts", pa.int32()), ("fetched_at", pa.string()), ("error", pa.string())])
_FLUSH_ROWS, _FLUSH_BYTES = 256, 4 << 20

#: (status, body, seconds to wait if refused, or None) of an address; an OSError is a request without a reply.
Fetch = Callable[[str], tuple[int, bytes, float | None]]


def released(wanted: DataFrame, blocks: str, size: int = 1000) -> None:
    """Adds the requests (kind, key, url), each key once, to the blocks: files of at most `size` rows."""
    rows = wanted.where("key IS NOT NULL").select("kind", "key", "url").groupBy("key").agg(F.min(F.struct("kind", "url")).alias("x"))
    rows.select("x.kind", "key", "x.url").write.mode("append").option("maxRecordsPerFile", size).parquet(blocks)


def requests(spark: SparkSession, blocks: str, blocks_a_trigger: int = 8) -> DataFrame:
    """The released requests as a stream; a batch takes so many blocks, so that a restart repeats no more than these."""
    return spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", blocks_a_trigger).parquet(blocks)


def is_soft_error(body: bytes) -> bool:
    """A short page of apology, as payloads.is_soft_error() has it."""
    return len(body) <= 2000 and any(m in body.decode("utf-8", "replace").lower() for m in SOFT_MARKERS)


class Pace:
    """Starts at least `interval` seconds apart; a late start doesn't bring the next ones forward."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.free = interval, clock, sleep, float("-inf")

    def wait(self) -> None:
        delay = self.free - self.clock()
        if delay > 0:
            self.sleep(delay)
        self.free = self.clock() + self.interval


def answered(fetch: Fetch, url: str | None, pace: Pace, tries: int = 5, first: float = 1.5, most: float = 60.0) -> tuple[str, int | None, bytes | None, int, str | None]:
    """(status, http_status, body, attempts, error) after at most `tries` requests, each in its turn.

    A refusal (RETRIED), no reply, and a soft error in a good reply are asked again,
    after `first` seconds and twice as many each time, at most `most`, and up to a quarter more by
    chance; a wait that the reply itself names with a 429 goes before.  The chance
    depends on the address, so a task that runs again waits alike.
    """
    if not url:
        return "failed", None, None, 0, "no address"
    draw = random.Random(url)
    for n in range(1, tries + 1):
        pace.wait()
        asked = None
        try:
            code, body, asked = fetch(url)
        except OSError as e:
            code, body, error = None, None, str(e)
        else:
            if code not in RETRIED and not (code == 200 and is_soft_error(body)):
                return ("ok" if code == 200 else "error"), code, body, n, None
            error = "soft error" if code == 200 else None
        if n < tries:
            delay = min(most, first * 2 ** (n - 1)) * draw.uniform(1, 1.25)
            pace.sleep(min(most, asked) if code == 429 and asked is not None else delay)
    return ("failed" if code is None else "error"), code, body, tries, error


def fetched(wanted: DataFrame, fetch: Fetch, per_second: float = 4.0, lanes: int = 4, **how) -> DataFrame:
    """The reply to each request: kind, key, status (ok, error, failed), http_status, attempts, fetched_at, error, body.

    Requests go to `lanes` tasks by key, each of which starts one in lanes /
    per_second seconds, so all together keep to per_second however many executors
    there are.  how is for answered(); fetch is pickled to the tasks.
    """
    names = [f.split()[0] for f in REPLY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(lanes / per_second)
        rows, size = [], 0

        def packed() -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

        for batch in batches:
            for kind, key, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                status, code, body, attempts, error = answered(fetch, url, pace, **how)
                rows.append((kind, key, status, code, attempts, datetime.now(timezone.utc).isoformat(), error, body))
                size += len(body or b"")
                if len(rows) >= _FLUSH_ROWS or size >= _FLUSH_BYTES:
                    yield packed()
                    rows, size = [], 0
        if rows:
            yield packed()

    return wanted.select("kind", "key", "url").repartition(lanes, "key").mapInArrow(run, REPLY)


def _at(path: str) -> tuple[FileSystem, str]:
    fs, root = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs, root.rstrip("/")


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """Bodies first, each under a name of its own until it is whole; then the task's manifest."""
        fs, root = _at(self.path)
        part, n = f"{uuid.uuid4().hex}.parquet", 0
        fs.create_dir(f"{root}/manifest", recursive=True)
        with fs.open_output_stream(f"{root}/manifest/{part}") as out, pq.ParquetWriter(out, KEPT) as manifest:
            for batch in iterator:
                rows = []
                for r in batch.to_pylist():
                    body = r.pop("body")
                    sha = None if body is None else hashlib.sha256(body).hexdigest()
                    if sha is not None:
                        self._keep(fs, f"{root}/bodies/{sha[:2]}", sha, body)
                    rows.append(r | {"bytes": None if body is None else len(body), "sha256": sha})
                manifest.write_table(pa.Table.from_pylist(rows, KEPT))
                n += len(rows)
        return Part(part, n)

    @staticmethod
    def _keep(fs: FileSystem, folder: str, name: str, body: bytes) -> None:
        if fs.get_file_info(f"{folder}/{name}").type == FileType.File:
            return
        fs.create_dir(folder, recursive=True)
        own = f"{folder}/_{uuid.uuid4().hex}"  # a name that readers of files pass over
        with fs.open_output_stream(own) as out:
            out.write(body)
        fs.move(own, f"{folder}/{name}")

    def _commit(self, messages: list[Part | None], name: str) -> None:
        fs, root = _at(self.path)
        fs.create_dir(f"{root}/commits", recursive=True)
        own = f"{root}/commits/_{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            out.write(b"".join(json.dumps({"part": m.name, "rows": m.rows}).encode() + b"\n" for m in messages if m is not None))
        fs.move(own, f"{root}/commits/{name}.json")

    def _abort(self, messages: list[Part | None]) -> None:
        """Manifests of tasks that ended; bodies stay, as other rows may have them."""
        fs, root = _at(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/manifest/{m.name}")

    def commit(self, messages: list[Part | None]) -> None:
        self._commit(messages, f"run-{uuid.uuid4().hex}")

    def abort(self, messages: list[Part | None]) -> None:
        self._abort(messages)


class ArchiveStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, crawl: str):
        self.kept, self.crawl = ArchiveWriter(path), crawl

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return self.kept.write(iterator)

    def commit(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        self.kept._commit(messages, f"{self.crawl}-{batchId}")

    def abort(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        self.kept._abort(messages)


class Archive(DataSource):
    """The sink "quern_archive" of replies: options path, and crawl, which tells the batches of several crawls apart."""

    @classmethod
    def name(cls) -> str:
        return "quern_archive"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> ArchiveStreamWriter:  # noqa: N802
        return ArchiveStreamWriter(self.options["path"], self.options.get("crawl", "crawl"))


def keep(replies: DataFrame, path: str, checkpoint: str | None = None, crawl: str = "crawl", **trigger) -> StreamingQuery | None:
    """Replies into the archive at path: a stream with its checkpoint, or a table at once.

    A crawl's name goes with its checkpoint: a new checkpoint needs a new name.
    """
    replies.sparkSession.dataSource.register(Archive)
    if replies.isStreaming:
        return replies.writeStream.format("quern_archive").option("path", path).option("crawl", crawl).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    return replies.write.format("quern_archive").option("path", path).mode("append").save()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all commits: kind, key, status, http_status, bytes, sha256, attempts, fetched_at, error."""
    commits = spark.read.schema("part string, rows long").json(f"{path}/commits").select("part").distinct()
    rows = spark.read.schema("kind string, key string, status string, http_status int, bytes long, sha256 string, attempts int, fetched_at string, error string").parquet(f"{path}/manifest")
    return rows.withColumn("part", F.col("_metadata.file_name")).join(commits, "part", "left_semi").drop("part")


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, content, sound) of the bodies; sound: the name is that of the content.

    Readers of files pass over empty ones, so the empty body comes from the manifest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/bodies")
    empty = manifest(spark, path).where("bytes = 0").select("sha256").distinct().select("sha256", F.lit(b"").alias("content"))
    own = files.select(F.element_at(F.split("path", "/"), -1).alias("sha256"), "content").unionByName(empty)
    return own.withColumn("sound", F.sha2("content", 256) == F.col("sha256"))
