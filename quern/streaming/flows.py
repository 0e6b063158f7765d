"""Streams: the crawl log, the turn planner, and upkeep of an index."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.operators import dialog
from quern.operators.maintenance import difference
from quern.sources.crawl import MANIFEST


def manifest_stream(spark: SparkSession, path: str, files_a_trigger: int = 100) -> DataFrame:
    """Keys done, once each; ok rows are taken before the dedup, or a first failure would hide a success."""
    log = spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", files_a_trigger).json(path)
    return log.where("status = 'ok'").dropDuplicates(["key"])


def resume(wanted: DataFrame, done_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Writes the keys of a stream that a done table lacks; children of parents that are done count too."""

    def write(batch: DataFrame, number: int) -> None:
        done = batch.sparkSession.read.parquet(done_path).select("key")
        batch.dropDuplicates(["key"]).join(done, "key", "left_anti").write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return wanted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


class Planner(StatefulProcessor):
    """The turn planner as state: topic, open question, last service and its options.

    A session ends `idle_ms` after its last turn, by event time: a turn that comes
    later begins anew, and a timer drops the state of conversations that stay away,
    so state does not grow with all conversations ever seen.  Each end is a row.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("session", "topic string, pending string, service long, offered string, at long, turn long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        session = dialog.Session(*self.held.get()) if self.held.exists() else dialog.Session()
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        parts = pd.concat(list(rows)).sort_values(["turn", "text"])
        out = [(*key, *x) for x in dialog.turn_rows(session, parts.itertuples(), self.idle_ms)]
        self.held.update((session.topic, session.pending, session.service, session.offered, session.at, session.turn))
        self.handle.registerTimer(session.at + self.idle_ms)
        yield dialog.turn_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        if self.held.exists():
            turn = self.held.get()[5]
            self.held.clear()
            yield dialog.turn_frame([(*key, turn, None, "expired", None, None, None)])

    def close(self) -> None:
        pass


def plan_stream(turns: DataFrame, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The turn planner over a stream of the turns that dialog.turn_columns() takes.

    Start it within rocksdb(): such state needs that store.
    """
    spark = turns.sparkSession
    idle_ms = int(spark.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-01T00:00:00Z' + INTERVAL {idle})")).first()[0])
    own = dialog.turn_columns(turns).where("conv IS NOT NULL").withWatermark("ts", late)
    kind = turns.schema["conv_id"].dataType.simpleString()
    return own.groupBy("conv").transformWithStateInPandas(Planner(idle_ms), f"conv_id {kind}, {dialog.TURN}", "append", "EventTime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB; the session's own setting is restored."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def upkeep(rows: DataFrame, index_path: str, id_col: str, text_col: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new or changed in each micro-batch to an index (id, text, generation).

    A batch that runs again overwrites its own generation only.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema("id long, text string, generation long").parquet(index_path).where(F.col("generation") < number)
        latest = old.groupBy("id").agg(F.max_by("text", "generation").alias("text"))
        new = batch.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        changed = difference(latest, new, "id", "text").where("action IN ('added', 'updated')")
        new.join(changed, "id", "left_semi").write.mode("overwrite").parquet(f"{index_path}/generation={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of event types by event time; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
