"""A dataset kept up to date from a folder that pages arrive in, and jobs followed by their events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans.dataset import upserted
from ..plans.jobs import MOVES, QUIET
from ..sources.kept import KeptDataset
from ..sources.urls import PAGES


def arriving_pages(spark: SparkSession, folder: str, *, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def keep_dataset(rows: DataFrame, folder: str, keys: list[str], *, checkpoint: str, now: Callable[[int], str]) -> StreamingQuery:
    """Insert or update each batch of ``rows`` (with ``seq``) in a dataset, a folder of numbered versions.

    Version N holds the dataset after batch N and is written before N + 1 reads it, so a batch that
    runs again writes the same version again.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stamp = now(number)
        empty = batch.limit(0).withColumns({"extraction_date": F.lit(""), "last_updated": F.lit("")})
        old = spark.read.parquet(f"{folder}/v{number - 1}") if number else empty
        upserted(old, batch, keys, now=stamp).drop("operation").write.mode("overwrite").parquet(f"{folder}/v{number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_buckets(rows: DataFrame, kept: KeptDataset, *, checkpoint: str, now: Callable[[int], str]) -> StreamingQuery:
    """Insert or update each batch of ``rows`` (with ``seq``) in a dataset of buckets; a batch rewrites the buckets its keys fall in.

    The manifest has the batch's number, so a batch that runs again after it was merged changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # read for its buckets, and for its rows
        try:
            kept.merge(held, now=now(number), batch_id=number)
        finally:
            held.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Job(StatefulProcessor):
    """A job's state by its events; a timer says when one has run too long without any."""

    def __init__(self, stuck_ms: int, start: str):
        self.stuck_ms, self.start = stuck_ms, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, refused long, at long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        events = pd.concat(list(rows)).sort_values(["ts", "event"], kind="stable")
        status, refused, at = self.job.get() if self.job.exists() else (self.start, 0, 0)
        allowed = {(name, before): after for name, befores, after in MOVES for before in befores}
        for event in events["event"]:
            after = allowed.get((event, status))
            refused += after is None and event != QUIET
            status = after or status
        at = max(at, int(events["ts"].max().timestamp() * 1000))
        self.job.update((status, refused, at))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if status == "running":
            self.handle.registerTimer(at + self.stuck_ms)
        yield self._row(key, status, refused, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        status, refused, _ = self.job.get()
        if status == "running":
            yield self._row(key, status, refused, True)

    def _row(self, key, status: str, refused: int, stuck: bool):
        import pandas as pd

        return pd.DataFrame({"id": [key[0]], "status": [status], "refused": [refused], "stuck": [stuck]})

    def close(self) -> None:
        pass


def followed_jobs(events: DataFrame, *, late: str = "10 minutes", stuck_after_seconds: int = 3600, start: str = "created") -> DataFrame:
    """(id, status, refused, stuck) whenever events (id, ts, event) move a job, and once more when it is stuck.

    A job is stuck if it runs and the watermark passes its last event by ``stuck_after_seconds``.  State is a row a job, kept by key; the
    session's state store must be RocksDB.  Events of one batch take effect in the order of their time; later ones in that of their batches.
    """
    kind = events.schema["id"].dataType.simpleString()
    return (
        events.select("id", "event", F.col("ts").cast("timestamp").alias("ts"))
        .withWatermark("ts", late)
        .groupBy("id")
        .transformWithStateInPandas(statefulProcessor=_Job(stuck_after_seconds * 1000, start), outputStructType=f"id {kind}, status string, refused long, stuck boolean", outputMode="Update", timeMode="EventTime")
    )


def hourly(events: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Counts and values of events (ts, event_type, value) by hour; those later than ``late`` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
