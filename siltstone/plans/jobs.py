"""Jobs as a table: their states, what moves them, what they may not be, and how runs are set up."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug

# States and those that end a job; which event takes which state to which.
STATES = ("created", "validating", "queued", "running", "completed", "failed", "cancelled", "partial")
ENDED = ("completed", "failed", "cancelled", "partial")
WAITING = ("created", "validating", "queued")
MOVES: list[tuple[str, tuple[str, ...], str]] = [
    ("run", WAITING, "running"),
    ("rerun", (*WAITING, *ENDED), "running"),
    ("cancel", (*WAITING, "running"), "cancelled"),
    ("complete", ("running",), "completed"),
    ("fail", ("running",), "failed"),
    ("part", ("running",), "partial"),
]
#: An event that changes nothing where it does not apply; others are refused there.
QUIET = "cancel"


def moved(state: Column, event: Column) -> Column:
    """The state after an event; one that the state does not allow leaves it."""
    out = F.when(F.lit(False), state)
    for name, before, after in MOVES:
        out = out.when((event == name) & state.isin(*before), F.lit(after))
    return out.otherwise(state)


def refused(state: Column, event: Column) -> Column:
    """Why an event is refused in a state, or null."""
    fits = F.lit(False)
    for name, before, _ in MOVES:
        fits = fits | ((event == name) & state.isin(*before))
    return F.when(fits | (event == QUIET), F.lit(None).cast("string")).when(state == "running", F.lit("already running")).when(state.isin(*ENDED) & (event == "run"), F.concat(F.lit("already "), state, F.lit("; rerun it"))).otherwise(F.concat(event, F.lit(" is not possible when "), state))


def effects(event: Column) -> Column:
    """What an event does to a job in each of ``STATES``, in their order: (to, the state's number after it, refused, 1 or 0)."""
    of = lambda s: F.struct(_number(moved(F.lit(s), event)).alias("to"), refused(F.lit(s), event).isNotNull().cast("long").alias("refused"))
    return F.array(*[of(s) for s in STATES])


def _number(state: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, STATES)), state) - 1).cast("int")


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (id, part, at, to, refused) rows in order, one for each run of an id: the rows' effects one after the other."""
    width, ids, parts, ats, tos, counts = len(STATES), [], [], [], [], []
    current, to, count = None, None, None

    def sent() -> pa.RecordBatch:
        arrays = [pa.array(ids, type=kind), pa.array(parts, pa.int64()), pa.array(ats, pa.int64()), pa.array(tos, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))]
        for column in (ids, parts, ats, tos, counts):
            column.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["id", "part", "at", "to", "refused"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("id").type
        own, part, at = (batch.column(c).to_pylist() for c in ("id", "part", "at"))
        to_rows = batch.column("to").flatten().to_numpy().reshape(-1, width)
        count_rows = batch.column("refused").flatten().to_numpy().reshape(-1, width)
        for k in range(len(own)):
            if current is None or current[0] != own[k]:
                if current is not None:
                    for column, value in ((ids, current[0]), (parts, current[1]), (ats, current[2]), (tos, to), (counts, count)):
                        column.append(value)
                    if len(ids) >= 4096:
                        yield sent()
                current, to, count = (own[k], part[k], at[k]), to_rows[k], count_rows[k]
            else:
                to, count = to_rows[k][to], count + count_rows[k][to]
    if current is not None:
        for column, value in ((ids, current[0]), (parts, current[1]), (ats, current[2]), (tos, to), (counts, count)):
            column.append(value)
        yield sent()


def segments(events: DataFrame) -> DataFrame:
    """(id, part, at, to, refused): for each job and task, the effect of the job's events in it, as a map of states.

    Events (id, at, event) are sorted by job and time over the whole cluster, so a job with very many of them is in several
    tasks, each of which has a stretch of its time; ``part`` is the order of these stretches.  Effects combine: an
    effect after another is an effect, whatever state the job was in, so no task needs to know how a job began.
    """
    kind = events.schema["id"].dataType.simpleString()
    rows = events.select("id", F.col("at").cast("long").alias("at"), effects(F.col("event")).alias("e"))
    ordered = rows.repartitionByRange("id", "at").sortWithinPartitions("id", "at").select("id", F.spark_partition_id().cast("long").alias("part"), "at", F.col("e.to").alias("to"), F.col("e.refused").alias("refused"))
    return ordered.mapInArrow(_composed, f"id {kind}, part long, at long, to array<int>, refused array<long>")


def replayed(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """``jobs`` (id, status, ...) after ``events`` (id, at, event) in order, with ``refused``, how many of them their job's state did not allow.

    Each task makes one effect of a job's events that it has, and these, at most one for each task, are put together in the order of time.
    Events of one job and time take effect in no set order.  Jobs without events stay as they are.
    """
    kind = events.schema["id"].dataType.simpleString()
    whole = segments(events).repartition("id").sortWithinPartitions("id", "part", "at").mapInArrow(_composed, f"id {kind}, part long, at long, to array<int>, refused array<long>")
    both = jobs.join(whole.select("id", "to", F.col("refused").alias("_refused")), "id", "left").withColumn("_s", _number(F.col("status")))
    status = F.coalesce(F.get(F.array(*map(F.lit, STATES)), F.get("to", F.col("_s"))), F.col("status"))
    return both.select(*[status.alias(c) if c == "status" else F.col(c) for c in jobs.columns], F.coalesce(F.get("_refused", F.col("_s")), F.lit(0)).cast("long").alias("refused"))


def invalid(jobs: DataFrame) -> Column:
    """Why a job (name, urls, status) can't be, or null."""
    blank = F.size(F.filter("urls", lambda u: F.trim(F.coalesce(u, F.lit(""))) == ""))
    return (
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", F.lit("name must not be empty"))
        .when(F.col("urls").isNull() | (F.size("urls") == 0), F.lit("urls must not be empty"))
        .when(blank > 0, F.format_string("urls has %d empty entries", blank))
        .when(~F.col("status").isin(*STATES), F.concat(F.lit("status is unknown: "), F.col("status")))
    )


def taken_names(new: DataFrame, old: DataFrame) -> DataFrame:
    """The rows of ``new`` whose name a row of ``old`` has, without case and blanks around."""
    name = F.lower(F.trim("name"))
    return new.withColumn("_name", name).join(old.select(name.alias("_name")), "_name", "left_semi").drop("_name")


def file_name(name: Column, extension: Column) -> Column:
    """The file that a job is written to: its name as letters, digits and underscores."""
    return F.concat(slug(name, "extraction_job"), F.lit("."), F.regexp_replace(extension, r"^\.+", ""))


@dataclass(frozen=True)
class Settings:
    """How runs are set up; ``spark.siltstone.<name>`` in a session overrides a default."""

    safe_tokens: int = 60_000
    batch_tokens: int = 60_000
    retries: int = 2
    pause_seconds: float = 2.0
    read_timeout_seconds: int = 600
    output_format: str = "excel"

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {f.name: spark.conf.get(f"spark.siltstone.{f.name}", None) for f in fields(cls)}
        kinds = {f.name: type(getattr(cls, f.name)) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in given.items() if v is not None})

    def __post_init__(self):
        if not re.fullmatch("csv|excel|xlsx|parquet", self.output_format.lower()):
            raise ValueError(f"unknown output format: {self.output_format}")
