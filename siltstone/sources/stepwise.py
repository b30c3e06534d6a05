"""Work on a table in steps that are kept as they end, so that what was cancelled, lost or put off goes on where it was.

The rows are numbered and stored once, sorted by their numbers; a step is a range of numbers, so it reads its own part of the files and
no more.  What a step gives is a folder of its own that counts once Spark has committed it: a step that was cancelled or lost halfway is done again
as a whole, and one that has ended is not.  Rows that a step had to leave are done by a later run.  A run may be given a most of rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: How a run ended: all rows are done, its rows are used up, it left some that can't be done now, it was cancelled.
WHOLE, SPENT, HELD, CANCELLED = "whole", "spent", "held", "cancelled"


class Stepwise:
    """Rows, steps and a mark of cancelling in one folder; one run at a time, from any driver that sees the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._mark = self._path(f"{self.folder}/_cancelled")
        self._tag = f"steps-{zlib.crc32(self.folder.encode())}"

    def _is(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def plan(self, rows: DataFrame, order: list[Column]) -> Stepwise:
        """Number ``rows`` by ``order``, which should tell all rows apart, and store them; a folder that has rows already keeps those."""
        from ..plans.evaluation import numbered

        if not self._is("rows/_SUCCESS"):
            numbered(rows, order).write.mode("overwrite").parquet(f"{self.folder}/rows")
        return self

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def _steps(self) -> list[tuple[int, int, int]]:
        """(low, high, try) of the steps that have ended, ``high`` not included."""
        at = self._path(f"{self.folder}/done")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        found = [tuple(map(int, m.groups())) for n in names if (m := re.fullmatch(r"step=(\d+)-(\d+)-(\d+)", n))]
        return sorted(s for s in found if self._is(f"{_place(s)}/_SUCCESS"))

    def _given(self, steps: list[tuple[int, int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{_place(s)}" for s in steps])

    def done(self) -> DataFrame | None:
        """What the steps that have ended so far gave, with ``number``; None before the first."""
        steps = self._steps()
        return self._given(steps).where(~F.col("_again")).drop("_again") if steps else None

    def cancel(self) -> None:
        """Stop the run that goes on in this folder, its tasks too if this is its driver; steps that have ended stay."""
        self._fs.mkdirs(self._path(self.folder))
        self._fs.create(self._mark, True).close()
        self.spark.sparkContext.cancelJobsWithTag(self._tag)

    def _short(self) -> list[tuple[int, int, int, int]]:
        """(low, high, next try, rows left) of the ranges that have ended without all of their rows."""
        steps = self._steps()
        if not steps:
            return []
        tries: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for s in steps:
            tries.setdefault(s[:2], []).append(s)
        starts = F.array(*[F.lit(low).cast("long") for low, _ in sorted(tries)])
        # ranges do not overlap, so a number's is the last that starts at or before it
        own = F.array_max(F.filter(starts, lambda low: low <= F.col("number")))
        counts = dict(self._given(steps).where(~F.col("_again")).groupBy(own.alias("low")).count().collect())  # a row a step
        left = ((low, high, of[-1][2] + 1, high - low - counts.get(low, 0)) for (low, high), of in sorted(tries.items()))
        return [r for r in left if r[3] > 0]

    def run(self, work: Callable[[DataFrame], DataFrame], *, rows_a_step: int, most: int | None = None, again: Column | None = None, tasks: int | None = None) -> str:
        """Do the rows that are not done, first those that earlier steps left, and tell how it ended.

        ``work`` makes of a step's rows what is kept, one row for each, with ``number``.  Rows that ``again`` holds for aren't done:
        the run ends with that step, and a later one does them anew.  ``most`` rows are done at most, exactly as many if there are.  A step's rows are
        dealt to ``tasks``, by default all cores.  A task that Spark repeats, or a step that was lost, does its rows once more.
        """
        sc, used = self.spark.sparkContext, 0
        self._fs.delete(self._mark, False)
        last = self.rows.agg(F.max("number")).first()[0] or 0
        short = self._short()
        ahead = max((high for _, high, _ in self._steps()), default=1)
        while most is None or used < most:
            room = rows_a_step if most is None else min(rows_a_step, most - used)
            if short:
                low, high, tried, _ = short.pop(0)
                rows = self._left(low, high, room)
            elif ahead <= last:
                low, high, tried = ahead, min(ahead + room, last + 1), 0
                rows = self.rows.where(F.col("number").between(low, high - 1))
            else:
                return WHOLE
            seen = Observation()
            out = work(rows.repartition(tasks or sc.defaultParallelism, "number"))
            out = out.withColumn("_again", F.coalesce(again, F.lit(False)) if again is not None else F.lit(False))
            out = out.observe(seen, F.count_if(~F.col("_again")).alias("done"), F.count_if("_again").alias("again"))
            sc.addJobTag(self._tag)
            try:
                if self._fs.exists(self._mark):
                    return CANCELLED
                out.write.mode("overwrite").parquet(f"{self.folder}/{_place((low, high, tried))}")
            except Exception:
                if self._fs.exists(self._mark):
                    return CANCELLED
                raise
            finally:
                sc.removeJobTag(self._tag)
            ahead = max(ahead, high)
            used += seen.get["done"]
            if seen.get["again"]:
                return HELD
            if tried:
                short = self._short()
        return WHOLE if ahead > last and not short else SPENT

    def _left(self, low: int, high: int, most: int) -> DataFrame:
        """The first ``most`` rows of a range that no step has done."""
        inside = F.col("number").between(low, high - 1)
        made = self.done().where(inside).select("number")
        rows = self.rows.where(inside).join(made, "number", "left_anti")
        end = rows.select("number").orderBy("number").limit(most).agg(F.max("number")).first()[0]  # numbers of one step
        return rows.where(F.col("number") <= end)


def _place(step: tuple[int, int, int]) -> str:
    low, high, tried = step
    return f"done/step={low:015d}-{high:015d}-{tried:03d}"
