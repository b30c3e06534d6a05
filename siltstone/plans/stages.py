"""What the stages of a run held and how long they took, counted while they are kept and never by another pass."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .run import Keep, in_shared


class Stages:
    """A run's ``keep`` that counts as it keeps: of each stage that is written its rows, those that failed, and the texts' characters.

    The counts are sums that each task of the write adds to, so a stage is evaluated once, with or without them.  Stages that
    ``keep`` only passes on are not counted, since nothing is written there.  A text is any string column, or string field of a struct.
    """

    def __init__(self, keep: Keep = in_shared):
        self._keep, self._seen = keep, []

    def __call__(self, name: str, stage: DataFrame) -> DataFrame:
        seen, began = Observation(), time.monotonic()
        counted = stage.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(_failed(stage)).alias("failed"), F.coalesce(F.sum(_chars(stage)), F.lit(0)).alias("chars"))
        out = self._keep(name, counted)
        if out is counted:
            return stage
        self._seen.append((name, seen, time.monotonic() - began))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(seq, stage, rows, failed, chars, tokens, seconds), a row a stage; a token is estimated as four characters."""
        rows = []
        for k, (name, seen, seconds) in enumerate(self._seen):
            got = seen.get
            rows.append((k, name, got["rows"], got["failed"], got["chars"], got["chars"] // 4, seconds))
        return spark.createDataFrame(rows, "seq long, stage string, rows long, failed long, chars long, tokens long, seconds double")


def _failed(stage: DataFrame):
    """Whether a row says why it failed: a page that could not be loaded or read, a record that lacks what is required."""
    signs = F.lit(False)
    if "load_error" in stage.columns:
        signs = signs | F.col("load_error").isNotNull()
    if "page" in stage.columns:
        signs = signs | F.col("page.error").isNotNull()
    if "missing" in stage.columns:
        signs = signs | (F.size("missing") > 0)
    return signs


def _chars(stage: DataFrame):
    texts = []
    for f in stage.schema.fields:
        name = "`" + f.name.replace("`", "``") + "`"
        if f.dataType.simpleString() == "string":
            texts.append(name)
        elif f.dataType.typeName() == "struct":
            texts += [f"{name}.`{g.name}`" for g in f.dataType.fields if g.dataType.simpleString() == "string"]
    return sum((F.coalesce(F.length(t), F.lit(0)) for t in texts), F.lit(0)).cast("long")
