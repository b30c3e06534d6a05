"""What the operators share: table access, lineage cuts, checked broadcasts, text units."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as a Java regular expression class body.
BLANK = r"\x20\x09-\x0D"
WORD = f"[^{BLANK}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


#: Folders of stored frames that were not discarded yet, in the order they were written.
_KEPT: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder, and read from there: what cuts lineage, and survives an executor's loss."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    _KEPT.append(path)
    return spark.read.parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, stored; what was stored on the way to it is deleted."""
    before = set(_KEPT)
    out = stored(make())
    last = _KEPT[-1]
    for path in [p for p in _KEPT if p not in before and p != last]:
        _delete(out.sparkSession, path)
    return out


@contextmanager
def phases(spark: SparkSession) -> Iterator[None]:
    """On leaving it, what was stored within is deleted: for callers that have written an operator's result by then."""
    before = set(_KEPT)
    try:
        yield
    finally:
        for path in [p for p in _KEPT if p not in before]:
            _delete(spark, path)


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared checkpoint folder, dealt by ``key``, and its name: joins on the key do not shuffle it again."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with tidy(spark):
        df.write.bucketBy(parts, key).sortBy(key).format("parquet").option("path", f"{checkpoint_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def discard(*frames: DataFrame) -> None:
    """Delete the files of stored frames, of which nothing that is still to run reads."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _KEPT[:] = [p for p in _KEPT if p.rpartition("/")[2] != folder.rpartition("/")[2]]


def small(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows, counting no further than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """All words of a text, as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def n_words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_key(text: Column) -> Column:
    """Tells apart texts that share a doc_id; null and empty are one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def quoted(name: str) -> str:
    """A column's name as ``col`` reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, an execution's shuffle files are removed as soon as it ends, and not when its plan is collected.

    Each phase of an operator writes a table that the next one reads, so what it shuffled is of no more use.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def dealt_anew(c: Column) -> Column:
    """A join key that is one to one with a column that a side was grouped by.

    Joined by the column itself, the grouped side would keep its partitions, and adaptive execution
    splits a skewed partition of the other side only where both come straight from an exchange.
    """
    return c.bitwiseXOR(F.lit(1))


def with_fields(df: DataFrame, made: Column, names: dict[str, str]) -> DataFrame:
    """``df`` with fields of a struct that is computed once, each under its name; columns of these names are replaced."""
    spare = next(f"_made{k}" for k in range(len(df.columns) + 1) if f"_made{k}" not in df.columns)
    kept = [F.col(quoted(c)) for c in df.columns if c not in names]
    return df.withColumn(spare, made).select(*kept, *[F.col(f"{spare}.{field}").alias(name) for name, field in names.items()])
