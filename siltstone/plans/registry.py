"""Queries by name, each with its SQL if SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How many rows of a narrow table, each of which becomes a page or a record, a task is dealt at most.
ROWS_A_TASK = 20_000


def spread(scan: DataFrame, *, rows: int | None = None) -> DataFrame:
    """A table's scan over all cores, where its files give fewer partitions, as a small file of one row group does; else as it is.

    With ``rows``, also over as many tasks as there are so many rows: for narrow tables, as all of it is shuffled then.  For work that is
    heavy per row.  Only for plain scans: of a plan with shuffles, asking for the partitions runs it.  Rows are counted by the files' footers.
    """
    tasks = scan.sparkSession.sparkContext.defaultParallelism
    if rows:
        tasks = max(tasks, -(-scan.count() // rows))
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan
