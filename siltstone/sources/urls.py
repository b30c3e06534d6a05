"""Lists of urls to read, and pages from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

PAGES = "page_id bigint, url string, html string"


def urls_from_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a line that is not blank."""
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).where("url <> ''")


def urls_from(spark: SparkSession, urls: str | list[str]) -> DataFrame:
    """Of one text of lines or a list; blanks are dropped."""
    lines = urls.splitlines() if isinstance(urls, str) else list(urls)
    return spark.createDataFrame([(u,) for u in (x.strip() for x in lines) if u], "url string")


def pages_from_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Pages as rendered and stored; the reader needs no inference."""
    return spark.read.schema(PAGES).parquet(path)


def pages_from_html(spark: SparkSession, folder: str) -> DataFrame:
    """A page a file of a folder; its path is its url."""
    files = spark.read.text(f"{folder}/*.html", wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    return files.select(F.xxhash64("url").alias("page_id"), "url", "html")


def longest_panes(snapshots: DataFrame) -> DataFrame:
    """Of tab snapshots (page_id, pane_id, seq, html) the one with the longest text for each pane, the first of equals."""
    text = F.length(strip(F.regexp_replace("html", r"<[^>]*>", " ")))
    return snapshots.groupBy("page_id", "pane_id").agg(F.max_by("html", F.struct(text, -F.col("seq"))).alias("html"))
