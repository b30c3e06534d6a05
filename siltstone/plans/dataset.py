"""A dataset kept by key: insert or update, append, and what happened to each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_empty, quoted, strip


def key_of(keys: list[str]) -> Column:
    """Keys compare without case and surrounding blanks; two empty ones are equal."""
    return F.array(*[F.lower(strip(F.coalesce(F.col(quoted(k)).cast("string"), F.lit("")))) for k in keys])


def upserted(old: DataFrame, new: DataFrame, keys: list[str], *, seq: str = "seq", created: str = "extraction_date", changed: str = "last_updated", now: str) -> DataFrame:
    """``old`` after the rows of ``new``, with ``operation``.

    The last row of a key wins in every column, blanks included; its first place and date of creation
    stay.  Without key columns that both sides have, every row is new.  One shuffle on the key; the
    aggregates are taken map-side, so a key that comes a million times is one row a task.
    """
    own = [k for k in keys if k in old.columns and k in new.columns]
    values = [c for c in old.columns if c not in (seq, created, changed)]
    rank = lambda df, batch: df.select(*[F.col(quoted(c)) if c in df.columns else F.lit(None).cast("string").alias(c) for c in values], F.col(seq).alias("_seq"), F.lit(batch).alias("_batch"), *[F.col(c) if c in df.columns and batch == 0 else F.lit(now).alias(c) for c in (created, changed)])
    both = rank(old, 0).unionByName(rank(new, 1))
    both = both.withColumn("_key", key_of(own) if own else F.array(F.col("_batch").cast("string"), F.col("_seq").cast("string")))
    place = F.struct("_batch", "_seq")
    merged = both.groupBy("_key").agg(
        F.max_by(F.struct(*map(quoted, values), F.col(changed).alias("_changed")), place).alias("last"),
        F.min_by(F.struct(F.col(created).alias("_created"), F.col("_batch").alias("_from")), place).alias("first"),
        F.min(place).alias("_place"),
        F.max("_batch").alias("_touched"),
    )
    return merged.select(
        *[F.col(f"last.{quoted(c)}").alias(c) for c in values],
        F.col("_place._seq").alias(seq),
        F.col("first._created").alias(created),
        F.col("last._changed").alias(changed),
        F.when(F.col("_touched") == 0, F.lit("Unchanged")).when(F.col("first._from") == 0, F.lit("Updated")).otherwise(F.lit("Inserted")).alias("operation"),
    )


def split_valid(records: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have all required fields, and those that do not with what they lack."""
    missing = F.array_compact(F.array(*[F.when(is_empty(F.col(f)), F.lit(f)) for f in required]))
    tagged = records.withColumn("missing", missing)
    return tagged.where(F.size("missing") == 0).drop("missing"), tagged.where(F.size("missing") > 0)


def provenance(fields: list[str], sources: list[Column]) -> tuple[Column, Column]:
    """Comma lists of the fields that came from pages and from the model."""
    of = lambda name: F.array_join(F.array_compact(F.array(*[F.when(s == name, F.lit(f)) for f, s in zip(fields, sources, strict=True)])), ", ")
    return of("Deterministic"), of("LLM")


def quality_score(coverage: Column, in_page: Column, required: Column, valid: Column, invented: Column, critical: Column) -> Column:
    """0 to 100: weighted shares (of 100), less a penalty for each invented and each missing critical field."""
    raw = 0.3 * coverage + 0.3 * in_page + 0.2 * required + 0.2 * valid - 15.0 * invented - critical * F.lit(10.0) / 3
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def job_status(outcomes: DataFrame, job: str, outcome: str) -> DataFrame:
    """(job, status, counts) of per-url outcomes: cancelled, then partial (both), failed, completed."""
    of = lambda name: F.count_if(F.col(outcome) == name)
    counted = outcomes.groupBy(job).agg(F.count("*").alias("urls"), of("success").alias("completed"), of("failed").alias("failed"), of("cancelled").alias("cancelled"))
    status = F.when(F.col("cancelled") > 0, "cancelled").when((F.col("failed") > 0) & (F.col("completed") > 0), "partial").when(F.col("failed") > 0, "failed").otherwise("completed")
    return counted.withColumn("status", status)
