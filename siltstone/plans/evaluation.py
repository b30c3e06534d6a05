"""How good a run's records are: each field against its page, and a score for the record."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import evidence
from ..sources import shared

# The fields that a record may have, those that weigh most, those that no page is asked for; the weights of the score.
FIELDS = ("page_type", "source_url", "franchise_name", "brand", "industry", "category", "description", "about", "business_model", "investment_required", "franchise_fee", "royalty", "roi", "payback_period", "area_required", "store_size", "products", "services", "training", "marketing_support", "business_support", "contact_person", "phone", "email", "website", "address", "city", "state", "country", "facebook", "instagram", "linkedin", "youtube", "faq", "images", "documents", "additional_information")
CRITICAL = ("franchise_name", "investment_required", "area_required", "phone", "email", "website", "business_model", "business_support")
NOT_ON_PAGE = ("page_type", "source_url", "additional_information")
REQUIRED = ("franchise_name", "source_url")
FOUND, INVENTED, MISSED, ABSENT, NULL = "Extracted Successfully", "Possible Hallucination", "Likely Missed", "Missing on Page", "Null"


def _filled(c: Column, is_list: bool) -> Column:
    return c.isNotNull() & (F.size(c) > 0) if is_list else c.isNotNull() & (F.trim(c.cast("string")) != "")


def evaluated(records: DataFrame, *, page: str = "evidence", fields: Iterable[str] = FIELDS, required: Iterable[str] = REQUIRED) -> DataFrame:
    """``records`` with ``statuses`` (a map of field to status), ``odd`` (an array), the parts of the score and ``score``.

    The column ``page`` is ``evidence.page`` of the record's page.  A field that the records lack as a column counts
    as empty.  A row is evaluated by itself, in one projection: nothing is shuffled.
    """
    kinds = dict(records.dtypes)
    statuses, odd = [], []
    for f in fields:
        is_list, has = kinds.get(f, "").startswith("array"), f in kinds
        value = F.col(f) if has else F.lit(None).cast("string")
        filled = _filled(value, is_list) if has else F.lit(False)
        if f in NOT_ON_PAGE:
            status = F.when(filled, FOUND).otherwise(NULL)
        else:
            on = F.col(page)
            told = evidence.any_borne_out(f, value, on) if is_list else evidence.borne_out(f, value.cast("string"), on)
            status = F.when(filled, F.when(told, FOUND).otherwise(INVENTED)).otherwise(F.when(evidence.spoken_of(f, on), MISSED).otherwise(ABSENT))
        statuses.append(F.struct(F.lit(f).alias("key"), status.alias("value")))
        if has:
            odd.append(F.when(filled, evidence.odd_items(f, value) if is_list else F.array_compact(F.array(evidence.odd(f, value.cast("string"))))).otherwise(F.array().cast("array<string>")))
    wanted = [r.strip().lower().replace(" / ", "_").replace(" ", "_") for r in required]
    have = F.lit(0)
    for f in wanted:
        have = have + (_filled(F.col(f), kinds[f].startswith("array")).cast("int") if f in kinds else F.lit(0))
    made = records.select("*", F.array(*statuses).alias("_statuses"), F.flatten(F.array(*odd)).alias("odd"), have.alias("_have"))
    of = lambda s, among=None: F.size(F.filter("_statuses", lambda x: (x["value"] == s) & (x["key"].isin(*among) if among else F.lit(True))))
    counted = made.select("*", of(FOUND).alias("n_found"), of(INVENTED).alias("n_invented"), of(MISSED).alias("n_missed"), (of(ABSENT) + of(NULL)).alias("n_absent"), of(MISSED, CRITICAL).alias("_critical_missed"), of(ABSENT, CRITICAL).alias("_critical_absent"))
    present = F.greatest(F.lit(1), F.col("n_found") + F.col("n_missed"))
    scored = counted.select(
        "*",
        F.format_string("%d / %d", F.col("n_found"), present).alias("coverage"),
        (F.col("n_found") / present * 100).alias("coverage_percent"),
        F.greatest(F.lit(0.0), 100.0 - F.col("n_missed") * 15 - F.col("n_invented") * 25).alias("page_score"),
        (F.col("_have") * F.lit(100.0) / F.lit(float(max(1, len(wanted))))).alias("required_percent"),
        F.greatest(F.lit(0.0), 100.0 - F.size("odd") * 10).alias("valid_percent"),
        F.when(F.col("n_found") + F.col("n_invented") > 0, 100.0).otherwise(0.0).alias("completeness"),
    )
    base = F.col("coverage_percent") * 0.3 + F.col("page_score") * 0.3 + F.col("required_percent") * 0.2 + F.col("valid_percent") * 0.2
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - F.col("n_invented") * 15.0 - F.col("_critical_missed") * 10.0 - F.col("_critical_absent") * 3.0))
    return scored.select(*[F.col(c) for c in records.columns], F.map_from_entries("_statuses").alias("statuses"), *[F.col(c) for c in ("odd", "n_found", "n_invented", "n_missed", "n_absent", "coverage", "coverage_percent", "page_score", "required_percent", "valid_percent", "completeness")], score.alias("score"))


def with_status(status: str, statuses: Column | str = "statuses") -> Column:
    """The fields of a status, in the order of ``FIELDS``."""
    s = F.col(statuses) if isinstance(statuses, str) else statuses
    return F.filter(F.map_keys(s), lambda k: F.element_at(s, k) == status)


def report_text() -> Column:
    """The report of an evaluated record as text."""
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("None"))
    lines = F.array(
        F.concat(F.lit("Coverage: "), F.col("coverage"), F.format_string(" (%.1f%%)", F.col("coverage_percent"))),
        F.format_string("Confidence: %.1f%%", F.col("score")),
        F.format_string("Completeness: %.1f%%", F.col("completeness")),
        F.format_string("Page match: %.1f%%", F.col("page_score")),
        F.concat(F.lit("Likely missed: "), listed(with_status(MISSED))),
        F.concat(F.lit("Missing on page: "), listed(with_status(ABSENT))),
        F.concat(F.lit("Possible hallucinations: "), listed(with_status(INVENTED))),
        F.concat(F.lit("Warnings: "), F.size("odd").cast("string")),
    )
    return F.array_join(F.concat(lines, F.transform("odd", lambda w: F.concat(F.lit("- "), w))), "\n")


def quality_log(evaluated_records: DataFrame, *, now: str, seconds: str = "seconds", tokens: str = "tokens") -> DataFrame:
    """One row a record for the log of quality: what was found, how sure, how long, how many tokens."""
    has = evaluated_records.columns
    critical = F.array_intersect(F.concat(with_status(MISSED), with_status(ABSENT)), F.array(*[F.lit(c) for c in CRITICAL]))
    return evaluated_records.select(
        F.lit(now).alias("timestamp"),
        F.coalesce("source_url", F.lit("Unknown URL")).alias("url"),
        "coverage",
        F.format_string("%.1f%%", F.col("page_score")).alias("dom_match"),
        F.format_string("%.1f%%", F.col("score")).alias("confidence"),
        F.col("n_invented").alias("hallucinations"),
        F.coalesce(F.nullif(F.array_join(critical, ", "), F.lit("")), F.lit("None")).alias("critical_fields_missing"),
        F.format_string("%.2f", F.col(seconds) if seconds in has else F.lit(0.0)).alias("execution_time_sec"),
        (F.col(tokens) if tokens in has else F.lit(0)).cast("long").alias("token_count"),
    )


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``number``, their place by ``order``, from 1; rows of one place are numbered in no set order.

    They are sorted by ranges over all tasks and stored so; a row's number is its place in its part and the rows of the parts before, of
    which there is a count for each part.  No task has all rows.
    """
    keys = [c.alias(f"_k{k}") for k, c in enumerate(order)]
    names = [f"_k{k}" for k in range(len(order))]
    sorted_ = rows.select("*", *keys).repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    ranged = shared.stored("numbered", sorted_.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a part
    shift = counts.select("_part", (before - F.col("_low") + 1).alias("_shift"))
    return ranged.withColumn("_part", part).join(shift, "_part").withColumn("number", F.col("_at") + F.col("_shift")).drop("_part", "_shift", "_at")


def benchmark_items(rows: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """Rows of a sheet without empty cells and empty rows, as (id, item): the prefix in upper case and a number, and JSON."""
    full = F.array_compact(F.array(*[F.when(F.trim(F.col(c).cast("string")) != "", F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in rows.columns]))
    kept = rows.withColumn("_cells", full).where(F.size("_cells") > 0)
    placed = numbered(kept, [F.col(c) for c in order])
    return placed.select(F.format_string(f"{prefix.upper()}%04d", "number").alias("id"), F.to_json(F.map_from_entries("_cells")).alias("item"))
