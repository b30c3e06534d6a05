"""Records of a page's pieces made into one, and pieces packed into batches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted, strip

# Texts that add up over pieces; other texts stand as first said.
APPENDED = ("page_summary", "additional_information", "description", "about", "business_model")
#: Fixed value: the kind of entity that alone is no reason to merge entities.
PLAIN_ENTITY = "Franchise Opportunity"


def appended(values: Column) -> Column:
    """Texts one below the other, without empty ones and ones that what stands already contains."""
    none = F.lit(None).cast("string")
    return F.aggregate(values, none, lambda acc, v: F.when(F.coalesce(acc, F.lit("")) == "", F.coalesce(v, acc)).when((F.coalesce(strip(v), F.lit("")) == "") | acc.contains(strip(v)), acc).otherwise(F.concat(acc, F.lit("\n"), v)))


def first_said(values: Column) -> Column:
    """The first that is not empty, else the last that is not null."""
    none = F.lit(None).cast("string")
    return F.aggregate(values, none, lambda acc, v: F.when(F.coalesce(acc, F.lit("")) == "", F.coalesce(v, acc)).otherwise(acc))


def united(lists: Column) -> Column:
    """The items of all lists, each once, in order; a single list stays as it is."""
    full = F.filter(lists, lambda x: x.isNotNull() & (F.size(x) > 0))
    return F.when(F.size(full) == 1, F.get(full, F.lit(0))).when(F.size(full) > 1, F.array_distinct(F.flatten(full)))


def merged_records(pieces: DataFrame, keys: list[str], seq: str, *, append: Iterable[str] = APPENDED) -> DataFrame:
    """One record for each of ``keys``, of its pieces in the order of ``seq``; lists unite, texts append or stand as first said.

    One shuffle on the keys.  A page's pieces gather in one row, which the page bounds.
    """
    fields = [c for c in pieces.columns if c not in keys and c != seq]
    kinds = dict(pieces.dtypes)
    held = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("_seq"), *fields))).alias("_all"))
    out = []
    for f in fields:
        values = F.col(f"_all.{quoted(f)}")
        if kinds[f].startswith("array"):
            out.append(united(values).alias(f))
        elif kinds[f] == "string":
            out.append((appended(values) if f in append else first_said(values)).alias(f))
        else:
            out.append(F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0)).alias(f))
    return held.select(*keys, *out)


def merged_entities(entities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entity_type, records) of (keys, seq, idx, entity_type, attributes), attributes a map: of records alike the first.

    Two maps with the same entries are alike in whatever order.  Types of a page come as ``place``, their first one's place.  A page
    that only has plain entities keeps those of its first piece.
    """
    place = F.struct("seq", "idx")
    alike = entities.groupBy(*keys, "entity_type", F.array_sort(F.map_entries("attributes")).alias("_form")).agg(F.min(place).alias("place"), F.min_by("attributes", place).alias("attributes"))
    by_type = alike.groupBy(*keys, "entity_type").agg(F.array_sort(F.collect_list(F.struct("place", F.array_sort(F.map_entries("attributes")).alias("attributes")))).alias("_all"), F.min("place").alias("place"))
    generic = by_type.groupBy(*keys).agg(F.max((F.col("entity_type") != PLAIN_ENTITY).cast("int")).alias("_generic"), F.min("place.seq").alias("_first"))
    whole = by_type.join(generic, keys)
    kept = F.when(F.col("_generic") == 1, F.col("_all")).otherwise(F.filter("_all", lambda r: r["place"]["seq"] == F.col("_first")))
    return whole.select(*keys, "entity_type", "place", F.transform(kept, lambda r: F.map_from_entries(r["attributes"])).alias("records"))


def batches(sizes: Column, limit: int) -> Column:
    """The number of the batch of each size, counted from 0: sizes fill a batch in order as long as they fit, and one too large is alone."""
    start = F.struct(F.lit(-1).alias("batch"), F.lit(limit).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def put(s: Column, n: Column) -> Column:
        fits = (s["batch"] >= 0) & (s["used"] + n <= limit)
        batch = F.when(fits, s["batch"]).otherwise(s["batch"] + 1)
        return F.struct(batch.alias("batch"), F.when(fits, s["used"] + n).otherwise(n).cast("long").alias("used"), F.concat(s["out"], F.array(batch)).alias("out"))

    return F.aggregate(sizes, start, put, lambda s: s["out"])
