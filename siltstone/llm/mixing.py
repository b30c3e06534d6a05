"""Mixing sources to target weights by hash thresholds, without sorting.

A document's hash, of its id and text, decides its place in its source.  Words are summed by source and by the hash's
leading bits; the bucket in which the running sum meets the source's budget is the boundary, and only
that bucket is split further by the next bits, until it holds one hash.  The budgets nest: every
document of a source is taken ``copies`` times, and those below the threshold once more.

Scale: one pass counts words and keeps (id, source, size, hash), a few dozen bytes a document; each
refinement reads that and sums at most ``2**BITS`` buckets a source, before the shuffle.  A hot source
is summed map-side and thresholds come back by a broadcast when the sources are few (checked), else by
a join on source and salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, n_words_of, quoted, small, stored

WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and the most that it takes of a source, in times its size.
SHARE, MOST = 1.5, 2
#: Bits of the hash by which a boundary bucket is split at a time; four rounds use up all 64.
BITS = 16
#: Sources up to which thresholds are broadcast; beyond, they are joined on source and salt.
FEW_SOURCES, SALTS = 10_000, 64


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target) of (source, source_size); one row a source.

    The target is ``rest * weight / weights of the sources below their cap``, where ``rest`` is what
    capped sources leave of the share.  Sources reach their cap in the order of size a unit of weight,
    so the capped ones are a prefix of that order: those whose cap is at most their part of what the
    ones before leave.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    order = [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(most)))
        .withColumn("_weights", F.sum("weight").over(onward))
        .withColumn("_full", F.col("source_size") * F.lit(float(most)) <= F.col("_left") * F.col("weight") / F.col("_weights"))
    )
    # the first source below its cap sets the rate for all after it
    rate = lambda c: F.min_by(F.when(~F.col("_full"), F.col(c)), F.when(~F.col("_full"), F.col("source_size") / F.col("weight"))).over(everything)
    return ranked.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("_full"), F.col("source_size") * F.lit(float(most))).otherwise(rate("_left") * F.col("weight") / rate("_weights")).alias("target"),
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``copies`` (of every document) and ``below``: hashes under it are taken once more.

    ``sized`` is (source, size, hash), the hash an unsigned 64-bit number as a long.  The threshold is
    the one whose words come nearest to what the copies leave of the target.
    """
    state = goals.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).select(
        "*",
        (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"),  # of the boundary bucket, right-aligned
        F.lit(False).alias("over"),  # nothing is left to split
        F.lit(None).cast("long").alias("below"),  # exclusive, unsigned; null: no hash
        F.lit(False).alias("whole"),  # the boundary is past every hash
    )
    few = small(goals, FEW_SOURCES)
    for done in range(0, 64, BITS):
        parted = with_source(sized, state.select("source", "prefix", "over", "rest"), few)
        head = F.shiftrightunsigned("hash", 64 - done) if done else F.lit(0).cast("long")
        bucket = F.shiftrightunsigned("hash", 64 - done - BITS)
        sums = (
            parted.where(~F.col("over") & (F.col("rest") > 0) & (head == F.col("prefix")))
            .groupBy("source", "rest", bucket.alias("bucket"))
            .agg(F.sum("size").alias("words"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        )
        # at most 2**BITS rows a source
        run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        met = (
            sums.withColumn("upto", F.sum("words").over(run))
            .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
            .select(F.col("source").alias("_met"), F.col("bucket").alias("_bucket"), (F.col("upto") - F.col("words")).alias("_before"), F.col("words").alias("_words"), (F.col("low") == F.col("high")).alias("_one"))
        )
        last = done + BITS >= 64
        nearer = (F.col("rest") - F.col("_before")) * 2 > F.col("_words")  # than without the last document
        start = F.shiftleft("_bucket", 64 - done - BITS)
        joined = state.join(met, F.col("source").eqNullSafe(F.col("_met")), "left")
        hit = F.col("_bucket").isNotNull()
        final = hit & (F.col("_one") | F.lit(last))
        ending = F.shiftleft(F.col("_bucket") + 1, 64 - done - BITS)  # 0: past the last hash
        active = ~F.col("over")
        former = [state] if done else []
        state = stored(
            joined.select(
                "source",
                "source_size",
                "weight",
                "target",
                "copies",
                F.when(hit, F.col("rest") - F.col("_before")).otherwise(F.col("rest")).alias("rest"),
                F.when(hit, F.col("_bucket")).otherwise(F.col("prefix")).alias("prefix"),
                (F.col("over") | final | ~hit).alias("over"),
                F.when(active & final, F.when(nearer, ending).otherwise(start)).when(active & hit, start).otherwise(F.col("below")).alias("below"),
                F.when(active & final, nearer & (ending == 0)).when(active & ~hit & (F.col("rest") > 0) & F.lit(done == 0), F.lit(True)).otherwise(F.col("whole")).alias("whole"),
            )
        )
        discard(*former)
        if state.where(~F.col("over")).isEmpty():
            break
    return state.select("source", "source_size", "target", "copies", "below", "whole")


def with_source(docs: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """``docs`` with the columns of ``sources``; null is a source like any other."""
    named = sources.withColumnRenamed("source", "_source")
    if few:
        return docs.join(F.broadcast(named), docs["source"].eqNullSafe(F.col("_source"))).drop("_source")
    salted = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("_own", F.pmod("hash", F.lit(SALTS)).cast("int")).join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_salt"))).drop("_source", "_salt", "_own")


def taken_times(extra_below: Column, whole: Column, copies: Column) -> Column:
    flip = F.lit(-(1 << 63)).cast("long")  # longs compare signed; the flip makes it unsigned
    more = whole | (extra_below.isNotNull() & (F.col("hash").bitwiseXOR(flip) < extra_below.bitwiseXOR(flip)))
    return copies + F.when(more, F.lit(1)).otherwise(F.lit(0)).cast("long")


def hash_of(id_: Column, text: Column) -> Column:
    """Of id and text: rows without an id, or with one and the same, are told apart by text; null ids and texts differ from empty ones."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("="), text), F.lit("")))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_id, source, size, hash) of every row."""
    id_, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    return docs.select(id_.alias("_id"), F.col(quoted(source_col)).alias("source"), n_words_of(text).alias("size"), hash_of(id_, text).alias("hash"))


def decided(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, copies, below, whole): for each source of (source, size, hash) what is taken of it."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(sized, stored(targets(sizes, weights, share, most)))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for every row of ``docs``.

    Sources rank by code point, null last, and take their weights in turn.  ``taken`` is ``size * copies``.
    A document is taken whole or not at all, at most ``ceil(most)`` times; rows that share source, id and text share
    their decision; empty texts have size 0 and are taken like the rest; an empty table gives no rows.  A
    source in which all rows are equal can't be split: then the nearer of none and all is taken.  Of texts only words are counted,
    whatever their length.  No other column is read, so none can clash.
    """
    sized = stored(measured(docs, id_col, text_col, source_col))
    found = decided(sized, weights, share, most)
    out = with_source(sized, found, small(found, FEW_SOURCES))
    return out.select(
        F.col("_id").alias(id_col),
        "size",
        "source_size",
        "target",
        taken_times(F.col("below"), F.col("whole"), F.col("copies")).alias("copies"),
    ).withColumn("taken", F.col("size") * F.col("copies"))


def mix_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` takes, each once, with ``copies`` and ``taken``; columns of these names are replaced.

    Nothing is joined by document: a row's own hash meets its source's threshold.
    """
    found = decided(stored(measured(docs, id_col, text_col, source_col)), weights, share, most)
    given = [c for c in docs.columns if c not in ("copies", "taken")]
    id_, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in given]).alias("_row"), F.col(quoted(source_col)).alias("source"), n_words_of(text).alias("size"), hash_of(id_, text).alias("hash"))
    taken = with_source(rows, found, small(found, FEW_SOURCES)).withColumn("copies", taken_times(F.col("below"), F.col("whole"), F.col("copies"))).where("copies > 0")
    return taken.select(*[F.col(f"_row.{quoted(c)}").alias(c) for c in given], "copies", (F.col("size") * F.col("copies")).alias("taken"))
