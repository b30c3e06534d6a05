"""Line dedup: overlapping three-line windows.

A text's lines are what ``\\n`` separates.  Every three lines in a row that are not all blank are a
window, known by a 128-bit hash.  Of windows alike anywhere in the table the first stays, by document
and position; a line goes if any later occurrence covers it.  Windows are judged on the input, not on what is left.

Scale: windows (hash, document, position) are grouped by hash with map-side minima, so that a window
that a third of all documents share is a row a task; repeated hashes are joined back by a sort-merge
join that adaptive execution may split.  Positions of a document gather in one row, which that text
bounds.  The text itself is shuffled once, for the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, dealt_anew, quoted, text_key

#: Lines of a window.
WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(h, g, doc, key, at): every window that has a word, ``at`` counting from 0; hash halves h and g."""
    lines = F.col("lines")
    one = F.slice(lines, F.col("at") + 1, size)
    return (
        docs.select(F.col("_doc").alias("doc"), F.col("_key").alias("key"), F.col("lines"))
        .where(F.size("lines") >= size)
        .select("doc", "key", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - size)).alias("at"))
        .withColumn("w", F.array_join(one, "\n"))
        .where(F.col("w").rlike(f"[^{BLANK}]"))
        .select(F.xxhash64("w").alias("h"), F.xxhash64(F.lit(1), "w").alias("g"), "doc", "key", "at")
    )


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``docs`` with later copies of repeated windows cut from the text, and ``n_lines``, ``n_removed``.

    Documents come in the order of their id, null first; texts that share an id in the order of their
    hash.  Rows that repeat an id and its text are one document and keep the same lines.  A null text
    is an empty one: a single blank line.  A text of fewer than three lines loses none, one of any length is read
    whole.  An empty table gives no rows.  Columns of
    ``docs`` stay, whatever their names, but for ``n_lines`` and ``n_removed``, which are replaced.
    """
    given = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    row, own_text = F.struct(*[F.col(quoted(c)) for c in given]), F.col(quoted(text_col))
    place_of = [F.col(quoted(id_col)).alias("_doc"), text_key(own_text).alias("_key")]
    found = windows(docs.select(*place_of, lines_of(own_text).alias("lines")), size)
    place = F.struct("doc", "key", "at")
    repeated = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(dealt_anew(F.col("h")).alias("x"), "g", "first")
    starts = (
        found.withColumn("x", dealt_anew(F.col("h")))
        .join(repeated, ["x", "g"])
        .where(~place.eqNullSafe(F.col("first")))
        .groupBy(F.col("doc").alias("_of"), F.col("key").alias("_text"))
        .agg(F.collect_set("at").alias("_starts"))
    )
    joined = docs.select(row.alias("_row"), *place_of).join(starts, F.col("_doc").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_text")), "left")
    joined = joined.withColumn("_lines", lines_of(F.col(f"_row.{quoted(text_col)}")))
    covered = F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + (size - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), covered)
    kept = joined.withColumn("_left", F.when(F.col("_starts").isNotNull(), left))
    cut_text = F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n")
    text = F.when(F.col("_left").isNull(), F.col(f"_row.{quoted(text_col)}")).otherwise(cut_text)
    return kept.select(
        *[(text if c == text_col else F.col(f"_row.{quoted(c)}")).alias(c) for c in given],
        F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_left").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_left")).cast("long").alias("n_removed"),
    )
