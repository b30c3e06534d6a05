"""Substring dedup: words covered by a 20-word window that occurs earlier go.

Anchors narrow the search: of the 8-word grams in a window, the one with the least hash is its anchor,
so that equal windows have equal anchors and neighbours mostly share one.  Anchors that occur once in the
whole table rule their windows out; the windows of the others are hashed, the first document of
each is found, and every occurrence in a later document, or later in its own, is located and its words cut.

Scale: one text in seven words is an anchor, counted map-side by two marks of the texts that have
it; recurring windows' hashes are grouped by minima and joined back by sort-merge joins that adaptive execution may split.
Windows are told apart by 128 bits.  Copies of a text are one text when windows are made, whatever their number.  A document's
anchors and cuts gather in one row each, which its length bounds.  Each phase is a table, so nothing is computed
twice and what a phase shuffled is gone before the next.  Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt_anew, discard, quoted, stored
from .hashing import mixed, pieces, sequence_hashes, word_hashes
from .jaccard import internal_id

WINDOW, GRAM = 20, 8
_OTHER = np.uint64(0xD1B54A32D192ED03)


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, the first window start that it serves, and how many starts it serves."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = sequence_hashes(words, GRAM)
    seen = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    at = seen.argmin(axis=1) + np.arange(len(seen))
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    return grams[at[starts]], starts, np.diff(starts, append=len(at))


def _packed(parts: list[list[np.ndarray]], names: list[str], kinds: list) -> pa.Array:
    """A list array of structs, a list for each of ``parts``."""
    offsets = np.cumsum([0, *(len(p[0]) for p in parts)]).astype(np.int32)
    columns = [pa.array(np.concatenate([p[k] for p in parts] or [np.zeros(0, kind)]).astype(kind)) for k, kind in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names))


def _array_of(**fields) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


@F.arrow_udf(_array_of(a=T.LongType(), s=T.IntegerType(), m=T.IntegerType(), again=T.IntegerType()))
def _anchors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pieces(texts):
        parts = []
        for t in batch:
            a, s, m = anchors(word_hashes((t.as_py() or b"").split()))
            _, place, n = np.unique(a, return_inverse=True, return_counts=True)
            parts.append([a.view(np.int64), s, m, n[place] > 1])
        yield _packed(parts, ["a", "s", "m", "again"], [np.int64, np.int32, np.int32, np.int32])


def _earlier_in_text(hashes: np.ndarray) -> np.ndarray:
    """Whether each window's hash occurs at an earlier start."""
    _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    return first[place] < np.arange(len(hashes))


@F.arrow_udf(_array_of(w=T.LongType(), v=T.LongType(), s=T.IntegerType()))
def _windows(texts: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
    """Two hashes and start of the windows that the given anchors serve, without those that the text itself has earlier."""
    parts = []
    for t, s, m in zip(texts, starts, sizes, strict=True):
        words = word_hashes(t.as_py().split())
        hashes, others = sequence_hashes(words, WINDOW), sequence_hashes(mixed(words ^ _OTHER), WINDOW)
        want = np.zeros(len(hashes), dtype=bool)
        for a, n in zip(s.values.to_numpy(), m.values.to_numpy(), strict=True):
            want[a : a + n] = True
        at = np.flatnonzero(want & ~_earlier_in_text(hashes))
        parts.append([hashes[at].view(np.int64), others[at].view(np.int64), at])
    return _packed(parts, ["w", "v", "s"], [np.int64, np.int64, np.int32])


@F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))
def _cut(texts: pa.Array, copies: pa.Array, starts: pa.Array) -> pa.Array:
    out_n, out_gone, out_text = [], [], []
    for t, copy, s in zip(texts, copies, starts, strict=True):
        words = (t.as_py() or b"").split()
        gone = np.zeros(len(words), dtype=bool)
        if len(words) >= WINDOW:
            if copy.as_py():
                gone[:] = True
            else:
                at = _earlier_in_text(sequence_hashes(word_hashes(words), WINDOW))
                if s.is_valid:
                    at[s.values.to_numpy()] = True
                edges = np.zeros(len(words) + 1, dtype=np.int64)
                where = np.flatnonzero(at)
                np.add.at(edges, where, 1)
                np.add.at(edges, where + WINDOW, -1)
                gone = np.cumsum(edges[:-1]) > 0
        kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        out_n.append(len(words))
        out_gone.append(int(gone.sum()))
        out_text.append(b" ".join(kept))
    return pa.StructArray.from_arrays([pa.array(out_n, pa.int64()), pa.array(out_gone, pa.int64()), pa.array(out_text, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space.

    Documents come in the order of their ids, whole numbers; null ids come first.  Rows that share an id
    are one document, and none's windows are earlier than another's; rows that share text as well get the same
    result.  Null texts have no words; texts under 20 words lose none; of any length they are read whole.  An empty table gives no
    rows.  Other columns of ``docs`` stay, whatever their names, but for those named above, which are replaced.
    """
    new = ["n_words", "n_removed", "kept"]
    given = [c for c in docs.columns if c not in new]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    tagged = docs.select(
        F.struct(*[F.col(quoted(c)) for c in given]).alias("_row"), text.cast("binary").alias("_text"), internal_id(F.col(quoted(id_col)), text).alias("u"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")
    )
    owners = stored(tagged.select("u", "k1", "k2").groupBy("k1", "k2").agg(F.min("u").alias("c"), F.count("*").alias("n")))
    copies = tagged.select("u", "k1", "k2").join(owners.where("n > 1").drop("n"), ["k1", "k2"]).where("u <> c").select("u", "k1").distinct()

    # outer explodes: an inner one would have the arrays made once more, to filter by their size
    spots = stored(tagged.select("k1", F.explode_outer(_anchors("_text")).alias("x")).select("k1", "x.*").where("a is not null"))
    ends = spots.groupBy("a").agg(F.min("k1").alias("one"), F.max("k1").alias("other"), F.max("again").alias("again")).where("one <> other or again = 1")
    recurring = stored(ends.select(dealt_anew(F.col("a")).alias("b")))
    served = spots.withColumn("b", dealt_anew(F.col("a"))).join(recurring, "b").groupBy("k1").agg(F.collect_set(F.struct("s", "m")).alias("x"))
    wanted = stored(served.join(owners, "k1").select("k1", F.col("c").alias("u"), F.col("x.s").alias("s"), F.col("x.m").alias("m")))
    discard(spots, recurring)

    windows = tagged.select("_text", "u", "k1").join(wanted, ["u", "k1"]).select("u", "k1", F.explode_outer(_windows("_text", "s", "m")).alias("x"))
    rows = stored(windows.select("u", "k1", "x.*").where("w is not null"))
    discard(wanted)
    firsts = stored(rows.groupBy("w", "v").agg(F.min("u").alias("first"), F.max("u").alias("last")).where("first < last").select(dealt_anew(F.col("w")).alias("x"), "v", "first"))
    late = stored(rows.withColumn("x", dealt_anew(F.col("w"))).join(firsts, ["x", "v"]).where("u > first").groupBy("u", "k1").agg(F.collect_set("s").alias("starts")))
    discard(rows, firsts)

    known = late.select("u", "k1", "starts", F.lit(False).alias("copy")).unionByName(copies.select("u", "k1", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy")))
    joined = tagged.select("_row", "u", "k1").join(known, ["u", "k1"], "left")
    done = joined.select("_row", _cut(F.col(f"_row.{quoted(text_col)}").cast("binary"), F.coalesce("copy", F.lit(False)), "starts").alias("x"))
    return done.select(*[F.col(f"_row.{quoted(c)}").alias(c) for c in given], *[F.col(f"x.{c}").alias(c) for c in new])
