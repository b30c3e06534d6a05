"""Fill-in-middle: each document cut in three at token boundaries that a seed chooses, and put together with markers.

A token is a run of characters that are not white space with the white space before it, or the white space that ends a text.
Copies of one text share their boundaries, so these are found once for each distinct text: texts are grouped by their content
(the digest only deals them out), and the ends of their tokens become an Elias-Fano list, about two bits and the logarithm of the mean
token length for each.  The lists, about a tenth of the text, are joined back to the documents, and each document selects its two cuts.

Scale: copies meet map-side before texts are shuffled.  The second shuffle carries texts to the lists by digest; both sides of that join come
straight from an exchange, so adaptive execution may split a text that a third of the documents share.  A task in Python holds one
text's boundaries at a time, found in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stored
from .hashing import pieces

SEED = 42
#: Documents of a hundred that are rearranged, and of those, suffix first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a text that are looked at together.
PIECE = 1 << 22

_ONES = np.array([bin(k).count("1") for k in range(256)], dtype=np.int64)
_LISTS = "n long, size long, low binary, high binary"


def ends_of(text: np.ndarray) -> tuple[np.ndarray, int]:
    """Where tokens end, in code points, and the number of code points, of a text's UTF-8 bytes."""
    found, points = [], 0
    for start in range(0, len(text), PIECE):
        part = text[start : start + PIECE + 1]  # with the byte that follows
        blank = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
        own = min(PIECE, len(part))
        after = np.ones(own, dtype=bool)  # the text's end counts as white space
        after[: len(part) - 1] = blank[1 : own + 1]
        first = (part[:own] & 0xC0) != 0x80  # bytes that begin a code point
        upto = np.cumsum(first)
        found.append(points + upto[~blank[:own] & after])
        points += int(upto[-1])
    ends = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
    if points and (not len(ends) or ends[-1] < points):
        ends = np.append(ends, points)  # white space at the end is a token
    return ends.astype(np.int64), points


def low_bits(n: int, size: int) -> int:
    """Bits of a value that are kept as they are, in a list of ``n`` values up to ``size``."""
    return max(0, (size // n).bit_length() - 1) if n else 0


def packed(ends: np.ndarray, size: int) -> tuple[bytes, bytes]:
    """An ascending list in Elias-Fano form: the low bits one after the other, the rest in unary."""
    wide = low_bits(len(ends), size)
    low = (ends[:, None] >> np.arange(wide)) & 1
    high = np.zeros(len(ends) + (size >> wide) + 1, dtype=np.uint8)
    high[(ends >> wide) + np.arange(len(ends))] = 1
    return np.packbits(low.astype(np.uint8), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


def chosen(n: int, size: int, low: bytes, high: bytes, places: list[int]) -> list[int]:
    """The values at places of a list that :func:`packed` made, counted from 1; that at 0 is 0."""
    bits, wide = np.frombuffer(high, dtype=np.uint8), low_bits(n, size)
    upto = np.cumsum(_ONES[bits])
    out = []
    for place in places:
        if not place:
            out.append(0)
            continue
        at = int(np.searchsorted(upto, place))  # the byte that has the place's one
        ones = np.flatnonzero(np.unpackbits(bits[at : at + 1], bitorder="little"))
        top = 8 * at + int(ones[place - 1 - (int(upto[at - 1]) if at else 0)]) - (place - 1)
        first = (place - 1) * wide
        window = int.from_bytes(low[first // 8 : (first + wide + 7) // 8], "little") >> (first % 8)
        out.append((top << wide) | (window & ((1 << wide) - 1)))
    return out


def listed(text: Column) -> Column:
    """The Elias-Fano list of a text's token ends."""

    @F.arrow_udf(_LISTS)
    def lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in pieces(batches, 64):
            rows = []
            for t in texts:
                ends, size = ends_of(np.frombuffer(t.as_buffer() or b"", dtype=np.uint8))
                low, high = packed(ends, size)
                rows.append((len(ends), size, low, high))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)], names=["n", "size", "low", "high"])

    return lists(text)


def selected(lists: Column, one: Column, other: Column) -> Column:
    """The ends at two places of a list, as (first, last)."""

    @F.arrow_udf("first long, last long")
    def select(lists_: pa.Array, one_: pa.Array, other_: pa.Array) -> pa.Array:
        n, size, low, high = (lists_.field(k).to_pylist() for k in range(4))
        rows = [chosen(*row[:4], sorted(row[4:])) for row in zip(n, size, low, high, one_.to_pylist(), other_.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], type=pa.int64()) for k in (0, 1)], names=["first", "last"])

    return select(lists, one, other)


def index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _list): the token ends of each distinct text, stored.

    Texts are grouped by their content, so two of one digest would be two rows; that is looked for, and an error.
    """
    made = stored(docs.groupBy(F.col(key).alias("_key"), F.col(text).alias("_one")).agg(F.count("*").alias("copies")).select("_key", "copies", listed(F.col("_one")).alias("_list")))
    if not made.groupBy("_key").count().where("count > 1").isEmpty():
        raise ValueError("two different texts have one digest")
    return made


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "<[PSM]>", -1)
    one, two, three = (F.get(parts, k) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def rearranged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id, text, n, form, first, last, output) for each row of ``docs``.

    ``n`` tokens; the middle is from ``first`` to ``last``, in code points.  Form ``plain``: the text as it is, if it is empty, holds a marker, or
    its seed says so; ``psm``: prefix, suffix, middle, each after its marker; ``spm``: suffix, prefix, middle.  The seed's numbers come from
    SHA-256 of ``seed:id`` (null id: nothing after the colon), so reruns agree, and rows that repeat have one output.  Null is an empty text; a text without
    white space is one token, one of white space alone as well.  Texts of any length are read whole.  An empty table gives no rows.  Only id and
    text are read, so no other column can clash.
    """
    whole = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    own = docs.select(F.col(quoted(id_col)).alias("_id"), whole.alias("_text")).withColumn("_key", F.coalesce(F.unhex(F.sha2("_text", 256)), F.lit(b"")))
    lists = index(own, "_key", "_text")
    number = lambda k: F.conv(F.substring("_drawn", 8 * k + 1, 8), 16, 10).cast("long")
    marked = F.greatest(*[F.contains("_text", F.lit(m)).cast("int") for m in (PREFIX, SUFFIX, MIDDLE)]) > 0
    form = F.when((F.col("_text") == "") | marked | (number(2) % 100 >= rate), "plain").when(number(3) % 100 < suffix_first, "spm").otherwise("psm")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    joined = own.join(lists.hint("merge"), "_key").withColumn("_drawn", drawn).select(  # lists grow with the texts: never broadcast
        "_id", "_text", form.alias("form"), "_list", (number(0) % (F.col("_list.n") + 1)).alias("_one"), (number(1) % (F.col("_list.n") + 1)).alias("_other")
    )
    cut = joined.withColumn("_cut", selected(F.col("_list"), F.col("_one"), F.col("_other"))).withColumn("_first", F.col("_cut.first").cast("int")).withColumn("_last", F.col("_cut.last").cast("int"))
    text, first, last = F.col("_text"), F.col("_first"), F.col("_last")
    prefix, middle, suffix = F.substr(text, F.lit(1), first), F.substr(text, first + 1, last - first), F.substr(text, last + 1)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    return cut.select(F.col("_id").alias(id_col), text.alias("text"), F.col("_list.n").alias("n"), "form", F.col("_first").cast("long").alias("first"), F.col("_last").cast("long").alias("last"), output.alias("output"))
