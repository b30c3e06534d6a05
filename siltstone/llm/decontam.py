"""Benchmark decontamination with one Aho-Corasick automaton.

Texts become their words: A-Z lower-cased, ASCII letters, digits and all non-ASCII characters in a row.
Every ten words of a benchmark item are a window (all of them, if it has fewer), and one automaton over
all windows, with spaces around each word so that matches begin and end at words, scans a text once.
Occurrences map to word positions and from there to characters of the original.

Scale: one scan without a shuffle.  The automaton grows with the benchmark, never with the documents:
up to ``MAX_CHARS`` of items are one automaton in each Python worker; a larger benchmark is dealt to
shards of that size, one scan of the texts each, which give out only what they found, by digest of the text.  These are merged and
joined back to the documents once, so results do not depend on the number of shards.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stored

WINDOW = 10
#: Characters of benchmark that one automaton takes; about 100 bytes of memory each.
MAX_CHARS = 2_000_000
#: A word before its letters are lowered.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes as they count: A-Z lower, other ASCII but letters and digits a space; of longer characters nothing changes.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
FOUND = "struct<n_words:bigint,words:array<bigint>,items:array<string>,spans:array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def automaton_of(items: list[tuple[str, bytes]], size: int = WINDOW):
    """Over every window of the items; each carries its number of words and the items that have it."""
    having: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for k in range(max(len(words) - size, 0) + 1 if words else 0):
            having[b" ".join(words[k : k + size])].add(item)
    machine = ahocorasick.Automaton()
    for window, of in having.items():
        machine.add_word(f" {window.decode()} ", (window.count(b" ") + 1, sorted(of)))
    if having:
        machine.make_automaton()
    return machine if having else None


def scan(text: bytes, machine) -> tuple[int, list[int], list[str], list[dict]]:
    """Words, positions of hit words, items found, and hit runs: first and last word, and code points of the original."""
    words = words_of(text)
    if machine is None or not words:
        return len(words), [], [], []
    found = list(machine.iter(f" {b' '.join(words).decode()} "))
    if not found:
        return len(words), [], [], []
    # the blank after word k stands at ends[k]
    ends = np.cumsum([len(w.decode()) + 1 for w in words])
    hit, items = np.zeros(len(words) + 1, dtype=np.int64), set()
    for end, (size, of) in found:
        k = int(np.searchsorted(ends, end))
        hit[k - size + 1] += 1
        hit[k + 1] -= 1
        items.update(of)
    at = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
    places = [m.span() for m in _WORD.finditer(text.decode())]
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    return len(words), at.tolist(), sorted(items), [{"first": int(r[0]), "last": int(r[-1]), "start": places[r[0]][0], "end": places[r[-1]][1]} for r in runs]


def finder(items: list[tuple[str, bytes]], size: int):
    @F.arrow_udf(FOUND)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine, kind = automaton_of(items, size), _arrow_type()
        for batch in texts:
            out = []
            for text in batch:
                n, at, of, spans = scan(text.as_py() or b"", machine)
                out.append({"n_words": n, "words": at, "items": of, "spans": spans})
            yield pa.array(out, type=kind)

    return find


def _arrow_type() -> pa.DataType:
    return pa.struct([("n_words", pa.int64()), ("words", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")])))])


def find_benchmark(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, max_chars: int = MAX_CHARS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``items`` and ``spans``.

    ``spans`` are the hit passages in code points of the original, end exclusive, each as long as hit words follow one
    another.  Null texts and items have no words; items that repeat count once by id; null ids are the item "null".
    Repeated rows each get the same result.  Of an empty benchmark nothing is hit; an empty table gives no rows; texts are scanned whole.
    Columns of ``docs`` stay, but for those named above, which are replaced.
    """
    new = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]
    given = [c for c in docs.columns if c not in new]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in given]).alias("_row"), text.cast("binary").alias("_text"))
    items = benchmark.select(F.coalesce(F.col(quoted(item_col)).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(quoted(item_text)), F.lit("")).cast("binary").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // max_chars))
    parts = []
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k) if shards > 1 else items
        parts.append(finder([(r["item"], bytes(r["text"])) for r in own.collect()], size))  # about max_chars of it
    if shards == 1:
        ready = rows.select("_row", parts[0]("_text").alias("f")).select("_row", "f.n_words", "f.words", "f.items", "f.spans")
    else:
        ready = _by_shards(rows, parts)
    return ready.select(
        *[F.col(f"_row.{quoted(c)}").alias(c) for c in given],
        "n_words",
        F.size("words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"),
        "items",
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"),
    )


def _by_shards(rows: DataFrame, parts: list) -> DataFrame:
    """What every shard found in a row's text, together."""
    key = [F.xxhash64("_text").alias("_a"), F.xxhash64(F.lit(1), "_text").alias("_b")]
    found = []
    for find in parts:
        hits = rows.select(*key, find("_text").alias("f")).where(F.size("f.words") > 0)
        found.append(stored(hits.groupBy("_a", "_b").agg(F.first("f").alias("f")).select("_a", "_b", "f.words", "f.items", "f.spans")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = every.groupBy(F.col("_a").alias("_x"), F.col("_b").alias("_y")).agg(flat("words"), flat("items"), flat("spans")).withColumn("spans", _joined_runs(F.col("spans")))
    both = rows.select("_row", *key, F.regexp_count(F.col("_text").cast("string"), F.lit(_WORD.pattern)).cast("long").alias("n_words")).join(merged, (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y")), "left")
    none = lambda c: F.coalesce(c, F.array().cast(merged.schema[c].dataType)).alias(c)
    return both.select("_row", "n_words", none("words"), none("items"), none("spans"))


def _joined_runs(runs: Column) -> Column:
    """Runs in the order of their first words, those that overlap or follow one another as one."""
    last = lambda acc: F.element_at(acc, -1)

    def put(acc: Column, r: Column) -> Column:
        meets = (F.size(acc) > 0) & (r["first"] <= F.try_element_at(acc, F.lit(-1))["last"] + 1)
        one = F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], r["last"]).alias("last"), last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], r["end"]).alias("end"))
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(runs, F.array().cast("array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"), put)


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
