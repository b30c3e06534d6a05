"""Jaccard join of documents over word shingles: a blocked sparse product of documents by shingles.

A document's row is its set of five-word shingles.  Copies are one row: sets are told apart by a
128-bit digest.  Which entries of the product can reach ``100 * |x & y| >= 75 * |x | y|`` is bounded
before any tile is multiplied: linked sets share at least k of the first ``|x| - ceil(0.75 |x|) + k``
shingles of each, in any one order of all shingles, and their sizes differ by a third at most.  So only prefixes
are dealt by column, only to rows of a like size, and a row with fewer than k columns that any other row of that size has goes.
Columns that the same rows have are one from there on, with a weight.

Rows that are left are dealt to tiles by families, which are told by the least hashes of their columns and which rows that
are alike mostly have in common; small families share a tile, large ones are cut by a hash.  A task holds one tile, counts
overlaps (``product.merged_parts``) and gives out only which parts became one; pairs are never rows.  Each row is
in two size classes, an even and an odd one: all even tiles are multiplied first, then the odd ones, with other
cuts and without comparing rows that are connected already.  Columns that then still lie in several tiles and
in several components are settled by products of two tiles, the rows outside the column's largest component with the others.
Before each of these passes rows go that have too few columns, by weight, in which a row not connected with them is left.

The order puts frequent shingles last, by their count over the whole table, so that common passages
open no tiles; which shingles count as frequent alters the work, never the result.  A set's least hashes are kept a
little beyond the prefix, so that few texts are read again when frequent shingles leave it.

Scale: shingle counts are summed map-side; columns are joined by sort-merge joins that adaptive execution may
split; whole sets are made only for rows that the bounds leave, and travel once a pass and once for each pair of tiles.  A group
of near copies that link, however large, is connected after the two passes; one whose members
share columns without linking costs the square of its tiles, as any exact product does.  Frequent
shingles, at most ``MAX_FREQUENT``, are the one thing sent to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from .common import bucketed, dealt_anew, discard, quoted, small, stored
from .components import rerooted
from .hashing import pieces, sequence_hashes, word_hashes
from .product import PERCENT, least_of, merged_parts

SHINGLE = 5
#: Count in prefixes from which a shingle goes last; doubled until at most ``MAX_FREQUENT`` do.
FREQUENT, MAX_FREQUENT = 32, 1 << 20
#: One column more than the first for so many shingles must be shared.
PER_COLUMN = 16
#: A head is longer than a prefix by one part in so many, and by so many.
SPARE = 4
#: Shingles of a tile: of one that small groups share, and of one that a large group is cut into.
SHARED_TILE, CUT_TILE = 1 << 19, 1 << 20
#: Least columns of a row by which its family is told.
LOW = 8
#: Size classes are powers of a little over 100 / PERCENT; sizes beyond the last are in one.
SIZE_STEP, LAST_SIZE = 100 / PERCENT + 1e-6, 62

_SIGNED = T.ArrayType(T.LongType())


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a whole text as sorted hashes: A-Z lower-cased words, all of them if fewer than ``size``."""
    s = np.sort(sequence_hashes(word_hashes(text.lower().split()), size))
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def prefix_length(n: int) -> int:
    return n - least_of(n) + 1 + n // PER_COLUMN if n else 0


def _lists(rows: list) -> pa.Array:
    """A list array of signed longs."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate([r.view(np.int64) for r in rows if len(r)] or [np.zeros(0, dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("head", _SIGNED)]))
def _headed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Size and digest of a set, and its least hashes: a prefix and a part more, from which frequent ones may be left out."""
    for batch in pieces(texts):
        sizes, digests, heads = [], [], []
        for t in batch:
            s = shingles(t.as_py())
            p = prefix_length(len(s))
            sizes.append(len(s))
            digests.append(xxh3_128_digest(s.tobytes()))
            heads.append(s[: p + p // SPARE + SPARE].copy())  # a view would keep the whole set
        yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(heads)], ["n", "digest", "head"])


def _found(hashes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``frequent`` hashes are, and which they are."""
    bits = np.uint64((1 << 20) - 1)
    maybe = np.zeros(1 << 20, dtype=bool)  # most hashes are told apart from all frequent ones by their last bits
    maybe[frequent & bits] = True
    near = np.flatnonzero(maybe[hashes & bits])
    at = np.minimum(np.searchsorted(frequent, hashes[near]), len(frequent) - 1)
    hit = frequent[at] == hashes[near] if len(near) else np.zeros(0, dtype=bool)
    return near[hit], at[hit]


def _rare_of(frequent: np.ndarray):
    """The prefix of a set of which head and size are given, or an empty list if its head has too few rare hashes for that."""

    @F.arrow_udf(_SIGNED)
    def rare_of(heads: pa.Array, sizes: pa.Array) -> pa.Array:
        flat = heads.flatten().to_numpy(zero_copy_only=False)
        rare = np.ones(len(flat), dtype=bool)
        rare[_found(flat.view(np.uint64), frequent)[0]] = False
        lengths = pc.list_value_length(heads).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        n = sizes.to_numpy(zero_copy_only=False)
        want = n - least_of(n) + 1 + n // PER_COLUMN
        so_far = np.concatenate(([0], np.cumsum(rare)))
        before = so_far[ends - lengths]
        want[so_far[ends] - before < want] = 0
        kept = rare & (so_far[1:] - np.repeat(before, lengths) <= np.repeat(want, lengths))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(want))), pa.int32()), pa.array(flat[kept]))

    return rare_of


def _prefixed(frequent: np.ndarray, counts: np.ndarray):
    """Digest and prefix of a set, in the order of count where frequent and then of hash."""

    @F.arrow_udf(T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("prefix", _SIGNED)]))
    def first_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pieces(texts):
            sets = [shingles(t.as_py()) for t in batch]
            ends = np.cumsum([len(s) for s in sets])
            near, at = _found(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), frequent)
            digests, prefixes = [], []
            for s, end in zip(sets, ends, strict=True):
                digests.append(xxh3_128_digest(s.tobytes()))
                low, high = np.searchsorted(near, (end - len(s), end))
                rare = np.ones(len(s), dtype=bool)
                rare[near[low:high] - (end - len(s))] = False
                last = s[~rare][np.argsort(counts[at[low:high]], kind="stable")]
                prefixes.append(np.concatenate([s[rare], last])[: prefix_length(len(s))].copy())
            yield pa.StructArray.from_arrays([pa.array(digests, pa.binary()), _lists(prefixes)], ["digest", "prefix"])

    return first_of


@F.arrow_udf(T.BinaryType())
def _whole(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pieces(texts):
        yield pa.array([shingles(t.as_py()).tobytes() for t in batch], pa.binary())


def _moves(tile: pa.Table) -> pa.Table:
    """(a, b) of rows (root, set, asked): root ``a`` is connected with the smaller root ``b`` by a link in this tile."""
    roots, root = np.unique(tile["root"].to_numpy(), return_inverse=True)
    after = merged_parts([np.frombuffer(s.as_py(), dtype=np.uint64) for s in tile["set"]], root, tile["asked"].to_numpy(zero_copy_only=False))
    a, b = np.unique(np.stack([root, after])[:, root != after], axis=1)
    return pa.table({"a": roots[a], "b": roots[b]})


def internal_id(id_: Column, text: Column) -> Column:
    """The id, or for a null one a number far below all others, the same for the same text."""
    return F.coalesce(id_.cast("long"), F.lit(-(1 << 62)) - F.pmod(F.xxhash64(text), F.lit(1 << 61)))


def _frequent(heads: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are often in prefixes, and how often: ``MAX_FREQUENT`` at most."""
    least = F.ceil(F.col("n") * PERCENT / 100)
    prefix = F.slice("head", F.lit(1), (F.col("n") - least + 1 + F.floor(F.col("n") / PER_COLUMN)).cast("int"))
    counted = heads.select(F.explode(prefix).alias("h")).groupBy("h").agg(F.count("*").alias("k"))
    most = FREQUENT
    often = stored(counted.where(F.col("k") > most))
    while not small(often.where(F.col("k") > most), MAX_FREQUENT):
        most *= 2
    found = often.where(F.col("k") > most).toArrow()
    discard(often)
    hashes, counts = found["h"].to_numpy().view(np.uint64), found["k"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _of_several(rows: DataFrame, *values: str) -> DataFrame:
    """The rows whose column ``g`` has more than one of each of ``values``."""
    ends = [f(v).alias(f"_{name}_{v}") for v in values for name, f in (("least", F.min), ("most", F.max))]
    several = rows.groupBy("g").agg(*ends).where(" and ".join(f"_least_{v} < _most_{v}" for v in values))
    return rows.withColumn("_key", dealt_anew(F.col("g"))).join(several.select(dealt_anew(F.col("g")).alias("_key")).hint("shuffle_hash"), "_key", "left_semi").drop("_key")


def _linkable(units: DataFrame, *values: str) -> DataFrame:
    """``units`` (c, slot, n, g, w, ...) without rows that link with none of which all ``values`` are others.

    Such a pair would share the columns that linked rows share at least, and each of these would have several ``values``.
    """
    several = stored(_of_several(units, *values))
    needed = F.floor(F.ceil(F.min("n") * PERCENT / 100) / PER_COLUMN) + 1
    enough = several.groupBy("c", "slot").agg(F.sum("w").alias("k"), needed.alias("needed")).where("k >= needed").select("c", "slot")
    left = stored(_of_several(several.join(enough, ["c", "slot"]), *values))
    discard(several)
    return left


def _prefixes(heads: DataFrame, own: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> list[DataFrame]:
    """(c, n, prefix) of all sets in two stored parts; texts are read again only where a head has too many frequent shingles."""
    prefixes = stored(heads.select("digest", "c", "n", _rare_of(frequent[0])("head", "n").alias("prefix")))
    lacking = prefixes.where(F.size("prefix") == 0).select("digest", "c", "n")
    # stored before it is joined: a join would filter by the digest, for which all would be computed once more
    again = stored(own.join(lacking.select("c").distinct(), "c", "left_semi").select(_prefixed(*frequent)("_text").alias("s")).groupBy("s.digest").agg(F.first("s.prefix").alias("prefix")))
    rest = stored(lacking.join(again, "digest").select("c", "n", "prefix"))
    discard(again)
    return [prefixes.select("c", "n", "prefix"), rest]


def _columns(prefixes: DataFrame) -> DataFrame:
    """(c, slot, n, g, w): rows and the columns, each of one size class, in which others may link with them.

    Columns that the same rows have are one, ``g``, which counts as ``w``: near copies share most of theirs, and
    columns that are taken for one although they aren't only add to what is compared.
    """
    rows = prefixes.select("c", "n", F.explode("prefix").alias("h"))
    alike = F.xxhash64(F.min("c"), F.max("c"), F.bit_xor(F.xxhash64("c")))
    # one row a column, so that its side can be hashed and the long one need not be sorted
    met = rows.groupBy("h").agg(F.min("c").alias("least"), F.max("c").alias("most"), alike.alias("g")).where("least < most").select(dealt_anew(F.col("h")).alias("_key"), "g").hint("shuffle_hash")
    shared = stored(rows.select("c", "n", dealt_anew(F.col("h")).alias("_key")).join(met, "_key").groupBy("c", "n", "g").agg(F.count("*").alias("w")))
    size = F.least(F.floor(F.log(F.col("n")) / F.log(F.lit(SIZE_STEP))), F.lit(LAST_SIZE)).cast("int")
    sized = shared.withColumn("slot", F.explode(F.array(size, size + 1)))
    left = _linkable(sized.select("c", "slot", "n", F.xxhash64("g", "slot").alias("g"), "w"), "c")
    discard(shared)
    return left


def _tiled(units: DataFrame, salt: int) -> DataFrame:
    """(c, slot, family, tile) of ``units`` (c, slot, n, g, w): families are kept together.

    A row's family is the least mark of any row that it shares one of its ``LOW`` least columns with, its own mark
    being its least column.  A column that stands for ``w`` has the least of so many hashes.  A family too large for a tile is cut.
    """
    share = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "g"), 11) / F.lit(float(1 << 53))
    least_of_w = (-F.log1p(-share) / F.col("w") * float(1 << 57)).cast("long")
    low = F.slice(F.array_sort(F.collect_list(least_of_w)), 1, LOW)
    marked = stored(units.groupBy("c", "slot").agg(F.max("n").alias("n"), low.alias("low")))
    shared = marked.select("c", "slot", F.get("low", F.lit(0)).alias("m"), F.explode("low").alias("h"))
    least = shared.groupBy("h").agg(F.min("m").alias("m")).select(dealt_anew(F.col("h")).alias("_h"), "m")
    family = shared.select("c", "slot", dealt_anew(F.col("h")).alias("_h")).join(least, "_h").groupBy("c", "slot").agg(F.min("m").alias("m"))
    each = stored(family.join(marked.select("c", "slot", "n"), ["c", "slot"]))
    discard(marked)
    tiles = max(1, -(-(each.agg(F.sum("n")).first()[0] or 0) // SHARED_TILE))
    large = each.groupBy("m").agg(F.sum("n").alias("w")).where(F.col("w") > SHARED_TILE).select(dealt_anew(F.col("m")).alias("_m"), F.ceil(F.col("w") / CUT_TILE).alias("cuts"))
    cut_by = F.when(F.col("cuts").isNotNull(), F.xxhash64("m", F.pmod(F.xxhash64(F.lit(salt), "c"), F.col("cuts"))))
    tile = F.coalesce(cut_by, F.pmod(F.xxhash64(F.lit(1), "m"), F.lit(tiles)))
    return stored(each.withColumn("_m", dealt_anew(F.col("m"))).join(large, "_m", "left").select("c", "slot", F.coalesce(cut_by, "m").alias("family"), tile.alias("tile")))


def _multiplied(dealt: DataFrame, sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(a, b): roots that links in the tiles connect; ``dealt`` is (c, tile, asked)."""
    at = dealt.join(sets, "c")
    at = at.withColumn("root", F.col("c")) if roots is None else at.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    return stored(at.select("tile", "root", "set", "asked").groupBy("tile").applyInArrow(lambda t: _moves(t), "a long, b long"))


def _rooted(units: DataFrame, roots: DataFrame) -> DataFrame:
    return units.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))


def _after(roots: DataFrame, moves: DataFrame) -> DataFrame:
    return roots if moves.isEmpty() else rerooted(roots, moves.distinct())


def _across(units: DataFrame, tiles: DataFrame, roots: DataFrame) -> DataFrame:
    """(c, tile, asked): rows of the pairs of tiles that the columns in several tiles and components need.

    Small pairs share a tile of their own, in which a row that several of them need is once.
    """
    apart = _linkable(_rooted(units, roots), "root")
    open_ = _linkable(apart.join(tiles, ["c", "slot"]), "tile", "root")
    discard(apart)
    parts = open_.groupBy("g", "root").agg(F.count("*").alias("k"))
    main = parts.groupBy("g").agg(F.max_by("root", F.struct("k", "root")).alias("main")).select(dealt_anew(F.col("g")).alias("_g"), "main")
    asked = stored(open_.withColumn("_g", dealt_anew(F.col("g"))).join(main, "_g").select("c", "n", "g", "family", "tile", (F.col("root") != F.col("main")).alias("asked")))
    # a column's families meet its tiles, so that no row is there once for each column and tile
    families = stored(asked.groupBy("g", "family", "tile").agg(F.max("asked").alias("asks")))
    others = families.groupBy("g", F.col("tile").alias("other")).agg(F.max("asks").alias("other_asks"))
    met = families.join(others, "g").where((F.col("tile") != F.col("other")) & (F.col("asks") | F.col("other_asks")))
    ways = met.select(F.col("family").alias("_f"), "tile", F.xxhash64(F.least("tile", "other"), F.greatest("tile", "other")).alias("pair")).distinct()
    rows = asked.groupBy("c", "family", "tile").agg(F.max("asked").alias("asked"), F.max("n").alias("n"))
    sent = stored(rows.withColumn("_f", F.col("family")).join(ways, ["_f", "tile"]).groupBy("c", "pair").agg(F.max("asked").alias("asked"), F.max("n").alias("n")))
    discard(families)
    tasks = max(1, -(-(sent.agg(F.sum("n")).first()[0] or 0) // SHARED_TILE))
    out = stored(sent.groupBy("c", F.pmod("pair", F.lit(tasks)).alias("tile")).agg(F.max("asked").alias("asked")))
    discard(open_, asked, sent)
    return out


def _roots(columns: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of rows that link with any other."""
    tiles = []
    roots = None
    for odd in (0, 1):
        units = columns.where(F.pmod("slot", F.lit(2)) == odd)
        if roots is not None:
            units = _linkable(_rooted(units, roots), "root").drop("root")
        tiles.append(_tiled(units, odd))
        if roots is not None:
            discard(units)
        moves = _multiplied(tiles[-1].select("c", "tile", F.lit(True).alias("asked")), sets, roots)
        # in the first pass a row is in one tile, so what its tile says is final
        roots = _after(roots, moves) if roots is not None else stored(moves.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(moves.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    across = _across(columns, tiles[0].unionByName(tiles[1]), roots)
    roots = roots if across.isEmpty() else _after(roots, _multiplied(across, sets, roots))
    discard(across, *tiles)
    return roots


def group_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; ids are whole numbers.

    ``component_id`` is the smallest id reachable over links, the row's own included.  Texts that are
    null or without words have no shingles and link with nothing.  Rows that share an id are one document: what they
    link with is one component.  A component without any id has null; rows without an id are told apart by text.
    Repeated rows each get the same result.  Texts may be of any length.  An empty table gives no rows.  No other
    column is read, so none can clash.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    own = docs.select(F.col(quoted(id_col)).alias("_id"), internal_id(F.col(quoted(id_col)), text).alias("c"), text.cast("binary").alias("_text"))
    by_hash = stored(own.select("_id", "c", _headed("_text").alias("s")).select("_id", "c", "s.*"))
    heads = stored(by_hash.where("n > 0").groupBy("digest").agg(F.min("c").alias("c"), F.min("_id").alias("least"), F.first("n").alias("n"), F.first("head").alias("head")))
    made = stored(by_hash.drop("head"))
    discard(by_hash)
    classes = stored(heads.drop("head"))
    prefixes = _prefixes(heads, own, _frequent(heads))
    discard(heads)
    columns = _columns(prefixes[0].unionByName(prefixes[1]))
    discard(*prefixes)
    wanted = columns.select("c").distinct()
    texts = own.join(wanted, "c", "left_semi").groupBy("c", F.xxhash64("_text").alias("_key")).agg(F.first("_text").alias("_text"))
    sets, listed = bucketed(texts.select("c", _whole("_text").alias("set")), "c")
    try:
        roots = _roots(columns, sets)
    finally:
        discard(columns, sets)
        sets.sparkSession.sql(f"DROP TABLE IF EXISTS {listed}")
    # an id with several texts: copies of one may be a class by another id
    same = made.where("n > 0").join(classes.select("digest", F.col("c").alias("a")), "digest").where("a <> c").select("a", F.col("c").alias("b")).distinct()
    same = stored(same.join(classes.select(F.col("c").alias("b")), "b", "left_semi").select("a", "b"))
    roots = _after(roots, same)

    rooted = classes.select("digest", "c", "least").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("digest", "component_id")
    return made.join(named, "digest", "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
