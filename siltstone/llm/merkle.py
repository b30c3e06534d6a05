"""A Merkle manifest of a dataset: a leaf for each row, a subroot for each group, one root, and a proof for each leaf.

``H`` is the lower-case hexadecimal SHA-256 of its inputs one after the other, digests as their hexadecimal text.  Every
``ARITY`` consecutive nodes become the ``H`` of them, level by level, until one is left; a lone node is left as it is.

Scale: leaves are narrow rows, made in the one scan that reads texts.  They are sorted by ranges over the whole cluster,
identical rows apart by their place, and numbered by their place in a partition plus the counts of the partitions before; no group is
in one task.  ``ARITY ** LEVELS`` leaves in a row are one block, an ordered array that higher-order functions collapse; the roots of
blocks are nodes again, a ``ARITY ** LEVELS``-th of the rows, until each group has one.  On the way down each block gets the path above
it, and each leaf its own part from its block's levels.  What is gathered in a row is bounded by the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, quoted, stored

ARITY = 8
#: Levels that one block collapses.
LEVELS = 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, fields: tuple[str, ...], key: str, group: str, found: dict[str, Column]) -> DataFrame:
    """(_g, _key, _leaf, _found): a row each, null groups first; ``_found`` is the leaf of the fields as ``found`` has them."""
    own = {f: F.col(quoted(f)) for f in fields}
    label = F.col(quoted(group)).cast("string")
    seen = digest(*[encoded(c) for c in (own | found).values()]) if found else F.lit(None).cast("string")
    return docs.select(F.when(label.isNull(), "").otherwise(F.concat(F.lit("="), label)).alias("_g"), F.col(quoted(key)).alias("_key"), digest(*[encoded(c) for c in own.values()]).alias("_leaf"), seen.alias("_found"))


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with ``_pos``, the place in the group ``_g`` by ``order``, from 0, and ``_n``, the group's rows; and the stored frames behind it."""
    keys = ["_g", *order]
    ranged = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    group = W.partitionBy("_g")
    spans = (
        ranged.groupBy("_g", part.alias("_part"))
        .agg(F.min("_at").alias("_low"), F.count("*").alias("_count"))
        .select("_g", "_part", (F.coalesce(F.sum("_count").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_count").over(group).alias("_n"))
    )
    spans = stored(spans)  # a row for each partition and each group; read from there, Spark knows its size
    out = ranged.withColumn("_part", part).join(spans, ["_g", "_part"]).withColumn("_pos", F.col("_at") + F.col("_shift"))
    return out.drop("_at", "_part", "_shift"), [ranged, spans]


def blocks(nodes: DataFrame) -> DataFrame:
    """(_g, _b, _n, _nodes, _levels, _root): ``BLOCK`` nodes in a row each, with the levels over them, the last of one node."""
    rows = nodes.groupBy("_g", F.floor(F.col("_pos") / BLOCK).alias("_b")).agg(F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("_pos", "_digest", "_load"))).alias("_nodes"))
    height = sum((F.when(F.col("_n") > ARITY**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))

    def above(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
        return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(level, i * ARITY + 1, ARITY), ""), 256))

    ground = F.array(F.transform("_nodes", lambda x: x["_digest"]))
    steps = F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), 1, height)
    levels = F.aggregate(steps, ground, lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))
    return rows.withColumn("_levels", levels).withColumn("_root", F.element_at(F.element_at("_levels", -1), 1))


def siblings(place: Column) -> Column:
    """(before, after) at each level of a block, for the node at a place: the run's other digests, joined."""

    def at(k: Column) -> Column:
        level, i = F.element_at("_levels", k + 1), F.floor(place / F.pow(F.lit(ARITY), k)).cast("int")
        within = i % ARITY
        return F.struct(
            F.array_join(F.slice(level, i - within + 1, within), "").alias("before"),
            F.array_join(F.slice(level, i + 2, ARITY - 1 - within), "").alias("after"),
        )

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), 1, F.size("_levels") - 1), at)


def climbed(ground: DataFrame, most: int) -> list[DataFrame]:
    """Blocks, blocks of their roots, and so on, up to one block for each group; ``most`` is the largest group's number of nodes."""
    out = [ground]
    while most > BLOCK:
        most = -(-most // BLOCK)
        nodes = out[-1].select("_g", F.col("_b").alias("_pos"), F.ceil(F.col("_n") / BLOCK).alias("_n"), F.col("_root").alias("_digest"), F.lit(0).alias("_load"))
        out.append(blocks(nodes))
    return out


def descended(tree: list[DataFrame], top: DataFrame) -> DataFrame:
    """(_g, _load, _digest, _path, and what ``top`` carries) for each node of the ground; ``top`` is (_g, _path, ...)."""
    carried = [c for c in top.columns if c not in ("_g", "_path")]
    above = top.withColumn("_b", F.lit(0).cast("long"))
    for level in reversed(tree):
        opened = level.join(above, ["_g", "_b"]).select("_g", *carried, F.explode(F.transform("_nodes", lambda x, i: F.struct(x["_pos"].alias("_b"), x["_digest"].alias("_digest"), x["_load"].alias("_load"), F.concat(siblings(i), F.col("_path")).alias("_path")))).alias("_x"))
        above = opened.select("_g", *carried, "_x.*")
    return above.drop("_b")


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", found: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, subroot, root, path, folded_root, verified) for each row of ``docs``.

    A leaf is ``H`` of the fields, so one of any length of text has one digest.  In a group leaves ascend by key, null first, and rows of one key by
    leaf; subroots ascend by group, null first, bytewise.  ``path`` has (before, after) for each level up to the root, what stands left
    and right of the node in its run; ``folded_root`` is made from it and the leaf of the fields as ``found`` (by name) has them, the
    leaf itself where that is null, and ``verified`` is whether it is the root.  Rows that repeat are leaves of their own, alike.
    An empty table gives no rows.  Only the columns named are read, so no other can clash.
    """
    made = stored(leaves(docs, fields, key, group, found or {}).withColumn("_spread", F.monotonically_increasing_id()))
    rows, behind = numbered(made, ["_key", "_leaf", "_found", "_spread"])
    ground = stored(blocks(rows.select("_g", "_pos", "_n", F.col("_leaf").alias("_digest"), F.struct("_key", "_found").alias("_load"))))
    discard(made, *behind)
    tree = climbed(ground, ground.agg(F.max("_n")).first()[0] or 0)
    groups = stored(tree[-1].select("_g", "_root"))
    named, behind = numbered(groups.select(F.lit("").alias("_g"), F.col("_g").alias("_group"), F.col("_root").alias("_digest")), ["_group"])
    crown = stored(blocks(named.select("_g", "_pos", "_n", "_digest", F.col("_group").alias("_load"))))
    discard(groups, *behind)
    over = climbed(crown, crown.agg(F.max("_n")).first()[0] or 0)
    start = over[-1].select("_g", F.lit(None).cast("array<struct<before:string,after:string>>").alias("_path"), F.col("_root").alias("_whole"))
    subroots = descended(over, start.withColumn("_path", F.coalesce("_path", F.array().cast("array<struct<before:string,after:string>>"))))
    top = subroots.select(F.col("_load").alias("_g"), "_path", F.col("_digest").alias("_subroot"), "_whole")
    done = descended(tree, top).withColumn("_seen", F.coalesce("_load._found", "_digest"))
    folded = F.aggregate("_path", F.col("_seen"), lambda node, level: digest(level["before"], node, level["after"]))
    out = done.select(F.col("_load._key").alias(key), F.col("_digest").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_whole").alias("root"), F.col("_path").alias("path"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_sha256(path: Column) -> Column:
    """``H`` of all siblings of a path, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), ""), 256)
