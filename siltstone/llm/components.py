"""Connected components by contraction, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the distinct (a, b): nodes of a component have one root, a node of it.

    Each round every node moves to whichever of itself and its neighbours a hash of the round and node
    puts first, so some constant share of nodes goes each time, chains included.  Hubs cost no more:
    minima are taken map-side, and a hub's links are joined by joins that adaptive execution may split.
    Each round's tables are written as Parquet, whose size is known: a checkpoint keeps its plan's estimate,
    which a join makes the product of its sides, and round after round squares.
    """
    edges = stored(links.where("a <> b").select("a", "b"))
    at = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    k = 0
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a"))
        rank = lambda c, k=k: F.xxhash64(F.lit(k), c)
        best = both.groupBy("v").agg(F.min_by("w", rank("w")).alias("w"))
        move = stored(best.select("v", F.when(rank("w") < rank("v"), F.col("w")).otherwise(F.col("v")).alias("to")))
        before = edges, at, move
        at = stored(at.join(move.withColumnRenamed("v", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        one = edges.join(move.select(F.col("v").alias("a"), F.col("to").alias("x")), "a")
        two = one.join(move.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        edges = stored(two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(*before)
        k += 1
    discard(edges)
    return at


def rerooted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more (a, b), of which either may be a node that had no link so far."""
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    named = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
    new = connected(named.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(moved.union(new.join(roots, "node", "left_anti").select("node", "root")))
