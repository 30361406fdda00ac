"""Connected components of a table of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of the links (a, b); nodes have the same root exactly if links connect them.

    Each round maps a node to the smallest of itself and its neighbours, in the order of a hash, and contracts the links; a constant
    part of the nodes goes in each round, also along chains. The rounds' maps are then composed.
    """
    edges = stage(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), c).alias("h"), F.col(c).alias("n"))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = stage(nearest.select(F.col("a").alias("node"), F.least(order("a"), F.col("m"))["n"].alias("root")), "step")
        maps.append(step)
        left = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        after = stage(left.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "edges")
        unstage(edges)
        edges = after
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    unstage(edges)
    # From the last and smallest, so that each is written once more at its own size.
    out = maps.pop()
    while maps:
        step = maps.pop()
        names = out.select(F.col("node").alias("root"), F.col("root").alias("_r"))
        composed = stage(step.join(names, "root", "left").select("node", F.coalesce("_r", "root").alias("root")), "map")
        unstage(step, out)
        out = composed
    return out
