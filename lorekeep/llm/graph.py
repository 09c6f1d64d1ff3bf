"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import cut


def _smallest(edges: DataFrame) -> DataFrame:
    # Written and read again, so that the join with it shuffles both sides and a hub's rows can be split.
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour that has none itself."""
    below, above = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")), edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    return below.unionByName(above).groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of ``links`` (columns a, b).

    Alternates large-star and small-star steps until only stars around smallest nodes are left; every
    step is a grouped minimum and a join.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = _smallest(both)
        large = both.join(centre, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        centre = _smallest(large)
        small = large.join(centre, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(centre.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
