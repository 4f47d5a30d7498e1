"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm import common


def _are_stars(links: DataFrame) -> bool:
    """Whether each node with a smaller neighbour has only one, and that one has no smaller neighbour itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    degrees = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not degrees.agg(F.max((F.col("down") + F.col("up") > 1) & (F.col("down") > 0))).first()[0]


def _lowest(links: DataFrame) -> DataFrame:
    """(u, m): each node's least neighbour; written, so that its size is known and a hub's links can be split in the join."""
    return common.materialise(links.groupBy("u").agg(F.min("v").alias("m")), "lowest")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another; component is the smallest node reachable.

    Rounds grow with the logarithm of the longest chain. Each round's edges, never more than one star per node and
    neighbour, are written to the shared folder; only whether they are stars reaches the driver.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    links = common.materialise(links, "edges")
    while not _are_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = _lowest(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.materialise(large, "edges")
        lowest = _lowest(large)
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = common.materialise(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
