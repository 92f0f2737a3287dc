"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Each round links the larger neighbours of a node to its smallest one, then a node's smaller ones to
    the smallest; the number of rounds grows with the logarithm of the longest path. Only minima are
    aggregated (with map-side partial minima), so no neighbourhood is gathered in one place. A round is
    a written table: a lost executor costs the round at most. Nodes without a link, loops and null ends
    give no row; repeated and reversed links count once.
    """
    links = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    links = materialise(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "links")
    seen = _signature(links)
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = materialise(large.distinct(), "large-star")
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(smallest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        small = moved.unionByName(smallest.select("hi", F.col("m").alias("lo"))).distinct()
        links = materialise(small, "small-star")
        now = _signature(links)
        if now == seen:
            nodes = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
            roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            return nodes.unionByName(roots)
        seen = now


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
