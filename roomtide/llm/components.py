"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomtide.sources.scratch import stored


def connected_components(links: DataFrame) -> DataFrame:
    """`node`, `root` for every node of `links` (`a`, `b`, longs): root is the smallest node
    reachable. Alternating large and small stars: every round joins each node's neighbours to the
    smallest of them, so paths shrink by a constant factor and the number of rounds grows with the
    logarithm of the longest one. Rounds are written to the shared folder; the driver sees two
    numbers a round. Loops and nulls are dropped; no links give no rows."""
    edges = stored(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = _state(edges)
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of node and neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return (
        both.join(smallest, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").where("v != m")
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(smallest.select("u", F.col("m").alias("v")))
        .distinct()
    )
