"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm import common as C

#: A node with more links is a hub; there are at most so many hubs (the number that makes one grows with the links).
HUB, HUBS = 65_536, 500_000


def _beside(links: DataFrame, low: DataFrame, n_links: int) -> DataFrame:
    """links (u, v) with the row of low (node, degree, low) of their u. The links of hubs stay where they are and meet a
    broadcast of the hubs, so no task holds all links of a node."""
    limit = max(HUB, 2 * n_links // HUBS)
    if 2 * n_links <= limit:  # then no node is a hub
        return links.join(low, F.col("u") == F.col("node"))
    hubs = C.materialise(low.where(F.col("degree") > limit), "hubs")
    if hubs.isEmpty():
        return links.join(low, F.col("u") == F.col("node"))
    rest = links.join(F.broadcast(hubs.select(F.col("node").alias("hub"))), F.col("u") == F.col("hub"), "left_anti").join(low.where(F.col("degree") <= limit), F.col("u") == F.col("node"))
    return rest.unionByName(links.join(F.broadcast(hubs), F.col("u") == F.col("node")))


def _lowest(edges: DataFrame) -> DataFrame:
    """node, degree, low: the smaller of a node and its smallest neighbour (partial minima are made before the shuffle)."""
    return edges.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("degree")).select(F.col("u").alias("node"), "degree", F.least("u", "low").alias("low"))


def _is_done(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none itself: then the links are stars around their roots."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return roles.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down > 0 AND up > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of links (columns u, v); links are never collected.
    The number of rounds grows with the logarithm of the number of nodes. The tables of earlier rounds are deleted."""
    edges = C.materialise(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_done(edges):
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every greater neighbour is linked to the lowest one.
        near = _beside(both, _lowest(both), 2 * n)
        kept = near.where("v < u").select("u", F.col("low").alias("v"))
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        stars = C.materialise(large.unionByName(kept).where("u <> v").distinct(), "edges")
        # Small star: a node and its smaller neighbours are linked to the lowest of them.
        near = _beside(stars, _lowest(stars), stars.count())
        near = near.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(near.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        after = C.materialise(near, "edges")
        C.discard(edges, stars)
        edges = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
