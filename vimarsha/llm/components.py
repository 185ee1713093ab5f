"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _least_neighbour(links: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours. The sums are partial before the shuffle."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no centre is a leaf, and a leaf has one centre."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(
        edges.select(F.col("v"), F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).filter(
        "leaf + centre > 1").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component's name is its least node.

    Alternates large-star and small-star steps until each node points at its component's least node: the
    rounds grow with the logarithm of a component's size. A round's links are written to the shared folder,
    so neither lineage nor the driver grows; loops and repeated links do no harm.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        # large-star: every larger neighbour of u is tied to the least node around u
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").filter("v > u and v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours are tied to the least of them
        small = large.join(_least_neighbour(large), "u")
        edges = saved(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))).distinct(), "stars")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
