"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _hang(edges: DataFrame, node: str, other: str) -> DataFrame:
    """(node, other, low): low is the smallest of a node and its others."""
    low = edges.groupBy(node).agg(F.min(other).alias("low"))
    return edges.join(low.select(node, F.least(node, "low").alias("low")), node)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest
    node that can be reached. Edges with a null end and loops are ignored.

    Each round hangs the larger neighbours of every node on its smallest
    neighbour, then every node's smaller neighbours and itself on the
    smallest; it ends when nothing changes. Smallest neighbours come from a
    grouped minimum (combined before the shuffle), and a join, which Spark
    splits when skewed, brings them to the edges: no group of neighbours
    ever has to fit in one task. Rounds are cut by tables in the shared
    checkpoint folder."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = stored(now, "edges")
    before, after = None, _signature(now)
    while after != before:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _hang(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        hung = _hang(large, "a", "b")
        small = hung.select(F.col("b").alias("a"), F.col("low").alias("b")).union(hung.select("a", F.col("low").alias("b")))
        last, now = now, stored(small.where("a <> b").distinct(), "edges")
        discard(last)
        before, after = after, _signature(now)
    # Now every node other than a component's smallest has one edge, to that one.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
