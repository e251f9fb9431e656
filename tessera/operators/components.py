"""Distributed connected components by alternating large and small stars.

Each round joins every node with the smallest of its neighbours; rounds are
written to the shared folder, so lineage stays short and a lost executor costs
one round at most. The number of rounds grows with the logarithm of the longest
path. Hubs are safe: minima combine before the shuffle, and the written minima
let the join split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.shared import discard, materialize


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame, minima: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b: every larger neighbour of a node goes to the node's smallest."""
    made = _both(edges).join(minima, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return made.filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, goes to its smallest."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def components(edges: DataFrame, a: str = "id", b: str = "other") -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the smallest node of the component."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    now = materialize(now, "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        minima = _both(now).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        minima = materialize(minima, "minima")
        last, now = now, materialize(_small(_large(now, minima)), "edges")
        before, state = state, _state(now)
        discard(last, minima)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
