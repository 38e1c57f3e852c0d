"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is a grouped minimum (combined before the shuffle) and an equi-join that AQE may split for hot nodes; rounds
are written to the shared scratch folder. No edge or node reaches the driver: only whether the rounds may end does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node points to one node, and that points to none: then each component is a star around its least node."""
    twice = edges.groupBy("a").count().filter("count > 1").select("a")
    chained = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select("a")
    return twice.union(chained).isEmpty()


def components(edges: DataFrame, scratch: Scratch, label: str = "edges", rounds: int = 60) -> DataFrame:
    """edges: a, b of one orderable type, in either direction, repeated or not. Returns node, component for all nodes but the
    least of every component (their own component); an empty edge table gives an empty result."""
    a, b = F.col("a"), F.col("b")
    edges = scratch.save(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), f"{label}-0")
    for k in range(1, rounds + 1):
        if _is_settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = scratch.save(_small_star(_large_star(edges)), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
