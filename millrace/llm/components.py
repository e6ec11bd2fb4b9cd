"""Connected components over a table of edges, by alternating large-star and small-star steps.

A large-star step links the larger neighbours of each node to its smallest one, a small-star step the
smaller ones and the node itself, until every node hangs on the smallest node of its component. Each
step is a grouped minimum (summed before the shuffle) and a join, so no neighbour list is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import discard, materialize

MOST_ROUNDS = 60


def _down(edges: DataFrame) -> DataFrame:
    """Edges as (a, b) with a > b."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root for every node of an edge (a, b): root is the smallest node of its component.

    A large-star step makes at most one edge of each, so only what a small-star step leaves is made distinct.
    Edges that are stars already settle in one round.
    """
    now = materialize(_down(edges.select("a", "b")).distinct(), name)
    before = _state(now)
    for _ in range(MOST_ROUNDS):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, large = now, materialize(_down(large), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = materialize(_down(small).distinct(), name)
        discard(old, large)
        state = _state(now)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
