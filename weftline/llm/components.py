"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. large: both directions, neighbours above u move to u's least neighbour; else those below do."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 40, most: int | None = None) -> DataFrame:
    """(node, component) for every node of edges (a, b) of longs; component is the least node reachable.

    Each round writes its edges to the shared folder, by at most so many tasks as ``most`` says (see ``common.gathered``). Grouping is pre-aggregated and joins are left to
    adaptive skew handling, so a hub is no single task's work. Rows with equal ends or nulls are ignored;
    no edges give no rows. It raises if rounds don't suffice (their number grows with the logarithm of the size).
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, seen = materialise(now, "edges", most), None
    for _ in range(rounds):
        now = materialise(_star(_star(now, True), False), "stars", most)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = tuple(sums)
    raise RuntimeError(f"components: no fixed point after {rounds} rounds")
