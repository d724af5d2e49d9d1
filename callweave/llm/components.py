"""Connected components of an edge list, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm._frames import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node. ``edges`` has long columns a and b.

    Self-loops, repeated edges and null ends are ignored. Each step groups by node with partial aggregation and joins the minimum back, so no
    neighbour list is ever held in one row. The loop ends when a step leaves the edges as they were; each step is checkpointed.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = checkpointed(e)
    seen = None
    while True:
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("m").alias("a"), F.col("y").alias("b")).where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        e = checkpointed(
            small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m"), F.col("b"))).distinct()
        )
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select(F.col("a"), F.col("a")).distinct())
        seen = state
