"""Connected components over links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import checkpointed


def _least_neighbour(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the least node of the component.

    Each round links the larger neighbours of a node, then its smaller ones, to the least neighbour,
    until the links are stars (Kiveris et al., 2014: O(log^2 n) rounds). A node's least neighbour is
    a pre-aggregated minimum, so a hub is never gathered; every round is checkpointed.
    """
    state, before = checkpointed(links.where("a <> b").select("a", "b").distinct()), None
    while True:
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            state.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = both.join(_least_neighbour(both), "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = _least_neighbour(down)
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
        state = checkpointed(small.where("a <> b").distinct())
        now = state.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38)"))).first()
        if now == before:
            break
        before = now
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        state.select(F.col("a").alias("node"), F.col("a").alias("root"))
    ).distinct()
