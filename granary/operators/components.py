"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.plans.lineage import keep, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction.  Large: neighbours above a node move to its least neighbour; small: those below do."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # The least neighbour by partial aggregation and a join, so that a hub is never gathered in one task.
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.filter("a <> m").select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type -> (node, component): the least node that each reaches.

    Nulls in either column and loops are ignored; nodes without an edge don't appear.  Rounds
    go on until nothing changes; their number grows with the logarithm of the longest path.
    """
    now = keep(edges.filter("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        last, now = now, keep(_star(_star(now, True), False))
        release(last)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = new
