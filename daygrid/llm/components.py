"""Connected components of an edge table by alternating large-star and small-star.

Edges stay in tables written under the shared checkpoint folder, one per
round; only a row count and a checksum of a round reach the driver.  A node
with very many edges is pre-aggregated (its minimum) before it is joined back,
and that join may be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from daygrid.stage import stage

MOST_ROUNDS = 60  # the method needs O(log^2) rounds; this only ends a run gone wrong


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "w")
    low = both.groupBy("u").agg(F.min("w").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("w > u").join(low, "u").select(F.col("w").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w"))
    low = down.groupBy("u").agg(F.min("w").alias("m"))
    moved = down.join(low, "u").where("w <> m").select(F.col("w").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, component): the smallest node reachable.

    Nodes without an edge are not in the result; loops, repeated edges and an
    empty table are fine; edges with a null end are left out.
    """
    current = stage(edges.select("a", "b").where("a <> b").distinct())
    mark = None
    for _ in range(MOST_ROUNDS):
        current = stage(_small_star(_large_star(current)))
        now = current.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == mark:
            return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
                current.select("b", "b").distinct())
        mark = tuple(now)
    raise RuntimeError("Components did not settle.")
