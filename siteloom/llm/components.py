"""Connected components by alternating large-star and small-star steps; every step is a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siteloom.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node it reaches. No edges, no rows."""
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        # Large star: every neighbour above u moves to the least of u's surroundings.
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        wide = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: u and its neighbours below it move to the least of them.
        low = wide.groupBy("a").agg(F.min("b").alias("m"))
        small = wide.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = stage(small.filter("a <> b").distinct())
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
