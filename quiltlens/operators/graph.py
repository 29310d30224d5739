"""Connected components over edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quiltlens.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` → ``(node, root)`` with the smallest node of each component as root.

    Alternating star steps (large star, small star): the number of rounds grows with the
    logarithm of the longest chain, and neighbours are only ever reduced to their minimum,
    so a hub never gathers its neighbour list in one task. Every round is written to the
    shared folder, which cuts lineage and survives lost executors.
    """
    current = materialize(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    marks = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = materialize(large.distinct(), "large-star")
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        current = materialize(small.filter("u <> v").distinct(), "small-star")
        now = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if marks == (now["n"], now["h"]):
            roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        marks = (now["n"], now["h"])
