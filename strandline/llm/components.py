"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import shared_table


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
    return r["n"], r["s"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes but the smallest of each component, from edges (a, b); component is the smallest node reachable.

    Every round writes its edges to the shared folder, and only their count and a checksum reach the driver. The number of
    rounds grows with the logarithm of the longest chain.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = shared_table(e)
    before = _mark(e)
    while before[0]:
        # large star: neighbours above a node move to the least of its neighbours and itself
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: what a node is joined to below it moves to the least of that
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = shared_table(small)
        after = _mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
