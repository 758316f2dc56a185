"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed, forget


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("_m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Only minima are gathered for a node, never its neighbours, so a hub costs
    no more than its edges.  No edges give an empty table.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).withColumn("_m", F.least("_m", "u"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).where("u <> v").distinct()
        low = _lowest(large)
        small = large.join(low, "u").select("v", "_m", "u")
        last, e = e, checkpointed(small.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(small.select("u", F.col("_m").alias("v"))).where("u <> v").distinct())
        forget(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
