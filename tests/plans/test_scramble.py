"""A scramble of what comes later, over a panel whose last digits no two runs share."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitloom.plans.cleaning import moved_before


def test_scramble_of_values_that_no_two_runs_share(spark):
    """Only the scramble moves rows, not a second computation of the panel."""
    noise = F.udf(lambda: 1 + random.random() * 1e-9, "double").asNondeterministic()
    bars = spark.range(40).select(F.lit("a").alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") * noise()).alias("close"))
    past, ahead = (Window.partitionBy("ticker").orderBy("date").rowsBetween(*w) for w in ((-3, 0), (0, 1)))
    for w, moved in ((past, 0), (ahead, 1)):
        got = moved_before(lambda x: x.withColumn("f", F.avg("close").over(w)), bars, "2020-01-20", "close", "f").first()
        assert (got.n, got.moved) == (20, moved)
