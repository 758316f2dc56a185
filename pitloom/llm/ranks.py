"""Global positions of sorted rows without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import checkpointed


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's position, from 1, in this order, which must be total.

    Rows are dealt to ranges; one count for each range reaches the driver.
    """
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = checkpointed(df.repartitionByRange(width, *order).withColumn("_range", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in sorted((r[0], r[1]) for r in dealt.groupBy("_range").count().collect()):
        offsets += [F.lit(part), F.lit(before)]
        before += n
    offset = F.element_at(F.create_map(*offsets), F.col("_range")) if offsets else F.lit(0)
    return dealt.withColumn(name, (F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + offset).cast("long")).drop("_range")
