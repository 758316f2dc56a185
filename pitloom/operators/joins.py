"""Joins that Spark has no operator for, composed of unions, windows and equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, key: str | None, left_time: str, right_time: str, values: list[str], tie: str, span_days: int | None = None) -> DataFrame:
    """left with the values of the latest right row at or before left_time, by key.

    Both sides are shuffled once by the key and sorted by time, right rows
    first; of right rows of one time the largest `tie` wins.  No row is
    compared with a range of others.

    With span_days, each key is also cut into spans of time, so a key that
    holds much of the rows is many tasks; the last right row of a span, one
    for each key and span, is carried to the key's later spans.  Without a
    key, the join runs over the distinct times in spans (30 days if none are
    asked for).  Null times and null keys
    match nothing; left rows that have them stay, with null values.
    """
    if key is None:
        times = asof_join(left.select(left_time).distinct().withColumn("_k", F.lit(0)), right.withColumn("_k", F.lit(0)), "_k", left_time, right_time, values, tie, span_days or 30)
        return left.join(times.drop("_k"), left_time, "left")
    packed = F.struct(*values)
    names = [c for c in left.columns if c not in (key, left_time)]
    a = left.select(F.col(key).alias("_key"), F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType).alias("_values"), F.struct(*names, F.lit(0).alias("_pad")).alias("_left"))
    b = right.where(F.col(right_time).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), packed.alias("_values"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"))
    parts = ["_key", F.when(F.col("_key").isNull(), F.xxhash64("_time"))]  # rows without a key need not meet
    if span_days:
        parts.append("_span")
        a, b = (x.withColumn("_span", F.floor(F.unix_date(F.to_date("_time")) / span_days)) for x in (a, b))
    w = Window.partitionBy(*parts).orderBy("_time", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_values", F.last("_values", ignorenulls=True).over(w)).where("_side = 1")
    if span_days:
        out = _carried(out, a, b)
    return out.select(F.col("_key").alias(key), F.col("_time").alias(left_time), *(F.col(f"_left.`{c}`").alias(c) for c in names), *(F.col(f"_values.`{v}`").alias(v) for v in values))


def _carried(out: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """out, where a row without values takes those of the last right row of its key's earlier spans."""
    ends = b.groupBy("_key", "_span").agg(F.max_by("_values", F.struct("_time", "_tie")).alias("_values"))
    asked = a.where("_span is not null").select("_key", "_span").distinct()
    before = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = asked.withColumn("_asked", F.lit(1)).unionByName(ends, allowMissingColumns=True).groupBy("_key", "_span").agg(F.max("_asked").alias("_asked"), F.first("_values", ignorenulls=True).alias("_values"))
    past = spans.withColumn("_past", F.last("_values", ignorenulls=True).over(before)).where("_asked = 1 and _past is not null").select(F.col("_key").alias("_pk"), F.col("_span").alias("_ps"), "_past")
    joined = out.join(past, (F.col("_key") == F.col("_pk")) & (F.col("_span") == F.col("_ps")), "left")
    return joined.withColumn("_values", F.coalesce("_values", "_past"))


def replace_by_key(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing without the keys of incoming, and incoming."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
