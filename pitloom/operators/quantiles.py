"""Exact quantiles by group; one task puts in order a small share (0.4 % a quantile) of its largest group's values, not all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Distance in rank, as a share of the group, of the brackets around a quantile; the sketch errs by an eighth of it.
SLACK = 0.002
ACCURACY = 4000


def _met(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of both sides that agree in the keys, null with null."""
    other = right.withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
    names = [f"_right_{i}" for i in range(len(keys))]
    on = F.lit(True)
    for k, n in zip(keys, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(other, on).drop(*names)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: Sequence[float], name: str = "q") -> DataFrame:
    """keys with an array of the quantiles of value, interpolated between neighbours; null and NaN don't count, a group without values is left out.

    A mergeable sketch brackets each quantile.  One aggregate counts the rows
    before the bracket and keeps the values next to it; only the bracket's
    distinct values, some 0.4 % of the group, are counted and put in order.  A
    place that the bracket misses, which the sketch's error doesn't allow,
    ends the job.  Infinite values count: between one and a finite neighbour
    lies the infinite one, between both infinite ones NaN.
    """
    keys = list(keys) or ["_all"]
    v = df.withColumn("_all", F.lit(0)).select(*keys, value.cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    ends = [e for p in probs for e in (max(p - SLACK, 0.0), min(p + SLACK, 1.0))]
    bounds = v.groupBy(*keys).agg(F.percentile_approx("_v", ends, ACCURACY).alias("_b"))
    j = _met(v, bounds, keys)
    x, low, high = F.col("_v"), lambda i: F.col("_b")[2 * i], lambda i: F.col("_b")[2 * i + 1]
    each = range(len(probs))
    sums = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.struct(
        F.lit(i).alias("i"), F.lit(float(p)).alias("p"), F.count_if(x < low(i)).alias("below"), F.max(F.when(x < low(i), x)).alias("before"), F.min(F.when(x > high(i), x)).alias("after"),
    ).alias(f"_s{i}") for i, p in enumerate(probs)))
    sums = sums.select(*keys, "_n", F.explode(F.array(*(F.col(f"_s{i}") for i in each))).alias("s")).select(*keys, "_n", "s.*")
    inside = F.array_compact(F.array(*(F.when((x >= low(i)) & (x <= high(i)), F.lit(i)) for i in each)))
    counts = j.select(*keys, "_v", F.explode(inside).alias("i")).groupBy(*keys, "i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "i").orderBy("_v")))
    m = _met(sums, upto, [*keys, "i"]).select(*keys, "i", "_n", "p", "below", "before", "after", "_v", (F.col("below") + F.col("_upto") - F.col("_c")).alias("first"), (F.col("below") + F.col("_upto")).alias("end"))
    place = F.col("p") * (F.col("_n") - 1)
    at = lambda k: F.coalesce(F.max(F.when((F.col("first") <= k) & (k < F.col("end")), F.col("_v"))), F.max(F.when(k < F.col("below"), F.col("before"))), F.max("after"))
    missed = (F.floor(place) < F.col("below") - 1) | (F.ceil(place) > F.col("last"))
    m = m.withColumn("last", F.max("end").over(Window.partitionBy(*keys, "i"))).where(F.when(missed, F.raise_error(F.lit("the sketch's bracket misses a quantile")).cast("boolean")).otherwise(True))
    out = m.groupBy(*keys, "i").agg(F.max(place - F.floor(place)).alias("share"), at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"))
    a, b, share = F.col("a"), F.col("b"), F.col("share")
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    quantile = F.when((a == b) | (share == 0), a).when(infinite, (1 - share) * a + share * b).otherwise(a + share * (b - a))
    out = out.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", quantile.alias("q")))), lambda s: s["q"]).alias(name))
    return out.drop("_all")
