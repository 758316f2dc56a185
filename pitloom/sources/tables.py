"""Tables: parquet scans and the panel derived from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_scan(
    df: DataFrame, columns: Sequence[str] | None = None, date_col: str | None = None, start=None, end=None,
    equal: Mapping[str, object] | None = None, within: Mapping[str, Sequence] | None = None, order_by: Sequence[str] = (), limit: int | None = None,
) -> DataFrame:
    """Filters that reach the scan, then columns, order and limit; both ends count, an empty list filters nothing."""
    if start is not None:
        df = df.where(F.col(date_col) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(date_col) <= F.lit(end))
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    for c, vs in (within or {}).items():
        vs = [v for v in vs if v is not None]
        if vs:
            df = df.where(F.col(c).isin(vs))
    df = df.select(*columns) if columns else df
    df = df.orderBy(*order_by) if order_by else df
    return df if limit is None else df.limit(limit)


def week_ending_friday(d: Column) -> Column:
    return F.next_day(F.date_sub(d, 1), "Fri")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars (date, ticker, close, high, low, volume) of brands, from line prices; one shuffle on (ticker, date)."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("date", week_ending_friday(F.to_date("l_shipdate")))
    return joined.groupBy("date", "ticker").agg(F.avg("px").alias("close"), F.max("px").alias("high"), F.min("px").alias("low"), F.sum("l_quantity").alias("volume"))
