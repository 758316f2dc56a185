"""Micro-batches that may be replayed: each writes what is its own, under its number, over what it wrote before."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import asof_join


def _earlier(spark: SparkSession, folder: str, schema, batch: int) -> DataFrame:
    """Rows of the batches before this one; none where there is no folder yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    return spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(folder).where(F.col("batch") < batch)


def scoring(folder: str, key: str, scored: Callable[[DataFrame], DataFrame], group: Sequence[str], totals: Sequence[Column]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows whose key no earlier batch scored are scored, and the groups they touch are counted again.

    Scores go to folder/scores/batch=n and groups to folder/groups/batch=n; a
    replayed batch reads only earlier ones and writes over its own, so it
    changes nothing.  Of a key that a batch holds
    twice one row is scored, by a hash, so that a replay takes the same; rows
    of a null key are one key.  A batch without new rows writes empty tables.
    """
    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        one = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("_row"))
        fresh = scored(one.select("_row.*"))
        old = _earlier(spark, f"{folder}/scores", fresh.schema, batch).drop("batch")
        fresh.join(old.select(F.col(key).alias("_known")), F.col(key).eqNullSafe(F.col("_known")), "left_anti").write.mode("overwrite").parquet(f"{folder}/scores/batch={batch}")
        mine = spark.read.schema(fresh.schema).parquet(f"{folder}/scores/batch={batch}")
        touched = old.unionByName(mine).join(mine.select(*group).distinct(), list(group), "left_semi")
        touched.groupBy(*group).agg(*totals).write.mode("overwrite").parquet(f"{folder}/groups/batch={batch}")

    return run


def scores(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/scores").drop("batch")


def groups(spark: SparkSession, folder: str, group: Sequence[str]) -> DataFrame:
    """Each group as the last batch that touched it left it."""
    rows = spark.read.parquet(f"{folder}/groups")
    rest = [c for c in rows.columns if c not in (*group, "batch")]
    return rows.groupBy(*group).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*group, *(F.col(f"_last.{c}").alias(c) for c in rest))


def enriching(folder: str, features: Callable[[SparkSession], DataFrame], key: str | None, time: str, available: str, values: Sequence[str], span_days: int | None = 30) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: a batch's rows with the features last available at or before their time, to folder/rows/batch=n.

    Features are read anew for each batch, so rows that they gain later can't
    change what is written, and those dated after an event never reach it.  A
    replayed batch writes over its own rows.
    """
    def run(rows: DataFrame, batch: int) -> None:
        known = features(rows.sparkSession)
        asof_join(rows, known, key, time, available, list(values), available, span_days).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    return run
