"""Roll-ups of an event stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.replace("events.parquet", "event[s].parquet")).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def distinct_within(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, as a table."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def sliding_counts(events: DataFrame, width: str, step: str, late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, gap: str, late: str = "2 days") -> DataFrame:
    """Bursts of a key's events, split where nothing comes for so long."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def followed(first: DataFrame, then: DataFrame, key: str, within: str, late: str = "2 days") -> DataFrame:
    """Pairs of events of one key, the second after the first and within so long; state is kept no longer than that."""
    a = first.withWatermark("ts", late).select(F.col(key).alias("_a"), F.col("ts").alias("_at"), F.col("event_id").alias("first"))
    b = then.withWatermark("ts", late).select(F.col(key).alias("_b"), F.col("ts").alias("_then"), F.col("event_id").alias("then"))
    return a.join(b, F.expr(f"_a = _b AND _then > _at AND _then <= _at + INTERVAL {within}")).select("first", "then")


def in_slices(slices: Iterable[DataFrame], folder: str, start: Callable) -> None:
    """Feeds a stream slice by slice: each is written to the folder, then all that is new runs through start(stream), a writer, from its checkpoint."""
    for rows in slices:
        spark = rows.sparkSession
        rows.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        start(stream).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def slices_to_table(slices: list[DataFrame], folder: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What change makes of the stream of slices, as a table."""
    spark, seen = slices[0].sparkSession, []

    def start(stream: DataFrame):
        out = change(stream)
        seen.append(out.schema)
        return out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows")

    in_slices(slices, folder, start)
    return spark.read.schema(seen[0]).parquet(f"{folder}/rows")
