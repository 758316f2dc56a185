"""Files as they come: price CSVs named by ticker, sheets with lines above their header, event logs, a list of sources to fall back on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def price_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All CSV files below a folder, with the ticker in the name of their file or of its `ticker=` folder."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(folder, header=True, schema=schema)
    path = F.col("_metadata.file_path")
    named = F.coalesce(F.nullif(F.regexp_extract(path, r"ticker=([^/]+)/", 1), F.lit("")), F.regexp_extract(path, r"([^/]+)\.csv$", 1))
    return raw.withColumn("ticker", F.url_decode(F.url_decode(named)))


def header_row(content: Column, required: Sequence[str], scan_rows: int = 12) -> Column:
    """Number, from 0, of the first of `scan_rows` lines whose comma-separated cells hold all required names; null if none does."""
    lines = F.slice(F.split(content, "\n", scan_rows + 1), 1, scan_rows)
    cells = lambda x: F.transform(F.split(x, ","), lambda c: F.lower(F.trim(c)))
    holds = F.transform(lines, lambda x: F.size(F.array_except(F.array(*map(F.lit, required)), cells(x))) == 0)
    return F.nullif(F.array_position(holds, True), F.lit(0)).cast("int") - 1


def materialized(events: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Events written with all but their keys as one JSON payload, read back from the files."""
    rest = [c for c in events.columns if c not in keys]
    out = events.select(*keys, F.to_json(F.struct(*rest)).alias("payload"))
    out.write.mode("append").parquet(path)
    return events.sparkSession.read.schema(out.schema).parquet(path)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists in its store."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))
