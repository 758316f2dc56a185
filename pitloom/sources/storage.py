"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session that names none, as in tests, gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-tables-"))


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A path of its own in the shared folder; Spark deletes what lies there when the driver ends."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)  # what doesn't exist can't be marked
    files.deleteOnExit(folder)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, computed once, written to the shared folder and read from there: later reads survive lost executors."""
    path = new_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
