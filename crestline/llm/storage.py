"""Tables and files in the shared folder, readable from every executor."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
import pyarrow.fs as pafs

from crestline.session import workspace


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; only a local session may go without that setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return workspace(spark, purpose)


def written(df: DataFrame, purpose: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, lost executors lose nothing."""
    path = shared_path(df.sparkSession, purpose)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(path: str):
    """File system and inner path of a URI or absolute path (local, HDFS or object store)."""
    return pafs.FileSystem.from_uri(path)
