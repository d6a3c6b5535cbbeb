"""Readers of the tables a plan works on: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def path_of(spark: SparkSession, path: str):
    """The file system a path is on, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def state_of(spark: SparkSession, folder: str, *names: str) -> tuple:
    """What the files of the tables are now: path, bytes, files and time of change. Other files give another state."""
    out = []
    for name in names:
        fs, p = path_of(spark, f"{folder}/{name}.parquet")
        if fs.exists(p):
            size = fs.getContentSummary(p)
            out.append((p.toString(), size.getLength(), size.getFileCount(), fs.getFileStatus(p).getModificationTime()))
    return tuple(out)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def optional_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table, or a typed empty one if it is missing."""
    fs, p = path_of(spark, path)
    return spark.read.parquet(path) if fs.exists(p) else spark.createDataFrame([], ddl)
