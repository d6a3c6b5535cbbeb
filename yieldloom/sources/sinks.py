"""Writers: exports, versions of a set of tables, appends with ids, upserts, updates and deletes by key.

Parquet has no updates, so changes are rewrites: a function gives the new table as a DataFrame, and write_version()
writes it as part of a new version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from yieldloom.session import materialize
from yieldloom.sources.tables import path_of


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists; none is an error, never a silent fixture."""
    for path in paths:
        fs, p = path_of(spark, path)
        if fs.exists(p):
            return path
    raise FileNotFoundError(f"none of {paths} exists")


def json_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Objects of a JSON array, or one object a file; fields that are missing are null."""
    return spark.read.option("multiLine", True).schema(ddl).json(path)


def export(df: DataFrame, path: str, kind: str) -> None:
    """One file as csv (with header) or json, for tables a person reads."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def write_version(tables: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Write all tables into a new folder, then move the pointer to it, one rename; rows written per table.

    Readers take the folder from current(), so they see all tables of one version. If a write fails, the pointer has
    not moved. Old versions stay until they are deleted.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"version-{uuid.uuid4().hex}"
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}.parquet")
        counts[name] = spark.read.parquet(f"{folder}/{version}/{name}.parquet").count()
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.text(f"{folder}/pointer-{version}")
    fs, old = path_of(spark, f"{folder}/pointer")
    _, new = path_of(spark, f"{folder}/pointer-{version}")
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{new} can't be moved")
    return counts


def current(spark: SparkSession, folder: str) -> str:
    """The folder of the version that the pointer names."""
    return f"{folder}/{spark.read.text(f'{folder}/pointer').first()[0]}"


def with_ids(df: DataFrame, last: int, id_col: str = "id") -> DataFrame:
    """Adds ids last + 1, last + 2, ... without gathering rows: places in a partition plus the rows of earlier ones."""
    placed = materialize(df.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()), "ids")
    runs = placed.groupBy("_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))  # one row per partition
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_part", "_first", before.alias("_before"))
    out = placed.join(F.broadcast(runs), "_part").withColumn(id_col, F.col("_place") - F.col("_first") + F.col("_before") + last + 1)
    return out.select(id_col, *[c for c in df.columns if c != id_col])


def append(df: DataFrame, path: str, id_col: str = "id") -> int:
    """Append rows with new ids; the last id. The first append makes the table."""
    spark = df.sparkSession
    fs, p = path_of(spark, path)
    last = spark.read.parquet(path).agg(F.max(id_col)).first()[0] or 0 if fs.exists(p) else 0
    new = materialize(with_ids(df, last, id_col), "append")
    new.write.mode("append").parquet(path)
    return new.agg(F.max(id_col)).first()[0] or last


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows whose key isn't among the new ones, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.distinct(), keys.columns, "left_anti")
