"""Session settings, the shared folder and the one way of cutting a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of this process, made only for a local master without spark.checkpoint.dir.
_local: list[str] = []
#: What materialize() has written and clean() has not yet removed.
_written: list[str] = []
#: Tables that several results need, by what they were made from: path and schema.
_kept: dict[tuple, tuple[str, object]] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("yieldloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local master, where every task runs on this machine, may do without: it gets a temporary folder, which
    is removed when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="yieldloom-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return the written table.

    Whatever reads the result later, also after an executor is lost, reads these files instead of
    computing df again. They stay until clean() is called.
    """
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession, name: str) -> str:
    """A path of this process in the shared folder, for tables that are written in several steps; clean() removes it."""
    _written.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def kept(spark: SparkSession, name: str, source: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several results need, written by the first of them and read by the others.

    source says what it is made from: sources.tables.state_of() of the files, and parameters. When they change, or the
    written files are gone, it is made again.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key in _kept:
        path, schema = _kept[key]
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.read.schema(schema).parquet(path)
    out = materialize(make(), name)
    _kept[key] = (_written[-1], out.schema)
    return out


def clean(spark: SparkSession) -> int:
    """Remove the intermediate tables this process has written; call it when the results that read them are written."""
    removed = len(_written)
    _kept.clear()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed
