"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that sessions of this process have written, for cleanup(), and how often it ran.
_tables: list[str] = []
_cleanups: list[int] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where spark.checkpoint.dir is unset, a local master gets one of its own; on a
    cluster that is an error, as executors would write where nobody else can read."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder, so a lost executor costs nothing upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, *partition: str, lookup: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table, read again: computed once however often it is used, and read by column. lookup: columns
    with Bloom filters, so that equality with a rare value reads the row groups that may hold it alone."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = (df.write.partitionBy(*partition) if partition else df.write).option("compression", "zstd")
    for column in lookup:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True).option("parquet.bloom.filter.adaptive.enabled", True)
    writer.parquet(path)
    _tables.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if partition else df.sparkSession.read.parquet(path)


def state_of(spark: SparkSession, path: str) -> tuple:
    """Bytes, files and time of a table, and the number of cleanups: they change when it, or what was made of it, does."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = name.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(name)
    status = name.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(name)
    return found.getLength(), found.getFileCount(), status.getModificationTime(), len(_cleanups)


def is_there(spark: SparkSession, df: DataFrame) -> bool:
    """Whether the first file of a stored table is still in its place: shared folders get cleared."""
    files = df.inputFiles()
    if not files:
        return False
    name = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(files[0]))
    return name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name)


def cleanup(spark: SparkSession) -> int:
    """Deletes the tables that this process has written so far; for when their results have been stored."""
    for path in _tables:
        name = spark._jvm.org.apache.hadoop.fs.Path(path)
        name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)
    n = len(_tables)
    _tables.clear()
    _cleanups.append(n)
    return n
