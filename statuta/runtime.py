"""Session helpers: the folder all executors share, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one in local mode only.

    A machine-local folder would lose tables with the machine, so a cluster without the setting
    is refused rather than served.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="statuta-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted with the tables of ``cut``."""
    path = f"{shared_folder(spark)}/statuta/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def cut(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder, in a folder per value of ``by``, and read it back.

    Later stages restart from the table instead of recomputing, also when executors are lost.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, tag)
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, tag: str, most: int = 500_000) -> DataFrame:
    """``df``, narrow rows, written once; marked for broadcast if it has at most ``most`` rows, else joined by shuffling."""
    rows = cut(df, tag)
    return F.broadcast(rows) if rows.count() <= most else rows


def release(keep: int = 0) -> None:
    """Delete the tables that ``cut`` has written, but for the first ``keep``."""
    while len(_written) > keep:
        spark, path = _written.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # its session may be gone
            continue


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end the tables that were cut within: for work whose result is written before."""
    before = len(_written)
    try:
        yield
    finally:
        release(before)


atexit.register(release)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores if a few input files would leave some idle; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The table of that name in a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def salt(column: str | Column, ways: int) -> Column:
    """A number below ``ways`` from the value of ``column``: the same on every retry of a task."""
    return F.pmod(F.xxhash64(column), F.lit(ways)).cast("int")
