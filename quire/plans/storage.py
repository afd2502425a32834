"""Shared-folder staging: cut lineage through written tables that every executor can read.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where that setting is absent
(tests, a laptop) is a folder of our own used.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own on a single machine whose session names none.  A cluster
    must name one, as its executors cannot read a folder of the driver's machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors can read")
    own = os.path.join(tempfile.gettempdir(), f"quire-{os.getuid()}", spark.sparkContext.applicationId)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def file_system(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a path of any scheme, by Spark's own Hadoop classes."""
    full = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return full.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), full


def _clean_up(spark: SparkSession, folder: str) -> None:
    """Remove what this application stages when it ends."""
    fs, path = file_system(spark, folder)
    fs.deleteOnExit(path)


def stage_folder(spark: SparkSession) -> str:
    """The folder of what this application stages, gone when it ends."""
    folder = f"{shared_folder(spark)}/quire/stage-{spark.sparkContext.applicationId}"
    if folder not in _STAGES:
        fs, path = file_system(spark, folder)
        fs.mkdirs(path)
        _clean_up(spark, folder)
        _STAGES.add(folder)
    return folder


_STAGES: set[str] = set()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back from there."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> str:
    """A key of the files a table is read from: their paths, lengths and times."""
    spark = df.sparkSession
    marks = []
    for name in sorted(df.inputFiles()):
        fs, path = file_system(spark, name)
        status = fs.getFileStatus(path)
        marks.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(marks).encode()).hexdigest()[:32]


def kept(source: DataFrame, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from ``source``, written to the shared folder once and read from there as long as the files of
    ``source`` are the same.  A source that is not read from files is derived anew."""
    spark = source.sparkSession
    if not source.inputFiles():
        return staged(make(), name)
    path = f"{shared_folder(spark)}/quire/kept/{name}-{fingerprint(source)}"
    fs, done = file_system(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
