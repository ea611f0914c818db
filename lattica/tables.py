"""Written intermediate tables, in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
_WRITTEN: list[str] = []
_FOLDERS: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; clusters ship it with --py-files."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has used, in the application's own part of the shared folder, which goes when the driver's JVM ends."""
    folder = f"{shared_folder(spark)}/lattica/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        own, fs = _hadoop_path(spark, folder)
        fs.mkdirs(own)
        fs.deleteOnExit(own)
        _FOLDERS.add(folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files that a write in here uses are dropped as soon as it ends, so that a long plan holds the files of one step at a time."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: computed once, kept when executors are lost."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, label)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_path = path
    return out


def parted(df: DataFrame, path: str, by: str) -> None:
    """Adds df to the table at path, a folder for each value of by, as by=value."""
    spark = df.sparkSession
    before = spark.conf.get(_WRITERS, "0")
    spark.conf.set(_WRITERS, "64")  # a file for each value at once, else each task sorts its rows by them
    try:
        with shuffles_dropped(spark):
            df.write.mode("append").partitionBy(by).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_WRITERS, before)


def exists(spark: SparkSession, path: str) -> bool:
    own, fs = _hadoop_path(spark, path)
    return fs.exists(own)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what parted() wrote at path, or one folder of it."""
    own, fs = _hadoop_path(spark, path)
    fs.delete(own, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() gave and that no frame used later reads."""
    for df in tables:
        path, fs = _hadoop_path(df.sparkSession, df.written_path)
        fs.delete(path, True)
        _WRITTEN.remove(df.written_path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that materialize() wrote; frames that read them can't be used afterwards.

    Without a call they go when the driver's JVM ends: the frame that a query gave may read some of them until then.
    """
    while _WRITTEN:
        path, fs = _hadoop_path(spark, _WRITTEN.pop())
        fs.delete(path, True)
