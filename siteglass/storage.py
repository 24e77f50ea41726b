"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Folders that are deleted at the end.
leaving: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = option.get() if option.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="siteglass-")
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the application's own folder, which goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/siteglass/{spark.sparkContext.applicationId}"
    if folder not in leaving:
        leaving.add(folder)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back, which cuts its lineage; gives the path too."""
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def open_path(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it, for code that runs on executors."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return pafs.FileSystem.from_uri(uri)
