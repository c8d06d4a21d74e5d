"""Folders that the driver and all executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the session's spark.checkpoint.dir; only where none is set and all is one process below a temporary folder."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that no table is read from any more."""
    system, found = file_system(spark, path)
    system.delete(found, True)


def kept(df: DataFrame, *folders: str) -> DataFrame:
    """The table cut off from the folders that it was read from, which go."""
    shared_folder(df.sparkSession, "any")  # sets the checkpoint folder
    out = df.checkpoint(eager=True)
    for folder in folders:
        removed(df.sparkSession, folder)
    return out
