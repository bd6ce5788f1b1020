"""Snapshots in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set: a new local one if all of Spark is in this process, else it fails."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="braidworks-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def snapshot(df: DataFrame) -> DataFrame:
    """`df` as it is now, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder, wherever Spark's file systems have it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def snapshot_and_drop(df: DataFrame, path: str) -> DataFrame:
    """`df` as it is now, and the folder that it was read from is removed."""
    kept = snapshot(df)
    drop_folder(df.sparkSession, path)
    return kept
