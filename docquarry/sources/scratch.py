"""Cutting lineage in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set and all runs on one machine (tests) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors have no folder in common")
        named = "file://" + tempfile.mkdtemp(prefix="docquarry-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of one Arrow batch handed to a Python worker, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that long texts don't make a worker's memory grow."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, "2147483647")
    if held.isdigit() and int(held) >= 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))
