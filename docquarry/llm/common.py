"""Shared plumbing of the training-data operators: scratch tables, Arrow batches, whitespace classes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace that separates words everywhere in this subpackage (ASCII only).
SPACE_CLASS = r"\x20\x09-\x0D"
#: Bytes of one Arrow batch handed to a Python worker, unless the session says otherwise.
BATCH_BYTES = 4 * 1024 * 1024


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where none is set and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    got = spark.sparkContext.getCheckpointDir() if hasattr(spark, "sparkContext") else None
    if got:
        return got
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: executors have no folder in common")
    own = "file://" + tempfile.mkdtemp(prefix="docquarry-")
    spark.sparkContext.setCheckpointDir(own)
    return own


_WRITTEN: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write `df` once into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"docquarry-{uuid.uuid4().hex}")
    df.write.option("compression", codec).parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def named_rows(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with a name each, __dq_file and __dq_row: a file's and a row's number. What isn't read from files is written first."""
    for frame in (docs, None):
        frame = materialize(docs) if frame is None else frame
        try:
            return frame.select("*", F.xxhash64("_metadata.file_path").alias("__dq_file"), F.col("_metadata.row_index").alias("__dq_row"))
        except AnalysisException:
            continue
    raise RuntimeError("written tables have row numbers")


#: What names a row and orders it within a group.
ROW = ("doc_id", "__dq_file", "__dq_row")


def first_of_each(named: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """One row of `named` for each value of the column `group` of `groups` (which has ROW and it): the smallest doc_id, nulls last, and the first such row."""
    first = groups.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *ROW)).alias("x"))
    return named.join(first.select("x.__dq_file", "x.__dq_row"), ["__dq_file", "__dq_row"], "left_semi")


#: A stage's output, between two stages.
rewritten = materialize


def release(keep: int = 0) -> None:
    """Delete the written scratch tables, but for the last `keep`. Frames that read the deleted ones become invalid."""
    while len(_WRITTEN) > keep:
        spark, path = _WRITTEN.pop(0)
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: nothing is left to ask
            return


atexit.register(release)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that long documents don't make a worker's memory grow."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if int(spark.conf.get(key, "2147483647")) >= 2**31 - 1:
            spark.conf.set(key, str(BATCH_BYTES))
    except Exception:  # a bound such as "64m" was set by hand: leave it
        return


def text_bytes(df: DataFrame, *keep: str) -> DataFrame:
    """`keep` columns and the text as UTF-8 bytes (null stays null); every other column is pruned from the scan."""
    bounded_batches(df.sparkSession)
    return df.select(*keep, F.col("text").cast("binary").alias("text"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column as one array, and where each value begins and ends (nulls are empty)."""
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]
