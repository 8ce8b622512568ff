"""Streams of events: windows with watermarks, duplicates, sessions, idempotent upserts, and admission under a rate limit."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from docquarry.sources.scratch import shared_folder
from docquarry.sources.snapshots import SnapshotTable

#: The limiter's window, calls and tokens; how late events may come.
WINDOW_SECONDS, MOST_CALLS, MOST_TOKENS, LATE = 60, 3, 9000, "10 minutes"


def read(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of Parquet files; a path may have wildcards."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(events: DataFrame, key: list[str], ts: str, length: str, slide: str | None, *aggregates: Column) -> DataFrame:
    """Aggregates of tumbling windows, or of sliding ones."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.groupBy(*key, w.alias("window")).agg(*aggregates)


def sessions(events: DataFrame, key: list[str], ts: str, gap: str, *aggregates: Column) -> DataFrame:
    return events.groupBy(*key, F.session_window(ts, gap).alias("window")).agg(*aggregates)


def deduplicated(events: DataFrame, key: list[str]) -> DataFrame:
    """Each key once, within the watermark."""
    return events.dropDuplicatesWithinWatermark(key)


def admission(events: DataFrame, key: str, ident: str, ts: str, tokens: str, calls: int = MOST_CALLS, most: int = MOST_TOKENS, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """admitted and wait_ms of each request: it is admitted if, with it, the window before it has so many calls and tokens at most; else it is told how long until that would be so. Refused requests leave no trace.

    A key's state is the admitted requests of the last window only. Requests of a batch are taken in order of time.
    """
    kind, own = events.schema[ident].dataType.simpleString(), events.schema[key].dataType.simpleString()

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["at", "ident"])
        rows = []
        for i, at, n in zip(frame["ident"], frame["at"], frame["tokens"], strict=True):
            held = [(t, m) for t, m in held if t > at - seconds * 1_000_000]
            wait = 0
            if n > most:
                wait = -1
            elif len(held) >= calls or sum(m for _, m in held) + n > most:
                left = list(held)
                while left and (len(left) >= calls or sum(m for _, m in left) + n > most):
                    wait = left.pop(0)[0] + seconds * 1_000_000 - at
            if wait == 0:
                held.append((int(at), int(n)))
            rows.append((name[0], i, wait == 0, -1 if wait < 0 else -(-wait // 1000)))
        state.update(([t for t, _ in held], [m for _, m in held]))
        yield pd.DataFrame(rows, columns=[key, ident, "admitted", "wait_ms"])

    asked = events.select(key, F.col(ident).alias("ident"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tokens).cast("long").alias("tokens"))
    return asked.groupBy(key).applyInPandasWithState(run, f"{key} {own}, {ident} {kind}, admitted boolean, wait_ms long", "at array<long>, tokens array<long>", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(path: str, key: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest row of each key: each batch writes a new table beside the last one, named after the batch, so a batch that is run again replaces its own output."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = os.path.join(path, f"batch={number - 1}")
        rows = batch
        if number > 0:
            rows = spark.read.schema(batch.schema).parquet(before).unionByName(batch)
        latest = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in key]), version).alias("__row"))
        latest.select(*key, "__row.*").select(*batch.columns).write.mode("overwrite").parquet(os.path.join(path, f"batch={number}"))

    return run


def snapshot_batches(table: SnapshotTable) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that upserts into a snapshot table: a batch rewrites the buckets it touches, and one that is run again changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        table.upsert(batch, batch=number)

    return run


def drained(stream: DataFrame, batches: Callable[[DataFrame, int], None], state: str) -> None:
    """Run a stream's input at hand through a foreachBatch function; `state` is its checkpoint folder."""
    query = stream.writeStream.foreachBatch(batches).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for the input at hand: it runs until that is used up, into the shared folder, and is read from there."""
    spark = stream.sparkSession
    path = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    out, schema = os.path.join(path, "out"), stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else os.path.join(out, f"batch={number}"))

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", os.path.join(path, "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out if mode == "complete" else os.path.join(out, "batch=*"))
