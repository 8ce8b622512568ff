"""Snapshot tables: hash-bucketed files and numbered manifests, of which the last one is the table.

A manifest names, for each bucket of keys, the folder its rows are in and how many they are. A write makes new folders for
the buckets that it touches and then a manifest with the next number, which is created only if no one else has created it:
readers see the table before or after, never between, and a write that fails leaves the old manifest standing. Rows of
buckets that a write doesn't touch are neither read nor written.

What comes to the driver is a row a bucket (`buckets` is fixed when a table is made), never rows of the table.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from docquarry.sources.scratch import checkpointed

#: What ends a manifest that is whole.
WHOLE = "end"


class SnapshotConflict(RuntimeError):
    """Another writer has taken the number of the manifest."""


class CountMismatch(ValueError):
    """What was written isn't what was expected; the table stays as it was."""


@dataclass(frozen=True)
class Manifest:
    number: int
    buckets: dict[int, tuple[str, int]]
    batch: int | None = None
    made: float = 0.0
    note: str = ""

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.buckets.values())


class Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self.hadoop = jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str) -> object:
        return self.hadoop.Path(os.path.join(self.path, *parts))

    def names(self, *parts: str) -> list[str]:
        where = self.at(*parts)
        return [s.getPath().getName() for s in self.files.listStatus(where)] if self.files.exists(where) else []

    def text(self, *parts: str) -> str:
        source = self.files.open(self.at(*parts))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def create(self, text: str, *parts: str) -> None:
        """A new file; an existing one is an error, whoever made it."""
        try:
            out = self.files.create(self.at(*parts), False)
        except Exception as taken:
            raise SnapshotConflict(f"SNAPSHOT_CONFLICT: {os.path.join(*parts)}") from taken
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self, *parts: str) -> None:
        self.files.delete(self.at(*parts), True)


@dataclass
class SnapshotTable:
    """A table of rows with a key, in `path`. `schema` is the rows'; `version` orders the rows of a key."""

    spark: SparkSession
    path: str
    schema: StructType
    key: list[str]
    version: str
    buckets: int = 64
    folder: Folder = field(init=False)

    def __post_init__(self) -> None:
        self.folder = Folder(self.spark, self.path)

    # what is there

    def numbers(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.folder.names("manifests") if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> Manifest:
        """The last manifest that is whole, or the one with a number."""
        for n in reversed(self.numbers()) if number is None else [number]:
            try:
                held = json.loads(self.folder.text("manifests", f"{n:08d}.json"))
            except ValueError:  # being written just now
                continue
            if held.get(WHOLE):
                return Manifest(n, {int(b): (f, c) for b, (f, c) in held["buckets"].items()}, held["batch"], held["made"], held["note"])
        if number is not None:
            raise ValueError(f"SNAPSHOT_MISSING: {number}")
        return Manifest(0, {})

    def read(self, number: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of the table, now or as of a manifest."""
        held = self.manifest(number).buckets
        wanted = set(held) if only is None else set(only) & set(held)
        paths = sorted(os.path.join(self.path, held[b][0]) for b in wanted if held[b][1])
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    # writing

    def write(self, rows: DataFrame) -> dict[int, tuple[str, int]]:
        """Rows in new folders, one a bucket, and how many each has. A bucket's rows are dealt over tasks as Spark sizes them."""
        name = os.path.join("data", uuid.uuid4().hex)
        target = os.path.join(self.path, name)
        rows.select(*self.schema.names, self.bucket().alias("__bucket")).repartition("__bucket").write.partitionBy("__bucket").parquet(target)
        stored = self.spark.read.schema(StructType([*self.schema.fields]).add("__bucket", IntegerType())).parquet(target)
        counts = stored.groupBy("__bucket").count().collect()  # a row a bucket
        return {r["__bucket"]: (os.path.join(name, f"__bucket={r['__bucket']}"), r["count"]) for r in counts}

    def commit(self, before: Manifest, changed: dict[int, tuple[str, int]], batch: int | None = None, note: str = "") -> Manifest:
        """The next manifest: `changed` buckets over those before."""
        after = Manifest(before.number + 1, {**before.buckets, **changed}, before.batch if batch is None else batch, time.time(), note)
        said = {"buckets": {str(b): list(x) for b, x in sorted(after.buckets.items())}, "batch": after.batch, "made": after.made, "note": note, WHOLE: True}
        self.folder.create(json.dumps(said), "manifests", f"{after.number:08d}.json")
        return after

    def touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # a row a bucket

    def merged(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        """Of each key the row with the latest version; of equal versions the change."""
        both = old.withColumn("__new", F.lit(0)).unionByName(changes.select(*self.schema.names).withColumn("__new", F.lit(1)))
        rest = [c for c in self.schema.names if c not in self.key]
        order = F.struct(F.col(self.version).alias("v"), "__new", F.xxhash64(*rest).alias("h"))
        return both.groupBy(*self.key).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*self.key, "__row.*").select(*self.schema.names)

    def upsert(self, changes: DataFrame, valid: Column | None = None, batch: int | None = None) -> tuple[Manifest, DataFrame]:
        """The manifest after the changes, and each change's key, status and whether it may be tried again.

        Statuses: `rejected` (no key, or `valid` doesn't hold; the others are written all the same), `stale` (the table or
        the changes have a later row of the key), `written`. A batch that was applied before (a stream tries again) changes nothing.
        """
        before = self.manifest()
        told = checkpointed(changes.select(*self.schema.names).withColumn("__ok", self.complete(valid)))
        good = told.filter("__ok").drop("__ok")
        after = before
        if batch is None or before.batch is None or batch > before.batch:
            where = self.touched(good)
            changed = self.write(self.merged(self.read(before.number if before.number else None, where), good)) if where else {}
            after = self.commit(before, changed, batch, "upsert")
        now = self.read(after.number if after.number else None, self.touched(good)).select(*self.key, F.struct(*self.schema.names).alias("__now"))
        same = told.withColumn("__row", F.struct(*self.schema.names)).join(now, self.key, "left")
        status = F.when(~F.col("__ok"), "rejected").when(F.col("__row").eqNullSafe(F.col("__now")), "written").otherwise("stale")
        return after, same.select(*self.key, self.version, status.alias("status"), F.lit(False).alias("retryable"))

    def complete(self, valid: Column | None) -> Column:
        there = F.lit(True)
        for k in self.key:
            there = there & F.col(k).isNotNull()
        return F.coalesce(there if valid is None else there & valid, F.lit(False))

    def delete(self, keys: DataFrame) -> Manifest:
        """Without the rows of these keys."""
        before = self.manifest()
        gone = keys.select(*self.key).distinct()
        where = self.touched(gone)
        left = self.read(before.number if before.number else None, where).join(gone, self.key, "left_anti")
        written = self.write(left) if where else {}
        return self.commit(before, {b: written.get(b, ("", 0)) for b in where if b in before.buckets}, note="delete")

    def publish(self, staged: DataFrame, expected: int, scope: Column | None = None) -> Manifest:
        """Put the staged rows in the place of those in `scope` (of all): written and counted first, then shown at once. A wrong count leaves the table as it was."""
        before = self.manifest()
        kept = None if scope is None else self.read(before.number if before.number else None).filter(~F.coalesce(scope, F.lit(False)))
        fresh = staged.select(*self.schema.names)
        own = Window.partitionBy(*self.key)
        rows = fresh if kept is None else kept.unionByName(fresh)
        twice = rows.withColumn("__n", F.count("*").over(own)).filter("__n > 1")
        if not twice.isEmpty():
            raise CountMismatch("INDEX_KEY_NOT_UNIQUE: staged rows have keys twice, or keys that are outside of the scope")
        written = self.write(fresh)
        found = sum(n for _, n in written.values())
        if found != expected:
            raise CountMismatch(f"INDEX_COUNT_MISMATCH: {found} rows staged, {expected} expected")
        if kept is not None:
            written = self.write(rows)
        return self.commit(before, {**{b: ("", 0) for b in before.buckets}, **written}, note="publish")

    def restore(self, number: int) -> Manifest:
        """The table as it was: an old manifest's buckets under a new number."""
        old, last = self.manifest(number), self.manifest()
        return self.commit(last, {**{b: ("", 0) for b in last.buckets}, **old.buckets}, note=f"restore {number}")

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the last `keep` manifests names, and older manifests. How many folders went."""
        numbers = self.numbers()
        held = {os.path.dirname(f) for n in numbers[-keep:] for f, _ in self.manifest(n).buckets.values() if f}
        gone = [n for n in self.folder.names("data") if os.path.join("data", n) not in held]
        for n in numbers[:-keep]:
            self.folder.delete("manifests", f"{n:08d}.json")
        for n in gone:
            self.folder.delete("data", n)
        return len(gone)
