"""Snapshot tables: only touched buckets are rewritten, a manifest is the switch, a failed write leaves the old one."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from docquarry.sources.snapshots import CountMismatch, SnapshotConflict, SnapshotTable

SCHEMA = "id long, name string, run string, v long"


def made(spark, rows=None, buckets=8):
    schema = spark.createDataFrame([], SCHEMA).schema
    table = SnapshotTable(spark, tempfile.mkdtemp(prefix="spark-") + "/table", schema, ["id"], "v", buckets)
    if rows:
        table.upsert(frame(spark, rows))
    return table


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts_against_a_plain_dictionary(spark):
    rng = random.Random(4)
    table, held = made(spark), {}
    for batch in range(4):
        changes = [(rng.randrange(30), f"n{rng.randrange(1000)}", "r", rng.randrange(5)) for _ in range(20)]
        changes = list({(c[0], c[3]): c for c in changes}.values())
        manifest, statuses = table.upsert(frame(spark, changes))
        for c in sorted(changes, key=lambda c: c[3]):
            if c[0] not in held or c[3] >= held[c[0]][3]:
                held[c[0]] = c
        assert rows(table.read()) == sorted(held.values(), key=str) and manifest.number == batch + 1 and manifest.rows == len(held)
        said = {(r["id"], r["v"]): r["status"] for r in statuses.collect()}
        assert said == {(c[0], c[3]): "written" if held[c[0]] == c else "stale" for c in changes}


def test_only_touched_buckets_are_written(spark):
    table = made(spark, [(k, "a", "r", 0) for k in range(200)])
    before = table.manifest()
    after, _ = table.upsert(frame(spark, [(7, "b", "r", 1)]))
    changed = [b for b in after.buckets if after.buckets[b] != before.buckets[b]]
    assert len(changed) == 1 and len(after.buckets) == 8
    assert table.read().filter("name = 'b'").count() == 1 and table.read(before.number).filter("name = 'b'").count() == 0
    plan = table.read(only=changed).inputFiles()
    assert all(after.buckets[changed[0]][0] in f for f in plan)


def test_partial_failures_are_told_and_the_rest_is_written(spark):
    table = made(spark, [(1, "a", "r", 5)])
    _, statuses = table.upsert(frame(spark, [(None, "x", "r", 1), (2, "", "r", 1), (3, "c", "r", 1), (1, "old", "r", 4)]), F.col("name") != "")
    assert {(r["id"], r["status"]) for r in statuses.collect()} == {(None, "rejected"), (2, "rejected"), (3, "written"), (1, "stale")}
    assert rows(table.read()) == [(1, "a", "r", 5), (3, "c", "r", 1)]


def test_a_batch_that_is_run_again_changes_nothing(spark):
    table = made(spark)
    first, _ = table.upsert(frame(spark, [(1, "a", "r", 1)]), batch=0)
    again, statuses = table.upsert(frame(spark, [(1, "a", "r", 1)]), batch=0)
    assert first.number == again.number == 1 and [r["status"] for r in statuses.collect()] == ["written"]
    assert table.upsert(frame(spark, [(2, "b", "r", 1)]), batch=1)[0].number == 2


def test_a_wrong_count_leaves_the_table_as_it_was(spark):
    table = made(spark, [(k, "a", "one" if k < 5 else "two", 0) for k in range(10)])
    staged = frame(spark, [(k, "b", "one", 1) for k in range(3)])
    with pytest.raises(CountMismatch):
        table.publish(staged, 4, F.col("run") == "one")
    assert table.manifest().number == 1 and table.read().count() == 10
    with pytest.raises(CountMismatch):
        table.publish(frame(spark, [(7, "b", "one", 1)]), 1, F.col("run") == "one")  # a key outside of the scope
    after = table.publish(staged, 3, F.col("run") == "one")
    assert after.rows == 8 and rows(table.read()) == sorted([(k, "b", "one", 1) for k in range(3)] + [(k, "a", "two", 0) for k in range(5, 10)], key=str)
    table.restore(1)
    assert table.read().count() == 10 and table.manifest().number == 3


def test_deletes_and_emptied_buckets(spark):
    table = made(spark, [(k, "a", "r", 0) for k in range(10)])
    table.delete(frame(spark, [(k, "", "", 0) for k in range(9)] + [(77, "", "", 0)]))
    assert rows(table.read()) == [(9, "a", "r", 0)]
    table.delete(frame(spark, [(9, "", "", 0)]))
    assert table.read().count() == 0 == table.manifest().rows
    table.upsert(frame(spark, [(9, "z", "r", 0)]))
    assert rows(table.read()) == [(9, "z", "r", 0)]


def test_writers_that_meet_conflict(spark):
    table = made(spark, [(1, "a", "r", 0)])
    before = table.manifest()
    table.upsert(frame(spark, [(2, "b", "r", 0)]))
    with pytest.raises(SnapshotConflict):
        table.commit(before, {})
    table.folder.create('{"buckets": {', "manifests", "00000003.json")  # a manifest that is being written
    assert table.manifest().number == 2 and table.read().count() == 2


def test_vacuum_keeps_what_the_last_manifests_name(spark):
    table = made(spark, [(k, "a", "r", 0) for k in range(50)])
    for v in range(1, 4):
        table.upsert(frame(spark, [(k, f"n{v}", "r", v) for k in range(50)]))
    assert table.vacuum(2) == 2
    assert table.numbers() == [3, 4] and table.read(3).count() == 50 and rows(table.read()) == sorted([(k, "n3", "r", 3) for k in range(50)], key=str)
    assert len(os.listdir(os.path.join(table.path, "data"))) == 2


def test_empty_changes(spark):
    table = made(spark)
    manifest, statuses = table.upsert(frame(spark, []))
    assert manifest.rows == 0 and statuses.count() == 0 and table.read().count() == 0
