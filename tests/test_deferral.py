"""Deferred admission against a plain queue."""

import os
import random
import tempfile
from datetime import datetime, timedelta

import pytest

from docquarry.streaming import events as E
from docquarry.streaming.deferral import deferred, moment

START = datetime(2024, 1, 1)
SCHEMA = "who string, ident long, ts timestamp, tokens long"


def plain(rows, calls, most, seconds):
    """ident -> (status, due in seconds) by trying every moment at which the window changes."""
    out, went, last = {}, [], -1
    for ident, at, tokens in rows:
        if tokens > most:
            out[ident] = ("refused", None)
            continue
        for t in sorted({max(at, last), *(x + seconds for x, _ in went if x + seconds > max(at, last))}):
            live = [n for x, n in went if x > t - seconds]
            if len(live) < calls and sum(live) + tokens <= most:
                break
        went.append((t, tokens))
        last = t
        out[ident] = ("deferred" if t > at else "admitted", t)
    return out


def test_moments_against_every_moment():
    rng = random.Random(3)
    for _ in range(500):
        held, at = [], 0
        for _ in range(rng.randint(0, 8)):
            at += rng.randint(0, 40)
            held.append((at, rng.randint(1, 50)))
        calls, most, tokens = rng.randint(1, 4), rng.randint(50, 90), rng.randint(1, 50)
        want = next(t for t in range(at, at + 1000) if len([1 for x, _ in held if x > t - 60]) < calls and sum(n for x, n in held if x > t - 60) + tokens <= most)
        assert moment(held, at, tokens, calls, most, 60) == want


def stream(spark, files):
    folder = tempfile.mkdtemp(prefix="spark-")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(os.path.join(folder, f"in/batch={k}"))
        for f in os.listdir(os.path.join(folder, f"in/batch={k}")):
            os.utime(os.path.join(folder, f"in/batch={k}", f), (1_700_000_000 + 100 * k,) * 2)
    schema = spark.createDataFrame([], SCHEMA).schema
    return E.timed(E.read(spark, os.path.join(folder, "in/batch=*"), schema, 1), "ts", "0 seconds")


@pytest.mark.parametrize("seed", [1, 2])
def test_calls_wait_and_are_released(spark, seed):
    rng = random.Random(seed)
    at, rows = 0, []
    for ident in range(60):
        at += rng.choice([0, 1, 5, 20])
        rows.append((rng.choice("ab"), ident, at, rng.choice([10, 40, 70, 101])))
    files = [[(w, i, START + timedelta(seconds=s), n) for w, i, s, n in rows[k : k + 20]] for k in (0, 20, 40)]
    files.append([("z", 1000, START + timedelta(days=1), 1)])  # moves the watermark beyond all
    got = E.finished(deferred(stream(spark, files), "who", "ident", "ts", "tokens", 3, 100, 60)).collect()
    came = {int(r["ident"]): r for r in got if r["status"] != "released"}
    gone = {int(r["ident"]): r for r in got if r["status"] == "released"}
    origin = min(r["asked"] for r in got) - 1_000_000 * rows[0][2]
    for who in "ab":
        for ident, (status, due) in plain([(i, s, n) for w, i, s, n in rows if w == who], 3, 100, 60).items():
            assert came[ident]["status"] == status
            if due is not None:
                assert (came[ident]["due"] - origin) / 1e6 == due
    assert set(gone) == {i for i, r in came.items() if r["status"] == "deferred"} and gone
    assert all(gone[i]["due"] == came[i]["due"] and gone[i]["wait_ms"] == came[i]["wait_ms"] for i in gone)


def test_state_of_keys_that_are_done_is_cleared(spark):
    rows = [("a", k, START + timedelta(seconds=k), 50) for k in range(4)]
    later = [[("z", 100 + d, START + timedelta(days=d), 1)] for d in (1, 2, 3)]
    events = deferred(stream(spark, [rows, *later]), "who", "ident", "ts", "tokens", 3, 100, 60)
    folder = tempfile.mkdtemp(prefix="spark-")
    query = events.writeStream.format("noop").outputMode("append").option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    held = spark.read.format("statestore").option("path", folder).option("stateVarName", "held").load()
    assert [r["key"][0] for r in held.collect()] in (["z"], [])
