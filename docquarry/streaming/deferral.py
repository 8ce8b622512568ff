"""Deferred admission: calls beyond a rate limit wait in state and are let go by event-time timers.

A key's calls go in order of arrival (those of a batch by time, then by id). A call is let go at the first moment, not before
its own time nor before the call ahead of it, at which the window that ends there has room for it: fewer than `calls` calls and,
with it, `tokens` tokens at most. That moment is known when the call comes, since no later call can go ahead; what has to
wait is stored with its moment, and a timer gives it out once the watermark has passed that. A call for more tokens than the limit
is refused. When nothing waits and the last window is over, a timer clears the key's state.

Each call gives a row when it comes: `admitted`, `deferred` (with the moment and the wait) or `refused`; a deferred one gives a
second row, `released`, when its timer fires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docquarry.streaming.events import MOST_CALLS, MOST_TOKENS, WINDOW_SECONDS

#: State with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def moment(held: list[tuple[int, int]], at: int, tokens: int, calls: int, most: int, window: int) -> int:
    """The first time from `at` on at which a call fits; `held` are the times and tokens of earlier calls, in order of time. A call leaves the window `window` after its time."""
    live = [(t, n) for t, n in held if t + window > at]
    used = sum(n for _, n in live)
    while live and (len(live) >= calls or used + tokens > most):
        t, n = live.pop(0)
        used -= n
        at = max(at, t + window)
    return at


class Deferral(StatefulProcessor):
    """State of a key: the calls of the last window (those that wait are among them, at their moments), and those that wait."""

    def __init__(self, key: str, calls: int, most: int, window: int) -> None:
        self.key, self.calls, self.most, self.window = key, calls, most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at array<long>, tokens array<long>")
        self.waiting = handle.getListState("waiting", "ident string, asked long, due long, tokens long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = list(zip(*self.held.get(), strict=True)) if self.held.exists() else []
        out, later = [], []
        for ident, at, tokens in pd.concat(list(rows))[["ident", "at", "tokens"]].sort_values(["at", "ident"]).itertuples(index=False):
            if tokens > self.most:
                out.append((key[0], ident, "refused", at, None, None))
                continue
            due = moment(held, max(at, held[-1][0]) if held else at, tokens, self.calls, self.most, self.window)
            held = [(t, n) for t, n in held if t + self.window > due] + [(int(due), int(tokens))]
            if due > at:
                later.append((ident, int(at), int(due), int(tokens)))
            out.append((key[0], ident, "deferred" if due > at else "admitted", at, due, (due - at) // 1000))
        if later:
            self.waiting.appendList(later)
            for due in sorted({x[2] for x in later}):
                self.handle.registerTimer(due // 1000)
        if held:
            self.held.update(([t for t, _ in held], [n for _, n in held]))
            self.handle.registerTimer((held[-1][0] + self.window) // 1000 + 1)
        yield frame(out, self.key)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        due = [x for x in waiting if x[2] // 1000 <= now]
        left = [x for x in waiting if x[2] // 1000 > now]
        if due:
            self.waiting.clear()
            if left:
                self.waiting.put(left)
        if not left and self.held.exists() and (self.held.get()[0][-1] + self.window) // 1000 < now:
            self.held.clear()
        yield frame([(key[0], i, "released", asked, at, (at - asked) // 1000) for i, asked, at, _ in due], self.key)

    def close(self) -> None:
        pass


def frame(rows: list[tuple], key: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[key, "ident", "status", "asked", "due", "wait_ms"])
    return out.astype({"asked": "Int64", "due": "Int64", "wait_ms": "Int64"})


def with_timers(spark: SparkSession) -> None:
    """Timers and lists in state need a store that has them; a session that names one keeps it."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def deferred(events: DataFrame, key: str, ident: str, ts: str, tokens: str, calls: int = MOST_CALLS, most: int = MOST_TOKENS, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """key, ident (as text), status, asked and due (microseconds), wait_ms of each call of a stream with a watermark on `ts`."""
    with_timers(events.sparkSession)
    own = events.schema[key].dataType.simpleString()
    asked = events.select(key, ts, F.col(ident).cast("string").alias("ident"), F.unix_micros(F.col(ts)).alias("at"), F.col(tokens).cast("long").alias("tokens"))
    kind = f"{key} {own}, ident string, status string, asked long, due long, wait_ms long"
    return asked.groupBy(key).transformWithStateInPandas(Deferral(key, calls, most, seconds * 1_000_000), kind, "append", "EventTime")
