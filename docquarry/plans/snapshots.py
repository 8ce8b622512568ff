"""Queries of snapshot tables: upserts, deletes, publications that go through and that don't, and a stream that writes one."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.plans.registry import Tables, query
from docquarry.sources.scratch import shared_folder
from docquarry.sources.snapshots import CountMismatch, SnapshotTable
from docquarry.streaming import events as E


def orders(t: Tables) -> DataFrame:
    """Orders as versions of what is known of a customer."""
    return t.orders.select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice").cast("double"), 2).alias("price"))


def made(t: Tables, rows: DataFrame, key: list[str], version: str, buckets: int = 16) -> SnapshotTable:
    return SnapshotTable(t.spark, os.path.join(shared_folder(t.spark), f"snapshots-{uuid.uuid4().hex}"), rows.schema, key, version, buckets)


LATEST = "SELECT o_custkey AS customer, o_orderkey AS version, o_orderstatus AS status, round(o_totalprice::DOUBLE, 2) AS price FROM orders WHERE {where} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"


@query("snapshot_upsert", LATEST.format(where="true"))
def snapshot_upsert(t: Tables) -> DataFrame:
    rows = orders(t)
    table = made(t, rows, ["customer"], "version")
    for k in range(3):  # changes of several runs, in no order of versions
        table.upsert(rows.filter(F.col("version") % 3 == (k + 1) % 3))
    return table.read()


@query("snapshot_as_of", LATEST.format(where="o_orderkey % 3 <> 0"))
def snapshot_as_of(t: Tables) -> DataFrame:
    rows = orders(t)
    table = made(t, rows, ["customer"], "version")
    for k in (1, 2, 0):
        table.upsert(rows.filter(F.col("version") % 3 == k))
    return table.read(2)


@query("snapshot_statuses", """
WITH c AS (SELECT o_custkey AS customer, o_orderkey AS version, CASE WHEN o_orderstatus = 'P' THEN 'rejected' END AS bad FROM orders WHERE o_orderkey % 2 = 0), old AS (SELECT o_custkey AS customer, max(o_orderkey) AS version FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
now AS (SELECT customer, max(version) AS last FROM (SELECT customer, version FROM c WHERE bad IS NULL UNION ALL SELECT * FROM old) GROUP BY 1)
SELECT c.customer, c.version, coalesce(bad, CASE WHEN c.version = last THEN 'written' ELSE 'stale' END) AS status FROM c LEFT JOIN now USING (customer)""")
def snapshot_statuses(t: Tables) -> DataFrame:
    rows = orders(t)
    table = made(t, rows, ["customer"], "version")
    table.upsert(rows.filter("version % 2 = 1"))
    return table.upsert(rows.filter("version % 2 = 0"), F.col("status") != "P")[1].drop("retryable")


@query("snapshot_deletes", """
WITH last AS (SELECT o_custkey AS customer, max(o_orderkey) AS version FROM orders GROUP BY 1) SELECT customer, version FROM last WHERE customer NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def snapshot_deletes(t: Tables) -> DataFrame:
    rows = orders(t)
    table = made(t, rows, ["customer"], "version")
    table.upsert(rows)
    table.delete(t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("customer")))
    return table.read().select("customer", "version")


def projection(t: Tables) -> tuple[SnapshotTable, DataFrame]:
    """Lines of orders as nodes of a run: the returned ones are published first."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("document"), F.col("l_linenumber").cast("long").alias("node"), F.col("l_returnflag").alias("run"))
    nodes = lines.agg(F.round(F.max("l_quantity").cast("double"), 2).alias("tokens"))
    table = made(t, nodes, ["document", "node", "run"], "tokens")
    first = nodes.filter("run = 'R'")
    table.publish(first, first.count())
    return table, nodes


NODES = "SELECT DISTINCT l_orderkey AS document, l_linenumber::BIGINT AS node, l_returnflag AS run FROM lineitem WHERE {where}"


@query("publish_run", NODES.format(where="l_returnflag IN ('R', 'N')"))
def publish_run(t: Tables) -> DataFrame:
    """A run's nodes take the place of those of that run; other runs stay."""
    table, nodes = projection(t)
    staged = nodes.filter("run = 'N'")
    table.publish(staged, staged.count(), F.col("run") == "N")
    return table.read().select("document", "node", "run")


@query("publish_rollback", NODES.format(where="l_returnflag = 'R'"))
def publish_rollback(t: Tables) -> DataFrame:
    """A publication whose count is wrong leaves what was published before."""
    table, nodes = projection(t)
    staged = nodes.filter("run = 'N'")
    try:
        table.publish(staged, staged.count() + 1, F.col("run") == "N")
    except CountMismatch:
        return table.read().select("document", "node", "run")
    raise AssertionError("a wrong count was published")


@query("stream_snapshot", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_snapshot(t: Tables) -> DataFrame:
    """A stream of changes keeps a table: each batch rewrites the buckets it touches."""
    rows = t.events.select("user_id", "event_id", "event_type", "value")
    table = made(t, rows, ["user_id"], "event_id")
    changes = E.read(t.spark, f"{t.folder}/events.parque*", t.events.schema).select(*rows.columns)
    E.drained(changes, E.snapshot_batches(table), os.path.join(table.path, "state"))
    return table.read()
