"""Connected components of a distributed graph, by alternating stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import materialize


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Point a node's neighbours (the larger ones, or the smaller ones and itself) to the smallest of them.

    The smallest neighbour is aggregated before the join, so a node with very many neighbours is no group in memory.
    """
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = ways.join(least, "u")
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    return joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (u, v: long) that isn't the smallest of its component. No edges, no rows."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    sign = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).alias("s")
    before = None
    while True:
        mark = now.agg(sign).first()["s"]
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        now = materialize(star(star(now, True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False))
