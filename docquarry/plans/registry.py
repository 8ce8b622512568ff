"""Registered queries: a DataFrame plan and, where SQL can express it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[["Tables"], DataFrame]


class Tables:
    """The tables of a folder, each read when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table, TEXTS[name]) if name in TEXTS else table


#: Tables of texts, whose rows take much work each, and their keys.
TEXTS = {"documents": "doc_id", "pages": "page_id"}
#: Bytes of a table for each core, up to which it may be one row group in one task.
SMALL_BYTES = 8 << 20


def spread(table: DataFrame, key: str) -> DataFrame:
    """A table too small to be of many row groups, dealt to all cores by its key; a larger one as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores, key) if size < cores * SMALL_BYTES else table


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return plan

    return register


#: Lines of documents, the blocks of the test tables: document, page, order and text.
LINES = """lines AS (
  SELECT source, doc_id, unnest(range(len(l)))::BIGINT AS ord, unnest(l) AS line
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents))"""
