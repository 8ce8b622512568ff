"""Queries of the quality engine: lines of documents as blocks, with everything that the rules look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators import blocks as B
from docquarry.operators import engine as Q
from docquarry.plans.registry import LINES, Tables, query


def line_blocks(t: Tables) -> DataFrame:
    """A document's first line is its root; some documents have parents that are gone, or (of three lines or more) two blocks that are each other's parent."""
    size, line = F.length("line"), F.col("line")
    first = Window.partitionBy("doc_id", F.lower(F.trim(line))).orderBy("ord")
    told = t.documents.withColumn("ring", (F.col("doc_id") % 50 == 9) & (F.regexp_count("text", F.lit("\n")) >= 2))  # b2 is there
    b = B.lines_of(told, "doc_id", "ring").withColumn("ord", F.col("ord").cast("long"))
    parent = F.when(F.col("ord") == 0, None).when((F.col("doc_id") % 40 == 7) & (F.col("ord") % 6 == 5), "gone").when(F.col("ring") & (F.col("ord") == 1), "b2").when(F.col("ring") & (F.col("ord") == 2), "b1").otherwise("b0")
    return b.select(
        "doc_id", F.col("ord").alias("block_order"), F.concat(F.lit("b"), "ord").alias("block_id"), parent.alias("parent_id"),
        F.when(F.col("ord") == 0, "document").when(size % 5 == 4, "heading").otherwise("paragraph").alias("kind"), line.alias("text"), F.floor(F.col("ord") / 8).alias("page"), (size % 4 + 1).alias("level"),
        F.when(F.col("ord") > 3, F.array(F.lit("h"))).otherwise(F.array().cast("array<string>")).alias("heading_path"), F.when(F.col("doc_id") % 3 == 0, (size % 10) / 10).alias("confidence"), (size % 9 != 0).alias("located"),
        ((F.trim(line) != "") & (F.row_number().over(first) > 1)).alias("again"),
    )


ENGINE_SQL = rf"""
WITH {LINES}, b AS (
  SELECT doc_id, ord, 'b' || ord AS block_id, line AS text, ord // 8 AS page, length(line) % 4 + 1 AS level, CASE WHEN doc_id % 3 = 0 THEN (length(line) % 10) / 10 END AS confidence, length(line) % 9 <> 0 AS located,
    CASE WHEN ord = 0 THEN NULL WHEN doc_id % 40 = 7 AND ord % 6 = 5 THEN 'gone' WHEN doc_id % 50 = 9 AND ord = 1 THEN 'b2' WHEN doc_id % 50 = 9 AND ord = 2 THEN 'b1' ELSE 'b0' END AS parent_id,
    CASE WHEN ord = 0 THEN 'document' WHEN length(line) % 5 = 4 THEN 'heading' ELSE 'paragraph' END AS kind, trim(line) <> '' AND row_number() OVER (PARTITION BY doc_id, lower(trim(line)) ORDER BY ord) > 1 AS again FROM lines),
v AS (SELECT *, kind <> 'document' AS content, kind <> 'document' AND trim(text) <> '' AS valid FROM b),
jumps AS (SELECT doc_id, count(*) FILTER (WHERE level > before + 1) AS jumps FROM (SELECT doc_id, level, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM v WHERE kind = 'heading') GROUP BY 1),
m AS (SELECT doc_id, count(*) AS blocks, count(*) FILTER (WHERE content) AS content, count(*) FILTER (WHERE valid) AS valid,
  coalesce(sum(length(text)) FILTER (WHERE valid), 0) + greatest(count(*) FILTER (WHERE valid) - 1, 0) AS chars, coalesce(sum(len(regexp_extract_all(text, '\S'))) FILTER (WHERE valid), 0) AS solid,
  coalesce(sum(len(regexp_extract_all(text, '[�□■]'))) FILTER (WHERE valid), 0) AS corrupt, coalesce(sum(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]'))) FILTER (WHERE valid), 0) AS worded,
  count(*) FILTER (WHERE content AND again) AS again, count(*) FILTER (WHERE content AND NOT located) AS unplaced, count(*) FILTER (WHERE content AND confidence < 0.5) AS unsure, count(DISTINCT page) AS pages,
  count(DISTINCT page) - count(DISTINCT page) FILTER (WHERE valid) AS empty_pages, count(*) FILTER (WHERE valid AND (ord > 3 OR kind = 'heading')) AS under, count(*) FILTER (WHERE parent_id = 'gone') AS orphans,
  CASE WHEN doc_id % 50 = 9 AND count(*) > 2 THEN 2 ELSE 0 END AS cycles FROM v GROUP BY doc_id),
r AS (SELECT m.*, coalesce(jumps, 0) AS jumps, d.source AS title, d.n_chars * 1000 AS size, greatest(content, 1) AS n, chars / (d.n_chars * 1000 / 1048576) AS per_mib, corrupt / greatest(solid, 1) AS bad, worded / greatest(solid, 1) AS dense, empty_pages / pages AS empty
  FROM m JOIN documents d USING (doc_id) LEFT JOIN jumps USING (doc_id)),
i AS (
  SELECT doc_id, 'ORPHAN_BLOCKS' AS code, 'structure' AS dimension, 'high' AS severity, orphans / blocks AS value FROM r WHERE orphans > 0
  UNION ALL SELECT doc_id, 'BLOCK_PARENT_CYCLE', 'structure', 'critical', cycles FROM r WHERE cycles > 0
  UNION ALL SELECT doc_id, 'HEADING_LEVEL_JUMP', 'structure', 'warning', jumps FROM r WHERE jumps > 0
  UNION ALL SELECT doc_id, 'NO_VALID_TEXT', 'parse', 'critical', 0 FROM r WHERE valid = 0
  UNION ALL SELECT doc_id, 'SUSPICIOUSLY_SPARSE_EXTRACTION', 'parse', 'high', per_mib FROM r WHERE valid > 0 AND size >= 1048576 AND per_mib < 100
  UNION ALL SELECT doc_id, 'HIGH_EMPTY_PAGE_RATIO', 'parse', 'high', empty FROM r WHERE empty >= 0.5
  UNION ALL SELECT doc_id, CASE WHEN bad >= 0.3 THEN 'UNRECOVERABLE_TEXT_CORRUPTION' WHEN bad >= 0.05 THEN 'HIGH_TEXT_CORRUPTION' ELSE 'TEXT_CORRUPTION_DETECTED' END, 'text', CASE WHEN bad >= 0.3 THEN 'critical' WHEN bad >= 0.05 THEN 'high' ELSE 'warning' END, bad FROM r WHERE bad > 0
  UNION ALL SELECT doc_id, CASE WHEN unsure / n >= 0.5 THEN 'OCR_CONFIDENCE_LOW' ELSE 'OCR_CONFIDENCE_WARNING' END, 'text', CASE WHEN unsure / n >= 0.5 THEN 'high' ELSE 'warning' END, unsure / n FROM r WHERE unsure > 0
  UNION ALL SELECT doc_id, CASE WHEN again / n >= 0.5 THEN 'HIGH_DUPLICATION' ELSE 'DUPLICATION_DETECTED' END, 'duplication', CASE WHEN again / n >= 0.5 THEN 'high' ELSE 'warning' END, again / n FROM r WHERE again > 0
  UNION ALL SELECT doc_id, CASE WHEN unplaced / n >= 0.3 THEN 'SOURCE_TRACEABILITY_LOW' ELSE 'SOURCE_LOCATOR_GAPS' END, 'traceability', CASE WHEN unplaced / n >= 0.3 THEN 'high' ELSE 'warning' END, unplaced / n FROM r WHERE unplaced > 0
  UNION ALL SELECT doc_id, CASE WHEN dense < 0.2 THEN 'INFORMATION_DENSITY_LOW' ELSE 'INFORMATION_DENSITY_WARNING' END, 'density', CASE WHEN dense < 0.2 THEN 'high' ELSE 'warning' END, dense FROM r WHERE valid > 0 AND dense < 0.4),
s AS (SELECT doc_id, greatest(0, least(valid / n, CASE WHEN valid > 0 AND size >= 1048576 AND per_mib < 100 THEN per_mib / 100 ELSE 1 END, CASE WHEN empty >= 0.5 THEN 1 - empty ELSE 1 END)) AS parse,
  greatest(0, least(1 - bad / 0.05, CASE WHEN unsure / n >= 0.5 THEN 1 - unsure / n ELSE 1 END)) AS text, least(1, dense / 0.4) AS density, 1 - again / n AS duplication,
  greatest(0, least(CASE WHEN cycles > 0 THEN 0 ELSE 1 END, 1 - orphans / blocks, 1 - jumps / n)) AS structure, 1 - unplaced / n AS traceability,
  CASE WHEN valid = 0 THEN 0 ELSE (CASE WHEN trim(title) <> '' THEN 1 ELSE 0.5 END + under / valid) / 2 END AS context FROM r),
t AS (SELECT *, (parse + text + density + duplication + structure + traceability + context) / 7 AS readiness FROM s),
told AS (SELECT doc_id, bool_or(severity = 'critical') AS c, bool_or(severity = 'high') AS h, bool_or(severity = 'warning') AS w, count(*) AS issues FROM i GROUP BY 1),
decided AS (SELECT t.*, coalesce(issues, 0)::BIGINT AS issues, (parse + text + density + duplication + structure + traceability + context + readiness) / 8 AS overall, least(parse, text, density, duplication, structure, traceability, context, readiness) AS worst,
  coalesce(c, false) AS c, coalesce(h, false) AS h, coalesce(w, false) AS w FROM t LEFT JOIN told USING (doc_id))
"""


def evaluated(t: Tables) -> tuple[DataFrame, DataFrame]:
    documents = t.documents.select("doc_id", F.col("source").alias("title"), (F.col("n_chars").cast("long") * 1000).alias("file_size"))
    return Q.evaluate(line_blocks(t), documents, "doc_id")


@query("quality_engine", ENGINE_SQL + """
SELECT doc_id, issues, round(overall, 6) AS overall, round(structure, 6) AS structure, round(parse, 6) AS parse,
  CASE WHEN c OR parse < 0.05 OR text < 0.2 THEN 'rejected' WHEN h OR worst < 0.5 THEN 'quarantined' WHEN w OR worst < 0.8 THEN 'warning' ELSE 'passed' END AS decision FROM decided""")
def quality_engine(t: Tables) -> DataFrame:
    return evaluated(t)[1].select("doc_id", "issues", *[F.round(c, 6).alias(c) for c in ("overall", "structure", "parse")], "decision")


@query("quality_engine_issues", ENGINE_SQL + "SELECT doc_id, code, dimension, severity, round(value::DOUBLE, 6) AS value FROM i")
def quality_engine_issues(t: Tables) -> DataFrame:
    return evaluated(t)[0].withColumn("value", F.round("value", 6))
