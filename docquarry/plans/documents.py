"""Queries over documents and their lines: text functions, block trees, cleaning, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import blocks as B
from docquarry.operators import cleaning as C
from docquarry.operators import quality as Q
from docquarry.plans.registry import LINES, Tables, query

TOKEN_SQL = r"[\x{3400}-\x{9fff}]|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
KEY_SQL = r"lower(trim(regexp_replace({0}, '[\s]+', ' ', 'g')))"


@query("token_count", rf"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN_SQL}'))::BIGINT AS tokens FROM documents")
def token_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.token_count("text").alias("tokens"))


@query("language_detect", r"""
SELECT doc_id, CASE WHEN c > 0 AND l > 0 THEN 'zh-en-mixed' WHEN c > 0 THEN 'zh' WHEN l > 0 THEN 'en' END AS language
FROM (SELECT doc_id, len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)""")
def language_detect(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.language("text").alias("language"))


@query("language_by_block", f"""
WITH {LINES}
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '[A-Za-z]'))::BIGINT AS latin_blocks, count(*) FILTER (WHERE NOT regexp_matches(line, '[A-Za-z]'))::BIGINT AS other_blocks
FROM lines GROUP BY doc_id""")
def language_by_block(t: Tables) -> DataFrame:
    found = B.lines_of(t.documents, "doc_id").withColumn("language", T.language("line"))
    return found.groupBy("doc_id").agg(F.count_if(F.col("language") == "en").alias("latin_blocks"), F.count_if(F.col("language").isNull()).alias("other_blocks"))


@query("whitespace_normalize", rf"""
WITH {LINES}
SELECT doc_id, ord, trim(regexp_replace(line, '[\t ]+', ' ', 'g')) AS line FROM lines""")
def whitespace_normalize(t: Tables) -> DataFrame:
    return B.lines_of(t.documents, "doc_id").select("doc_id", "ord", T.tidy_lines("line").alias("line"))


@query("whitespace_by_type", rf"""
WITH {LINES}
SELECT doc_id, ord, CASE WHEN ord % 3 = 0 THEN regexp_replace(line, '[\t ]+$', '') ELSE trim(regexp_replace(line, '[\t ]+', ' ', 'g')) END AS line FROM lines""")
def whitespace_by_type(t: Tables) -> DataFrame:
    kinds = B.lines_of(t.documents, "doc_id").withColumn("kind", F.when(F.col("ord") % 3 == 0, "code").otherwise("paragraph"))
    return kinds.select("doc_id", "ord", T.tidy("line", "kind").alias("line"))


@query("control_char_audit", r"""
SELECT doc_id, len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]'))::BIGINT AS removed,
  length(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'))::BIGINT AS kept FROM documents""")
def control_char_audit(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", C.keyed_count("text", T.CONTROL).alias("removed"), F.length(T.without_controls("text")).cast("long").alias("kept"))


@query("unicode_normalize", "SELECT doc_id, sha256(nfc_normalize(text)) AS normalized FROM documents")
def unicode_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(T.newlines(T.nfkc("text")), 256).alias("normalized"))


@query("sibling_links", f"""
WITH {LINES}
SELECT doc_id, ord, lag(ord) OVER w AS previous_id, lead(ord) OVER w AS next_id FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""")
def sibling_links(t: Tables) -> DataFrame:
    return B.sibling_links(B.lines_of(t.documents, "doc_id"), ["doc_id"], "ord", "ord").select("doc_id", "ord", "previous_id", "next_id")


@query("heading_path", f"""
WITH {LINES}, leveled AS (
  SELECT doc_id, ord, line, CASE WHEN length(line) % 5 < 3 THEN length(line) % 5 + 1 END AS level FROM lines
), marked AS (
  SELECT *, {", ".join(f"last_value(CASE WHEN level <= {k} THEN {{'l': level, 't': trim(line)}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h{k}" for k in (1, 2, 3))} FROM leveled
)
SELECT doc_id, ord, concat_ws(' > ', {", ".join(f"CASE WHEN h{k}.l = {k} AND h{k}.t <> '' AND (level IS NULL OR level > {k}) THEN h{k}.t END" for k in (1, 2, 3))}) AS path FROM marked""")
def heading_path(t: Tables) -> DataFrame:
    leveled = B.lines_of(t.documents, "doc_id").withColumn("level", F.when(F.length("line") % 5 < 3, F.length("line") % 5 + 1))
    out = B.heading_paths(leveled, "doc_id", "ord", "level", "line")
    return out.select("doc_id", "ord", F.array_join("heading_path", " > ").alias("path"))


@query("exact_dup_blocks", f"""
WITH {LINES}, keyed AS (SELECT *, {KEY_SQL.format("line")} AS key FROM lines)
SELECT doc_id, ord, CASE WHEN key <> '' AND row_number() OVER w > 1 THEN first_value(ord) OVER w END AS duplicate_of FROM keyed WINDOW w AS (PARTITION BY doc_id, key ORDER BY ord)""")
def exact_dup_blocks(t: Tables) -> DataFrame:
    return C.exact_duplicates(B.lines_of(t.documents, "doc_id"), ["doc_id"], "ord", "line", "ord").select("doc_id", "ord", "duplicate_of")


@query("exact_dup_documents", """
SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS copies, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_id FROM documents""")
def exact_dup_documents(t: Tables) -> DataFrame:
    keyed = t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))
    return keyed.join(keyed.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")), "digest")


@query("boilerplate_keys", f"""
WITH {LINES}, keyed AS (SELECT *, {KEY_SQL.format("line")} AS key FROM lines), edges AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY ord) AS a, row_number() OVER (PARTITION BY source, doc_id ORDER BY ord DESC) AS z FROM keyed WHERE key <> ''
), pages AS (SELECT source, count(DISTINCT doc_id) AS page_count FROM keyed WHERE key <> '' GROUP BY source)
SELECT source, key, count(DISTINCT doc_id) AS pages, any_value(page_count) AS page_count FROM edges JOIN pages USING (source)
WHERE (a <= 2 OR z <= 2) AND length(key) <= 200 AND page_count >= 3 GROUP BY source, key HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.05 * any_value(page_count)""")
def boilerplate_keys(t: Tables) -> DataFrame:
    return C.boilerplate_keys(B.lines_of(t.documents, "source", "doc_id"), "source", "doc_id", "ord", "line", ratio=0.05)


@query("boilerplate_lines", f"""
WITH {LINES}, keyed AS (SELECT *, {KEY_SQL.format("line")} AS key FROM lines), edges AS (
  SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY ord) AS a, row_number() OVER (PARTITION BY source, doc_id ORDER BY ord DESC) AS z FROM keyed WHERE key <> ''
), pages AS (SELECT source, count(DISTINCT doc_id) AS page_count FROM keyed WHERE key <> '' GROUP BY source), boiler AS (
  SELECT source, key FROM edges JOIN pages USING (source)
  WHERE (a <= 2 OR z <= 2) AND length(key) <= 200 AND page_count >= 3 GROUP BY source, key HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.05 * any_value(page_count))
SELECT k.doc_id, k.ord FROM keyed k LEFT JOIN edges e USING (doc_id, ord) LEFT JOIN boiler b ON k.source = b.source AND k.key = b.key
WHERE NOT (b.key IS NOT NULL AND (e.a <= 2 OR e.z <= 2) IS TRUE)""")
def boilerplate_lines(t: Tables) -> DataFrame:
    return C.remove_boilerplate(B.lines_of(t.documents, "source", "doc_id"), "source", "doc_id", "ord", "line", ratio=0.05).select("doc_id", "ord")


@query("empty_block_removal", f"WITH {LINES} SELECT doc_id, count(*)::BIGINT AS blocks FROM lines WHERE trim(line) <> '' GROUP BY doc_id")
def empty_block_removal(t: Tables) -> DataFrame:
    tree = B.lines_of(t.documents, "doc_id").select("doc_id", F.concat_ws(":", "doc_id", "ord").alias("id"), F.lit(None).cast("string").alias("parent_id"), "line", F.lit("paragraph").alias("kind"))
    return C.remove_empty(tree, "id", "parent_id", "line", "kind").groupBy("doc_id").agg(F.count("*").alias("blocks"))


@query("reading_order", """
WITH ranked AS (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_extendedprice, l_linenumber) AS rank FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS new_order FROM ranked a JOIN ranked b ON a.l_orderkey = b.l_orderkey AND a.rank = b.place""")
def reading_order(t: Tables) -> DataFrame:
    items = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return C.reading_order(items, ["l_orderkey"], "l_linenumber", ["l_shipdate", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "new_order")


@query("cleaning_compare", rf"""
WITH {LINES}, b AS (SELECT doc_id, ord, trim(regexp_replace(line, '[\t ]+', ' ', 'g')) AS line FROM lines WHERE length(line) >= 40)
SELECT CASE WHEN b.ord IS NULL THEN 'removed' WHEN a.line = b.line THEN 'same' ELSE 'changed' END AS change, count(*)::BIGINT AS blocks
FROM lines a LEFT JOIN b USING (doc_id, ord) GROUP BY 1""")
def cleaning_compare(t: Tables) -> DataFrame:
    before = B.lines_of(t.documents, "doc_id")
    after = before.filter(F.length("line") >= 40).withColumn("line", T.tidy_lines("line"))
    return C.audit(before, after, ["doc_id", "ord"], "line").groupBy("change").agg(F.count("*").alias("blocks"))


@query("cleaning_pipeline")
def cleaning_pipeline(t: Tables) -> DataFrame:
    steps = [
        ("newlines", lambda b: b.withColumn("line", T.newlines("line"))),
        ("controls", lambda b: b.withColumn("line", T.without_controls("line"))),
        ("white-space", lambda b: b.withColumn("line", T.tidy_lines("line"))),
        ("boilerplate", lambda b: C.remove_boilerplate(b, "source", "doc_id", "ord", "line", ratio=0.05)),
        ("empty", lambda b: b.filter("line <> ''")),
    ]
    return C.pipeline(B.lines_of(t.documents, "source", "doc_id"), steps, ["doc_id", "ord"], "line")[1]


@query("near_dup_pairs")
def near_dup_pairs(t: Tables) -> DataFrame:
    return C.near_duplicate_pairs(B.lines_of(t.documents, "doc_id"), "doc_id", "ord", "line")


@query("tree_validation", """
WITH nodes AS (
  SELECT 'root' AS id, NULL AS parent UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || (s_nationkey + 1) FROM supplier)
SELECT count(*)::BIGINT AS nodes, count(*) FILTER (WHERE parent IS NULL)::BIGINT AS roots,
  (SELECT count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1))::BIGINT AS duplicate_ids,
  count(*) FILTER (WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM nodes))::BIGINT AS orphans,
  1 - count(*) FILTER (WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM nodes)) / count(*)::DOUBLE AS score FROM nodes""")
def tree_validation(t: Tables) -> DataFrame:
    root = t.region.sparkSession.createDataFrame([("root", None)], "id string, parent string")
    nodes = (
        root.unionByName(t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent")))
        .unionByName(t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))
        .unionByName(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), F.col("s_nationkey") + 1).alias("parent")))
    )
    return B.validate_tree(nodes, "id", "parent")


@query("cycle_check", """
WITH RECURSIVE ups AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 7 = 3 THEN p_partkey + 1 ELSE p_partkey - 1 END AS up FROM part
), known AS (SELECT id, CASE WHEN up IN (SELECT id FROM ups) THEN up END AS up FROM ups
), walk(id, node, depth) AS (SELECT id, up, 1 FROM known UNION ALL SELECT w.id, k.up, depth + 1 FROM walk w JOIN known k ON w.node = k.id WHERE depth < 60 AND w.node IS NOT NULL)
SELECT id AS p_partkey FROM walk WHERE depth = 60 AND node IS NOT NULL""")
def cycle_check(t: Tables) -> DataFrame:
    up = F.when(F.col("p_partkey") % 10 == 0, None).when(F.col("p_partkey") % 7 == 3, F.col("p_partkey") + 1).otherwise(F.col("p_partkey") - 1)
    return B.cycle_nodes(t.part.select("p_partkey", up.alias("up")), "p_partkey", "up")


METRICS_SQL = rf"""
WITH {LINES}, keyed AS (SELECT *, {KEY_SQL.format("line")} AS key FROM lines), marked AS (
  SELECT *, key <> '' AND row_number() OVER (PARTITION BY doc_id, key ORDER BY ord) > 1 AS again FROM keyed
), counted AS (
  SELECT doc_id, count(*)::BIGINT AS blocks, count(*) FILTER (WHERE key <> '')::BIGINT AS valid_blocks, count(*) FILTER (WHERE again)::BIGINT AS duplicate_blocks,
    sum(length(line))::BIGINT AS chars, sum(len(regexp_extract_all(line, '\S')))::BIGINT AS solid,
    sum(len(regexp_extract_all(line, '[\x{{fffd}}\x{{25a1}}\x{{25a0}}]')))::BIGINT AS corrupt, sum(len(regexp_extract_all(line, '[\p{{L}}\p{{N}}_]')))::BIGINT AS worded
  FROM marked GROUP BY doc_id
), measured AS (
  SELECT *, valid_blocks / greatest(blocks, 1) AS parse_ratio, corrupt / greatest(solid, 1) AS corrupt_ratio, duplicate_blocks / greatest(valid_blocks, 1) AS duplicate_ratio, worded / greatest(solid, 1) AS density FROM counted
), scored AS (
  SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, parse_ratio)) AS parse, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - corrupt_ratio / 0.05::DOUBLE)) AS text_score,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, density / 0.40::DOUBLE)) AS density_score, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - duplicate_ratio)) AS duplication FROM measured
), ready AS (
  SELECT *, least((parse + text_score + density_score + duplication + 1.0::DOUBLE + 1.0::DOUBLE + 1.0::DOUBLE) / 7, CASE WHEN valid_blocks > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS readiness FROM scored
), overall AS (
  SELECT *, (parse + text_score + density_score + duplication + 1.0::DOUBLE + 1.0::DOUBLE + 1.0::DOUBLE + readiness) / 8 AS overall, least(parse, text_score, density_score, duplication, readiness) AS worst,
    valid_blocks = 0 OR corrupt_ratio >= 0.30 AS critical, (corrupt_ratio >= 0.05 AND corrupt_ratio < 0.30) OR duplicate_ratio >= 0.5 OR density < 0.20 AS high,
    corrupt > 0 OR duplicate_blocks > 0 OR density < 0.40 AS warning FROM ready
), decided AS (
  SELECT *, CASE WHEN critical OR parse < 0.05 OR text_score < 0.20 THEN 'rejected' WHEN high OR worst < 0.5 THEN 'quarantined' WHEN warning OR worst < 0.8 THEN 'warning' ELSE 'passed' END AS decision FROM overall)
"""


def decisions(t: Tables) -> DataFrame:
    return Q.decide(Q.dimensions(Q.metrics(B.lines_of(t.documents, "doc_id"), ["doc_id"], "ord", "line")))


@query("quality_metrics", METRICS_SQL + "SELECT doc_id, blocks, valid_blocks, duplicate_blocks, chars, solid, corrupt, worded, round(duplicate_ratio, 6) AS duplicate_ratio, round(density, 6) AS density FROM decided")
def quality_metrics(t: Tables) -> DataFrame:
    m = Q.metrics(B.lines_of(t.documents, "doc_id"), ["doc_id"], "ord", "line")
    return m.select("doc_id", "blocks", "valid_blocks", "duplicate_blocks", F.col("chars").cast("long").alias("chars"), "solid", "corrupt", "worded", F.round("duplicate_ratio", 6).alias("duplicate_ratio"), F.round("density", 6).alias("density"))


@query("quality_dimensions", METRICS_SQL + """SELECT doc_id, dimension, round(score, 6) AS score FROM (
  SELECT doc_id, unnest(['parse', 'text', 'density_score', 'duplication', 'structure', 'traceability', 'context', 'readiness']) AS dimension,
    unnest([parse, text_score, density_score, duplication, 1.0, 1.0, 1.0, readiness]) AS score FROM decided)""")
def quality_dimensions(t: Tables) -> DataFrame:
    return Q.long_form(decisions(t), ["doc_id"]).withColumn("score", F.round("score", 6))


@query("quality_decision", METRICS_SQL + "SELECT doc_id, decision, round(overall, 6) AS overall FROM decided")
def quality_decision(t: Tables) -> DataFrame:
    return decisions(t).select("doc_id", "decision", F.round("overall", 6).alias("overall"))


@query("quality_issues", METRICS_SQL + """
SELECT doc_id, 'NO_VALID_TEXT' AS code, 'critical' AS severity, 0.0::DOUBLE AS value FROM decided WHERE valid_blocks = 0
UNION ALL SELECT doc_id, 'TEXT_CORRUPTION', CASE WHEN corrupt_ratio >= 0.3 THEN 'critical' WHEN corrupt_ratio >= 0.05 THEN 'high' ELSE 'warning' END, round(corrupt_ratio, 6) FROM decided WHERE corrupt > 0
UNION ALL SELECT doc_id, 'DUPLICATE_BLOCKS', CASE WHEN duplicate_ratio >= 0.5 THEN 'high' ELSE 'warning' END, round(duplicate_ratio, 6) FROM decided WHERE duplicate_blocks > 0
UNION ALL SELECT doc_id, 'LOW_INFORMATION_DENSITY', CASE WHEN density < 0.2 THEN 'high' ELSE 'warning' END, round(density, 6) FROM decided WHERE density < 0.4""")
def quality_issues(t: Tables) -> DataFrame:
    return Q.issues(decisions(t), ["doc_id"]).withColumn("value", F.round("value", 6))


@query("quality_vs_labels", METRICS_SQL + """
SELECT count(*) FILTER (WHERE decision IN ('passed', 'warning') AND quality = 1)::BIGINT AS kept_good, count(*) FILTER (WHERE decision IN ('passed', 'warning') AND quality = 0)::BIGINT AS kept_bad,
  count(*) FILTER (WHERE decision NOT IN ('passed', 'warning') AND quality = 1)::BIGINT AS lost_good, count(*) FILTER (WHERE decision NOT IN ('passed', 'warning') AND quality = 0)::BIGINT AS lost_bad
FROM decided JOIN labels USING (doc_id)""")
def quality_vs_labels(t: Tables) -> DataFrame:
    kept = F.col("decision").isin("passed", "warning")
    return decisions(t).join(t.labels, "doc_id").agg(
        F.count_if(kept & (F.col("quality") == 1)).alias("kept_good"), F.count_if(kept & (F.col("quality") == 0)).alias("kept_bad"),
        F.count_if(~kept & (F.col("quality") == 1)).alias("lost_good"), F.count_if(~kept & (F.col("quality") == 0)).alias("lost_bad"),
    )


@query("heading_jumps", f"""
WITH {LINES}, heads AS (SELECT doc_id, ord, length(line) % 5 + 1 AS level FROM lines WHERE length(line) % 5 < 4), before AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS b FROM heads)
SELECT doc_id, count(*)::BIGINT AS headings, count(*) FILTER (WHERE level > b + 1)::BIGINT AS jumps FROM before GROUP BY doc_id""")
def heading_jumps(t: Tables) -> DataFrame:
    leveled = B.lines_of(t.documents, "doc_id").withColumn("level", F.when(F.length("line") % 5 < 4, F.length("line") % 5 + 1))
    return Q.heading_jumps(leveled, ["doc_id"], "ord", "level")


@query("documents_by_source", """
SELECT source, lang, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY source, lang""")
def documents_by_source(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("document_versions", """
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version_number, doc_id = max(doc_id) OVER (PARTITION BY source) AS is_current FROM documents""")
def document_versions(t: Tables) -> DataFrame:
    w = Window.partitionBy("source")
    return t.documents.select("source", "doc_id", F.row_number().over(w.orderBy("doc_id")).cast("long").alias("version_number"), (F.col("doc_id") == F.max("doc_id").over(w)).alias("is_current"))


@query("locator_completeness", f"""
WITH {LINES} SELECT doc_id, count(*) FILTER (WHERE ord % 4 <> 0)::BIGINT AS complete, count(*) FILTER (WHERE ord % 4 = 0)::BIGINT AS incomplete FROM lines GROUP BY doc_id""")
def locator_completeness(t: Tables) -> DataFrame:
    spot = F.when(F.col("ord") % 4 != 0, F.col("ord") + 1)
    none = F.lit(None).cast("long")
    locator = F.array(F.struct(*[none.alias(n) for n in ("page_number", "slide_number", "paragraph_index")], F.lit(None).cast("string").alias("cell_range"), F.lit(None).cast("string").alias("dom_path"), spot.alias("line_start")))
    marked = C.locator_gaps(B.lines_of(t.documents, "doc_id").withColumn("source_type", F.lit("text")).withColumn("source_locators", locator))
    return marked.groupBy("doc_id").agg(F.count_if("locator_complete").alias("complete"), F.count_if(~F.col("locator_complete")).alias("incomplete"))
