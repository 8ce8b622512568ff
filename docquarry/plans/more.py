"""Queries of query planning, signals, projections, page and locator scores, structure repair, decoders and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import blocks as B
from docquarry.operators import decoders as D
from docquarry.operators import evaluation as E
from docquarry.operators import graph as G
from docquarry.operators import planning as P
from docquarry.operators import quality as Q
from docquarry.operators import state as R
from docquarry.plans.registry import LINES, Tables, query


@query("query_status", "SELECT doc_id, CASE WHEN n = 0 THEN 'QUERY_EMPTY' WHEN n > 2000 THEN 'QUERY_TOO_LONG' ELSE 'ok' END AS status FROM (SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents)")
def query_status(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", P.query_status(T.collapse("text")).alias("status"))


@query("search_variants", """
WITH q AS (SELECT conv_id, turn, [trim(text), trim(lower(text)), trim(split_part(text, '.', 1)), trim(text) || ' ' || role] AS l FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '|') AS variants FROM q""")
def search_variants(t: Tables) -> DataFrame:
    """Of whole turns: as they are, in small letters, and up to the first full stop."""
    own = P.search_variants(F.trim("text"), F.array(F.lower(F.trim("text")), F.split_part("text", F.lit("."), F.lit(1))), F.array("role"))
    return t.conversations.select("conv_id", "turn", F.array_join(own, "|").alias("variants"))


@query("query_plans")
def query_plans(t: Tables) -> DataFrame:
    """Answers as a model might give them: the properties of events as JSON, and texts that are none."""
    answer = F.when(F.col("item_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("standalone_query"), F.array(F.lit("A"), F.lit("a "), F.lit("b")).alias("entities")))).otherwise(F.col("text"))
    return t.benchmark.select("item_id", P.parse_plan("text", answer).alias("p")).select("item_id", "p.changed", "p.degraded", F.size("p.entities").alias("entities"))


@query("merge_signals", """
WITH h AS (SELECT l_orderkey, l_returnflag, CASE WHEN l_quantity > 10 THEN l_linenumber END AS br, l_extendedprice AS bs, CASE WHEN l_quantity < 40 THEN l_linenumber * 2 END AS dr, l_tax AS ds FROM lineitem)
SELECT l_orderkey, l_returnflag, min(br) AS bm25_rank, min({'r': br, 's': bs}) FILTER (WHERE br IS NOT NULL).s AS bm25_score, min(dr) AS dense_rank, min({'r': dr, 's': ds}) FILTER (WHERE dr IS NOT NULL).s AS dense_score, count(*)::BIGINT AS merged FROM h GROUP BY ALL""".replace("min({'r': br, 's': bs}) FILTER (WHERE br IS NOT NULL).s", "(min({'r': br, 's': bs}) FILTER (WHERE br IS NOT NULL)).s").replace("min({'r': dr, 's': ds}) FILTER (WHERE dr IS NOT NULL).s", "(min({'r': dr, 's': ds}) FILTER (WHERE dr IS NOT NULL)).s"))
def merge_signals(t: Tables) -> DataFrame:
    h = t.lineitem.select(
        "l_orderkey", "l_returnflag", F.when(F.col("l_quantity") > 10, F.col("l_linenumber")).alias("bm25_rank"), F.col("l_extendedprice").alias("bm25_score"),
        F.when(F.col("l_quantity") < 40, F.col("l_linenumber") * 2).alias("dense_rank"), F.col("l_tax").alias("dense_score"),
    )
    return P.merge_signals(h, ["l_orderkey", "l_returnflag"], ["bm25", "dense"])


@query("scope_match", r"""
WITH e AS (SELECT p_partkey, [lower(regexp_replace(p_brand, '[^\p{L}\p{N}_]+', '', 'g')), lower(regexp_replace(split_part(p_type, ' ', 1), '[^\p{L}\p{N}_]+', '', 'g')), 'zzz'] AS l, lower(regexp_replace(p_name || p_brand || p_type, '[^\p{L}\p{N}_]+', '', 'g')) AS s FROM part)
SELECT p_partkey, round(len(list_filter(l, lambda x: x <> '' AND contains(s, x))) / len(list_filter(l, lambda x: x <> '')), 6) AS scope FROM e""")
def scope_match(t: Tables) -> DataFrame:
    entities = F.array("p_brand", F.split("p_type", " ")[0], F.lit("zzz"))
    return t.part.select("p_partkey", F.round(P.scope_match(entities, F.col("p_name"), F.array("p_brand", "p_type")), 6).alias("scope"))


@query("empty_pages", f"""
WITH {LINES}, p AS (SELECT source, doc_id, max(CASE WHEN length(line) > 60 THEN 1 ELSE 0 END) AS f FROM lines GROUP BY ALL)
SELECT source, count(*)::BIGINT AS pages, count(*) FILTER (WHERE f = 0)::BIGINT AS empty_pages, count(*) FILTER (WHERE f = 0) / count(*) >= 0.5 AS empty_high FROM p GROUP BY source""")
def empty_pages(t: Tables) -> DataFrame:
    lines = B.lines_of(t.documents, "source", "doc_id").withColumn("line", F.when(F.length("line") > 60, F.col("line")))
    return Q.page_scores(lines, ["source"], "doc_id", "line")


@query("ocr_confidence", """
WITH c AS (SELECT l_orderkey, CASE WHEN l_linenumber % 4 > 0 THEN l_discount * 10 END AS c FROM lineitem), s AS (SELECT l_orderkey, count(c) AS measured, count(*) FILTER (WHERE c < 0.5)::BIGINT AS low FROM c GROUP BY 1)
SELECT *, CASE WHEN low > 0 AND low / greatest(measured, 1) >= 0.5 THEN 'high' WHEN low > 0 THEN 'warning' END AS severity FROM s""")
def ocr_confidence(t: Tables) -> DataFrame:
    return Q.ocr_scores(t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") % 4 > 0, F.col("l_discount") * 10).alias("c")), ["l_orderkey"], "c")


@query("source_traceability", f"""
WITH {LINES}, s AS (SELECT doc_id, count(*)::BIGINT AS blocks, count(*) FILTER (WHERE length(line) % 6 = 0)::BIGINT AS missing FROM lines GROUP BY 1)
SELECT *, round(1 - missing / greatest(blocks, 1), 6) AS score, CASE WHEN missing / greatest(blocks, 1) >= 0.3 THEN 'high' WHEN missing > 0 THEN 'warning' END AS severity FROM s""")
def source_traceability(t: Tables) -> DataFrame:
    return Q.traceability(B.lines_of(t.documents, "doc_id").select("doc_id", (F.length("line") % 6 != 0).alias("located")), ["doc_id"], "located")


@query("context_scores", f"""
WITH {LINES}, s AS (SELECT doc_id, count(*) AS valid, count(*) FILTER (WHERE ord > 1) AS contextual FROM lines WHERE line <> '' GROUP BY 1)
SELECT doc_id, round((CASE WHEN doc_id % 3 > 0 THEN 1.0 ELSE 0.5 END + contextual / greatest(valid, 1)) / 2, 6) AS score FROM s""")
def context_scores(t: Tables) -> DataFrame:
    s = B.lines_of(t.documents, "doc_id").filter("line <> ''").groupBy("doc_id").agg(F.count("*").alias("valid"), F.count_if(F.col("ord") > 1).alias("contextual"))
    return s.select("doc_id", F.round(Q.context_score(F.when(F.col("doc_id") % 3 > 0, "t").otherwise(""), F.col("contextual"), F.col("valid")), 6).alias("score"))


@query("merged_dimensions", """
WITH s AS (SELECT doc_id, 'text' AS dimension, quality * 0.5 AS score FROM labels UNION ALL SELECT doc_id, 'text', 1 - toxic * 0.9 FROM labels UNION ALL SELECT doc_id, 'parse', 0.75 FROM labels WHERE quality = 1)
SELECT doc_id, dimension, round(CASE WHEN dimension = 'readiness' THEN least(score, avg(score) FILTER (WHERE dimension <> 'readiness') OVER (PARTITION BY doc_id)) ELSE score END, 6) AS score FROM (
SELECT l.doc_id, d.dimension, coalesce(min(s.score), 1.0)::DOUBLE AS score FROM (SELECT DISTINCT doc_id FROM labels) l, (SELECT unnest(['parse', 'text', 'density', 'duplication', 'structure', 'traceability', 'context', 'readiness']) AS dimension) d
LEFT JOIN s ON s.doc_id = l.doc_id AND s.dimension = d.dimension GROUP BY ALL)""")
def merged_dimensions(t: Tables) -> DataFrame:
    def of(name: str, score) -> DataFrame:  # noqa: ANN001
        return t.labels.select("doc_id", F.lit(name).alias("dimension"), score.cast("double").alias("score"))

    scores = of("text", F.col("quality") * 0.5).unionByName(of("text", 1 - F.col("toxic") * 0.9)).unionByName(of("parse", F.when(F.col("quality") == 1, 0.75)).filter("score IS NOT NULL"))
    return Q.merge_dimensions(scores, ["doc_id"]).withColumn("score", F.round("score", 6))


@query("structure_repair", f"""
WITH {LINES}, b AS (SELECT doc_id, ord, CASE WHEN ord = 0 THEN NULL WHEN ord % 3 = 0 THEN ord + 1000000 ELSE ord - ord % 3 END AS up FROM lines WHERE ord % 7 <> 6),
m AS (SELECT b.doc_id, b.ord, CASE WHEN b.ord = 0 THEN NULL WHEN p.ord IS NULL THEN 0 ELSE b.up END AS up FROM b LEFT JOIN b p ON b.doc_id = p.doc_id AND b.up = p.ord),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS new_order FROM m)
SELECT doc_id, ord, up, new_order, lag(ord) OVER w AS previous_id, lead(ord) OVER w AS next_id FROM n WINDOW w AS (PARTITION BY doc_id, up ORDER BY new_order)""")
def structure_repair(t: Tables) -> DataFrame:
    b = B.lines_of(t.documents, "doc_id").filter("ord % 7 <> 6").select("doc_id", "ord", F.when(F.col("ord") == 0, None).when(F.col("ord") % 3 == 0, F.col("ord") + 1000000).otherwise(F.col("ord") - F.col("ord") % 3).alias("up"), F.lit(0).cast("long").alias("root"))
    return B.repair(b, "doc_id", "ord", "up", "ord", "root").drop("root")


@query("layout_decoding")
def layout_decoding(t: Tables) -> DataFrame:
    """Documents as a service's answer: pages of items, every third one a table."""
    row = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.when(i % 3 == 2, "table").otherwise("text").alias("type"), x.alias("text"), F.when(i == 0, 1).alias("text_level"), F.floor(i / 5).alias("page_idx")))
    return D.decode(t.documents.select("doc_id", F.to_json(row).alias("c")), "doc_id", "c").groupBy("doc_id", "type").agg(F.count("*").alias("items"), F.max("page_idx").alias("last_page"))


@query("graph_evidence_upsert", """
WITH e AS (SELECT l_orderkey AS fact_id, l_returnflag AS version, l_linenumber AS node_id, l_comment AS excerpt, n FROM (SELECT *, l_shipdate::DATE::VARCHAR AS l_comment, l_quantity::INT % 2 AS n FROM lineitem))
SELECT fact_id, version, node_id, excerpt FROM e QUALIFY row_number() OVER (PARTITION BY fact_id, version, node_id ORDER BY n DESC, excerpt) = 1""")
def graph_evidence_upsert(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_orderkey").alias("fact_id"), F.col("l_returnflag").alias("version"), F.col("l_linenumber").alias("node_id"), F.to_date("l_shipdate").cast("string").alias("excerpt"), (F.col("l_quantity").cast("int") % 2).alias("n"))
    return G.upsert_evidence(e.filter("n = 0").drop("n"), e.filter("n = 1").drop("n"))


@query("graph_build_gate", """
WITH o AS (SELECT l_suppkey, l_discount < 0.09 AS succeeded, l_linenumber AS candidates, CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE l_linenumber // 2 END AS accepted FROM lineitem),
s AS (SELECT l_suppkey, count(*)::BIGINT AS parents, count(*) FILTER (WHERE NOT succeeded)::BIGINT AS failed, sum(candidates)::BIGINT AS candidates, sum(accepted)::BIGINT AS accepted FROM o GROUP BY 1)
SELECT *, CASE WHEN failed = parents OR failed / parents > 0.2 THEN 'too_many_failures' WHEN candidates > 0 AND accepted = 0 THEN 'all_rejected' ELSE 'ok' END AS verdict FROM s""")
def graph_build_gate(t: Tables) -> DataFrame:
    o = t.lineitem.select("l_suppkey", (F.col("l_discount") < 0.09).alias("succeeded"), F.col("l_linenumber").alias("candidates"), F.when(F.col("l_suppkey") % 10 == 0, 0).otherwise(F.floor(F.col("l_linenumber") / 2)).alias("accepted"))
    return G.build_gate(o, ["l_suppkey"])


@query("graph_gain", """
SELECT user_id, count(*) FILTER (WHERE value > 50 AND event_id % 3 > 0)::BIGINT AS gained, count(*) FILTER (WHERE value <= 50 AND event_id % 3 = 0)::BIGINT AS lost FROM events GROUP BY user_id""")
def graph_gain(t: Tables) -> DataFrame:
    """Samples that a second run of retrieval found and the first did not, and the other way round: by a join of the two runs."""
    a = t.events.select("user_id", "event_id", (F.col("value") > 50).alias("with_graph"))
    b = t.events.select("event_id", (F.col("event_id") % 3 == 0).alias("without"))
    both = a.join(b, "event_id")
    return both.groupBy("user_id").agg(F.count_if(F.col("with_graph") & ~F.col("without")).alias("gained"), F.count_if(~F.col("with_graph") & F.col("without")).alias("lost"))


@query("evaluation_rollup", """
SELECT count(*)::BIGINT AS samples, count(*) FILTER (WHERE event_type = 'error' OR value < 20)::BIGINT AS failures, round(coalesce(sum(value), 0), 6) AS cost_usd FROM events""")
def evaluation_rollup(t: Tables) -> DataFrame:
    return E.run_rollup(t.events.select(F.when(F.col("event_type") == "error", "e").alias("error"), (F.col("value") >= 20).cast("double").alias("hit_at_10"), F.col("value").alias("cost_usd")))


@query("answer_checks", r"""
SELECT conv_id, turn, CASE WHEN regexp_replace(expected, '[^\p{L}\p{N}_]+', '', 'g') = '' THEN 0.0 ELSE
  contains(lower(regexp_replace(text, '[^\p{L}\p{N}_]+', '', 'g')), lower(regexp_replace(expected, '[^\p{L}\p{N}_]+', '', 'g')))::INT::DOUBLE END AS held, CASE WHEN (turn % 2 = 0) <> (role = 'user') THEN 1.0 ELSE 0.0 END::DOUBLE AS refusal
FROM (SELECT *, CASE WHEN turn % 5 = 4 THEN ' .' ELSE regexp_extract(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '[\p{L}\p{N}_]+') END AS expected FROM conversations)""")
def answer_checks(t: Tables) -> DataFrame:
    refusal = E.refusal_accuracy(F.col("turn") % 2 == 0, F.col("role") == "user")
    # What is expected of a turn is the first word of the one before; of some, nothing but signs.
    before = F.regexp_extract(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), r"[\p{L}\p{N}_]+", 0)
    given = t.conversations.withColumn("expected", F.when(F.col("turn") % 5 == 4, " .").otherwise(before))
    return given.select("conv_id", "turn", E.answer_contains("text", "expected").alias("held"), refusal.cast("double").alias("refusal"))


@query("retry_backoff", "SELECT event_id, round(least(60.0::DOUBLE, 2.0::DOUBLE * pow(2.0, event_id % 8) * (0.5::DOUBLE + value / 1000)), 6) AS wait FROM events")
def retry_backoff(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(R.backoff(F.col("event_id") % 8, 2.0, 60.0, F.col("value") / 1000), 6).alias("wait"))
