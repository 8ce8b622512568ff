"""Queries of the graph, of runs, versions and jobs, and of events; and extensions: grouping sets, pivots, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import graph as G
from docquarry.operators import search as S
from docquarry.operators import state as R
from docquarry.plans.registry import Tables, query

FACTS = """facts AS (
  SELECT 'n' || n_nationkey AS subject, 'IN_REGION' AS predicate, 'r' || n_regionkey AS object, 0.9::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'BASED_IN', 'n' || s_nationkey, 0.5::DOUBLE + (s_suppkey % 50) / 100 FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'LIVES_IN', 'n' || c_nationkey, 0.5::DOUBLE + (c_custkey % 50) / 100 FROM customer)"""


def facts(t: Tables) -> DataFrame:
    def of(df: DataFrame, s: str, key: str, predicate: str, o: str, to: str, confidence) -> DataFrame:  # noqa: ANN001
        return df.select(F.concat(F.lit(s), key).alias("subject"), F.lit(predicate).alias("predicate"), F.concat(F.lit(o), to).alias("object"), confidence.cast("double").alias("confidence"))

    return (
        of(t.nation, "n", "n_nationkey", "IN_REGION", "r", "n_regionkey", F.lit(0.9))
        .unionByName(of(t.supplier, "s", "s_suppkey", "BASED_IN", "n", "s_nationkey", 0.5 + (F.col("s_suppkey") % 50) / 100))
        .unionByName(of(t.customer, "c", "c_custkey", "LIVES_IN", "n", "c_nationkey", 0.5 + (F.col("c_custkey") % 50) / 100))
    )


@query("graph_neighborhood", f"""
WITH {FACTS}, centers AS (SELECT DISTINCT 'n' || n_nationkey AS center FROM nation)
SELECT center, object AS neighbor, 'out' AS direction, predicate FROM facts JOIN centers ON subject = center
UNION ALL SELECT center, subject, 'in', predicate FROM facts JOIN centers ON object = center WHERE subject <> object""")
def graph_neighborhood(t: Tables) -> DataFrame:
    return G.neighborhood(facts(t), t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id")))


@query("graph_paths", f"""
WITH RECURSIVE {FACTS}, walk(start, target, hops, path, nodes) AS (
  SELECT subject, object, 1, subject || '>' || object, [subject, object] FROM facts WHERE starts_with(subject, 's') OR starts_with(subject, 'c')
  UNION ALL SELECT w.start, f.object, hops + 1, path || '>' || f.object, list_append(nodes, f.object) FROM walk w JOIN facts f ON w.target = f.subject WHERE hops < 3 AND NOT list_contains(nodes, f.object))
SELECT start, target, hops::BIGINT AS hops, path FROM walk""")
def graph_paths(t: Tables) -> DataFrame:
    starts = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id")).unionByName(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("entity_id")))
    return G.paths(facts(t), starts)


@query("graph_schema_filter", f"""
WITH {FACTS}, typed AS (SELECT *, left(subject, 1) AS subject_type, left(object, 1) AS object_type FROM facts)
SELECT subject, predicate, object, (subject_type, predicate, object_type) IN (('n', 'IN_REGION', 'r'), ('s', 'BASED_IN', 'n')) AS accepted FROM typed""")
def graph_schema_filter(t: Tables) -> DataFrame:
    typed = facts(t).withColumn("subject_type", F.left("subject", F.lit(1))).withColumn("object_type", F.left("object", F.lit(1)))
    schema = t.spark.createDataFrame([("n", "IN_REGION", "r"), ("s", "BASED_IN", "n")], "subject_type string, predicate string, object_type string")
    good, bad = G.permitted(typed, schema)
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False))).select("subject", "predicate", "object", "accepted")


KNOWN = f"""{FACTS}, known AS (SELECT subject, predicate, object, confidence, CASE WHEN length(subject) % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS review_status, length(subject) % 4 = 0 AS manual_lock, length(subject) % 2 = 0 AS active FROM facts WHERE NOT ends_with(subject, '7')),
fresh AS (SELECT subject, predicate, object, max(confidence + 0.05::DOUBLE) AS c FROM facts WHERE NOT ends_with(subject, '3') GROUP BY ALL)"""


def known_facts(t: Tables) -> tuple[DataFrame, DataFrame]:
    n = F.length("subject")
    known = facts(t).filter("NOT endswith(subject, '7')").withColumns({"review_status": F.when(n % 3 == 0, "rejected").otherwise("accepted"), "manual_lock": n % 4 == 0, "active": n % 2 == 0})
    return known, facts(t).filter("NOT endswith(subject, '3')").withColumn("confidence", F.col("confidence") + 0.05)


@query("graph_fact_upsert", f"""WITH {KNOWN}
SELECT coalesce(k.subject, f.subject) AS subject, coalesce(k.predicate, f.predicate) AS predicate, coalesce(k.object, f.object) AS object,
  round(CASE WHEN coalesce(manual_lock, false) THEN confidence ELSE greatest(confidence, c) END, 6) AS confidence, coalesce(review_status, 'unreviewed') AS review_status, coalesce(manual_lock, false) AS manual_lock,
  CASE WHEN coalesce(manual_lock, false) THEN active WHEN c IS NOT NULL THEN coalesce(review_status, '') <> 'rejected' ELSE active END AS active
FROM known k FULL JOIN fresh f ON k.subject = f.subject AND k.predicate = f.predicate AND k.object = f.object""")
def graph_fact_upsert(t: Tables) -> DataFrame:
    return G.upsert_facts(*known_facts(t))[0].withColumn("confidence", F.round("confidence", 6))


@query("graph_conflicts", f"""WITH {KNOWN} SELECT k.subject, k.predicate, k.object, round(confidence, 6) AS confidence, round(c, 6) AS extracted FROM known k JOIN fresh f ON k.subject = f.subject AND k.predicate = f.predicate AND k.object = f.object WHERE manual_lock AND confidence <> c""")
def graph_conflicts(t: Tables) -> DataFrame:
    return G.upsert_facts(*known_facts(t))[1].withColumns({"confidence": F.round("confidence", 6), "extracted": F.round("extracted", 6)})


@query("graph_merge_entities", f"""
WITH {FACTS}, moves AS (SELECT 'n' || n_nationkey AS o, 'n' || (n_nationkey - n_nationkey % 5) AS n FROM nation WHERE n_nationkey % 5 > 0),
moved AS (SELECT coalesce(a.n, subject) AS subject, predicate, coalesce(b.n, object) AS object, confidence FROM facts LEFT JOIN moves a ON subject = a.o LEFT JOIN moves b ON object = b.o)
SELECT subject, predicate, object, round(max(confidence), 6) AS confidence, count(*) AS merged FROM moved WHERE subject <> object GROUP BY ALL""")
def graph_merge_entities(t: Tables) -> DataFrame:
    moves = t.nation.filter("n_nationkey % 5 > 0").select(F.concat(F.lit("n"), "n_nationkey").alias("old"), F.concat(F.lit("n"), F.col("n_nationkey") - F.col("n_nationkey") % 5).alias("new"))
    return G.merge_entities(facts(t), moves).withColumn("confidence", F.round("confidence", 6))


EVIDENCE = f"""{FACTS}, reified AS (SELECT subject || predicate || object AS fact_id, *, CASE WHEN length(subject) % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS review_status, true AS active, CASE WHEN ends_with(subject, '9') THEN 'manual' ELSE 'extracted' END AS origin FROM facts),
evidence AS (SELECT subject || predicate || object AS fact_id, 'v' || (length(subject) % 2) AS version, NOT ends_with(subject, '1') AS active FROM facts)"""


def evidence(t: Tables) -> tuple[DataFrame, DataFrame]:
    key = F.concat("subject", "predicate", "object").alias("fact_id")
    reified = facts(t).select(key, "*").withColumns({"review_status": F.when(F.length("subject") % 3 == 0, "rejected").otherwise("accepted"), "active": F.lit(True), "origin": F.when(F.endswith("subject", F.lit("9")), "manual").otherwise("extracted")})
    held = facts(t).select(key, F.concat(F.lit("v"), F.length("subject") % 2).alias("version"), (~F.endswith("subject", F.lit("1"))).alias("active"))
    return reified, held


@query("graph_projection", f"""
WITH {EVIDENCE}, live AS (SELECT * FROM reified WHERE active AND review_status <> 'rejected' AND fact_id IN (SELECT fact_id FROM evidence WHERE active))
SELECT entity_id FROM (SELECT subject AS entity_id FROM live UNION SELECT object FROM live)""")
def graph_projection(t: Tables) -> DataFrame:
    reified, held = evidence(t)
    entities = facts(t).select(F.explode(F.array("subject", "object")).alias("entity_id")).distinct()
    return G.projection(entities, reified, held)[1]


@query("graph_deactivate_version", f"""
WITH {EVIDENCE}, after AS (SELECT fact_id, active AND version <> 'v0' AS active FROM evidence)
SELECT fact_id, active AND (origin = 'manual' OR fact_id IN (SELECT fact_id FROM after WHERE active)) AS active FROM reified""")
def graph_deactivate_version(t: Tables) -> DataFrame:
    reified, held = evidence(t)
    return G.deactivate_version(reified, held, t.spark.createDataFrame([("v0",)], "version string"))[0].select("fact_id", "active")


@query("graph_rows_to_hits", """
WITH f AS (SELECT o_custkey % 20 AS query_id, o_orderpriority AS node, min(o_orderkey) AS spot FROM orders GROUP BY ALL)
SELECT query_id, node, row_number() OVER w AS rank, round(1 / row_number() OVER w, 6) AS score FROM f WINDOW w AS (PARTITION BY query_id ORDER BY spot, node)""")
def graph_rows_to_hits(t: Tables) -> DataFrame:
    return G.rows_to_hits(t.orders.select((F.col("o_custkey") % 20).alias("query_id"), F.col("o_orderpriority").alias("node"), "o_orderkey"), "query_id", "node", "o_orderkey")


@query("entity_keys", r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[\p{P}\p{Z}\s]+', ' ', 'g'))) AS key FROM documents")
def entity_keys(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(T.entity_key_plain("text"), 256).alias("key"))


@query("entity_ids")
def entity_ids(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", G.entity_id(F.lit("Organization"), T.entity_key("s_name")).alias("entity_id"))


@query("build_preview", """
WITH n AS (SELECT doc_id AS document_id, count(*) AS parents, sum(length(line)) AS tokens FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 200 GROUP BY 1)
SELECT d.doc_id, coalesce(parents, 0)::BIGINT AS parents, coalesce(tokens, 0)::BIGINT AS tokens, round(coalesce(tokens, 0) * 2.5 / 1e6, 9) AS cost,
  CASE WHEN d.doc_id % 5 = 0 THEN 'DOCUMENT_NOT_READY' WHEN d.doc_id % 7 = 0 THEN 'BUILD_ALREADY_ACTIVE' WHEN parents IS NULL THEN 'NO_PARENT_NODES' END AS reason FROM documents d LEFT JOIN n ON d.doc_id = n.document_id""")
def build_preview(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 5 == 0, "processing").otherwise("ready").alias("status"), (F.col("doc_id") % 7 == 0).alias("active_build"))
    lines = t.documents.select(F.col("doc_id").alias("document_id"), F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") > 200)
    out = G.preview(docs, lines.withColumn("token_count", F.length("line").cast("long")), 2.5)
    return out.select(F.col("document_id").alias("doc_id"), "parents", "tokens", "cost", "reason")


@query("projection_upsert_latest", """
WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM b WHERE n = 1""")
def projection_upsert_latest(t: Tables) -> DataFrame:
    keyed = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.struct("o_orderdate", "o_orderkey").alias("version"))
    return S.upsert_latest(keyed.filter("o_orderkey % 2 = 0"), keyed.filter("o_orderkey % 2 <> 0"), ["o_custkey"], "version").drop("version")


@query("latest_run_per_document", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1""")
def latest_run_per_document(t: Tables) -> DataFrame:
    return R.latest(t.orders.filter("o_orderstatus <> 'P'"), ["o_custkey"], F.desc_nulls_last("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("run_keys", "SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus || '|v1') AS run_key FROM orders")
def run_keys(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", R.run_key(F.col("o_orderkey"), F.col("o_orderstatus"), F.lit("v1")).alias("run_key"))


@query("pending_runs", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_runs(t: Tables) -> DataFrame:
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "succeeded").otherwise("failed").alias("status"))
    return R.pending_runs(t.orders.select("o_orderkey"), done, "o_orderkey")


@query("publish_counts", """
SELECT l_returnflag, count(*)::BIGINT AS rows, count(*) FILTER (WHERE l_linestatus = 'O')::BIGINT AS active, count(DISTINCT l_orderkey)::BIGINT AS documents FROM lineitem GROUP BY l_returnflag""")
def publish_counts(t: Tables) -> DataFrame:
    active = S.activate(t.lineitem.withColumn("current", F.lit("O")), "l_linestatus", "current")
    return active.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.count_if("is_active").alias("active"), F.count_distinct("l_orderkey").alias("documents"))


@query("visible_projection", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def visible_projection(t: Tables) -> DataFrame:
    active = S.visible(S.activate(t.lineitem.withColumn("current", F.lit("O")), "l_linestatus", "current"))
    keep = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.drop_stale(active, ["l_orderkey"], keep).select("l_orderkey", "l_linenumber")


@query("hydrate_visible", """
SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND c_acctbal > 0""")
def hydrate_visible(t: Tables) -> DataFrame:
    kept = t.orders.filter("o_orderstatus = 'F'").join(t.customer.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    return kept.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("nested_load", """
SELECT o_orderkey, count(l_orderkey)::BIGINT AS items, coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber), '') AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def nested_load(t: Tables) -> DataFrame:
    items = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("items"), F.array_join(F.sort_array(F.collect_list("l_linenumber")), ",").alias("lines"))
    return t.orders.select("o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("lines", F.lit("")).alias("lines"))


@query("uniqueness_checks", "SELECT o_custkey, o_orderdate::DATE AS day, count(*) AS rows FROM orders GROUP BY ALL HAVING count(*) > 1")
def uniqueness_checks(t: Tables) -> DataFrame:
    return R.check_unique(t.orders.select("o_custkey", F.to_date("o_orderdate").alias("day")), ["o_custkey", "day"])


@query("job_status_rollup", """
SELECT o_orderstatus AS status, count(*)::BIGINT AS jobs, count(*) FILTER (WHERE o_totalprice > 200000)::BIGINT AS large, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1""")
def job_status_rollup(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("jobs"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("stage_transitions", """
SELECT event_type, CASE event_type WHEN 'click' THEN 'chunk' WHEN 'view' THEN 'quality' WHEN 'error' THEN NULL ELSE 'clean' END AS next, count(*)::BIGINT AS events FROM events GROUP BY ALL""")
def stage_transitions(t: Tables) -> DataFrame:
    stage = F.when(F.col("event_type") == "click", "quality").when(F.col("event_type") == "view", "clean").when(F.col("event_type") == "error", "index").otherwise("parse")
    return t.events.withColumn("next", R.next_stage(stage)).groupBy("event_type", "next").agg(F.count("*").alias("events"))


@query("decision_routing", """
SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'running' ELSE 'waiting_review' END AS job, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'processing' ELSE 'quarantined' END AS version FROM labels""")
def decision_routing(t: Tables) -> DataFrame:
    job, version = R.apply_decision(F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "passed").otherwise("quarantined"))
    return t.labels.select("doc_id", "quality", job.alias("job"), version.alias("version"))


@query("review_states", """
WITH a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'passed' ELSE 'quarantined' END AS decision FROM labels), x AS (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN 'release' WHEN 1 THEN 'reject' ELSE 're_evaluate' END AS action FROM documents WHERE n_chars > 800)
SELECT a.doc_id, CASE WHEN decision <> 'quarantined' THEN decision WHEN action = 'release' THEN 'released' WHEN action = 'reject' THEN 'rejected' WHEN action = 're_evaluate' THEN 'pending' ELSE decision END AS state FROM a LEFT JOIN x USING (doc_id)""")
def review_states(t: Tables) -> DataFrame:
    a = t.labels.select(F.col("doc_id").alias("assessment_id"), F.when(F.col("quality") == 1, "passed").otherwise("quarantined").alias("decision"))
    x = t.documents.filter("n_chars > 800").select(F.col("doc_id").alias("assessment_id"), F.col("doc_id").alias("action_id"), F.lit(0).alias("at"), F.when(F.col("doc_id") % 3 == 0, "release").when(F.col("doc_id") % 3 == 1, "reject").otherwise("re_evaluate").alias("action"))
    return R.review(a, x).select(F.col("assessment_id").alias("doc_id"), "state")


@query("retryable_jobs", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def retryable_jobs(t: Tables) -> DataFrame:
    jobs = t.orders.withColumn("status", F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded"))
    return R.retryable(jobs, "o_custkey").select("o_orderkey")


@query("rate_window", """
SELECT event_id, count(*) OVER w AS calls, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)""")
def rate_window(t: Tables) -> DataFrame:
    return R.sliding(t.events, ["user_id"], "ts", "value").select("event_id", "calls", F.round("total", 4).alias("total"))


@query("stale_sessions", """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 300000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY ALL""")
def stale_sessions(t: Tables) -> DataFrame:
    return R.sessions(t.events, ["user_id"], "ts", "event_id").groupBy("user_id", "session").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query("stale_jobs", """
WITH l AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1) SELECT user_id, epoch_us(seen) AS seen FROM l WHERE epoch(seen) <= (SELECT epoch(max(ts)) FROM events) - 300""")
def stale_jobs(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts").alias("now")).withColumn("one", F.lit(1))
    jobs = t.events.groupBy("user_id").agg(F.max("ts").alias("updated_at")).withColumn("status", F.lit("running")).withColumn("one", F.lit(1)).join(now, "one")
    return R.stale(jobs, F.col("now")).select("user_id", R.micros("updated_at").alias("seen"))


@query("heartbeat_age", "SELECT user_id, epoch_us(max(ts)) AS seen, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) <= 240000000 AS alive FROM events GROUP BY user_id")
def heartbeat_age(t: Tables) -> DataFrame:
    now = t.events.agg(F.max(R.micros("ts")).alias("now")).withColumn("one", F.lit(1))
    last = t.events.groupBy("user_id").agg(F.max(R.micros("ts")).alias("seen")).withColumn("one", F.lit(1)).join(now, "one")
    return last.select("user_id", "seen", (F.col("now") - F.col("seen") <= 240_000_000).alias("alive"))


@query("props_json", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(props->>'$.k')::BIGINT AS held FROM events GROUP BY event_type")
def props_json(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("held"))


@query("paging", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paging(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


@query("substring_filter", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%9%' OR c_mktsegment = 'BUILDING'")
def substring_filter(t: Tables) -> DataFrame:
    return t.customer.filter(F.col("c_name").ilike("%9%") | (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "c_name")


# Extensions: what the relational layer offers beside the operators above.


@query("ext_rollup", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*)::BIGINT AS rows FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("rows"))


@query("ext_cube", "SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS rows FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("rows"))


@query("ext_pivot", "SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS f, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag")
def ext_pivot(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).sum("l_quantity").withColumnsRenamed({"F": "f", "O": "o"})


@query("ext_tumbling", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS hour, count(*)::BIGINT AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(t: Tables) -> DataFrame:
    w = F.window("ts", "1 hour")
    return t.events.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select("event_type", R.micros("w.start").alias("hour"), "events", "total")


@query("ext_asof", """
SELECT e.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts > v.ts""")
def ext_asof(t: Tables) -> DataFrame:
    """The last view before each click, by one window over both, without a join."""
    w = Window.partitionBy("user_id").orderBy(R.micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    both = t.events.filter("event_type IN ('click', 'view')").withColumn("view_id", F.max(F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))).over(w)["event_id"])
    return both.filter("event_type = 'click'").select("event_id", "view_id")
