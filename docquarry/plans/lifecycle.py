"""Queries of the composed chunker, projections and their life, traces, graph reviews, and dataset checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators import blocks as B
from docquarry.operators import composed as M
from docquarry.operators import lifecycle as L
from docquarry.operators import traces as R
from docquarry.plans.nodes import TOKEN_SQL, greedy
from docquarry.plans.records import EVIDENCE, evidence
from docquarry.plans.registry import LINES, Tables, query


@query("nearest_ancestor", f"""
WITH RECURSIVE {LINES}, b AS (SELECT doc_id, ord, CASE WHEN ord > 0 THEN ord // 3 END AS up, ord % 4 = 1 AS hit FROM lines),
walk AS (SELECT doc_id, ord, up AS at FROM b WHERE up IS NOT NULL UNION ALL SELECT w.doc_id, w.ord, b.up FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.ord = w.at WHERE NOT b.hit AND b.up IS NOT NULL),
found AS (SELECT w.doc_id, w.ord, w.at FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.ord = w.at WHERE b.hit)
SELECT b.doc_id, b.ord, f.at AS ancestor FROM b LEFT JOIN found f ON b.doc_id = f.doc_id AND b.ord = f.ord""")
def nearest_ancestor(t: Tables) -> DataFrame:
    b = B.lines_of(t.documents, "doc_id").select("doc_id", F.col("ord").cast("long").alias("ord")).withColumn("up", F.when(F.col("ord") > 0, F.floor(F.col("ord") / 3)))
    return M.nearest_ancestor(b, "doc_id", "ord", "up", F.col("ord") % 4 == 1)


@query("effective_heading_path", """
WITH p AS (SELECT p_partkey, list_filter([trim(p_brand), trim(' '), split_part(p_type, ' ', 1)], lambda x: x <> '') AS own, trim(CASE WHEN p_size % 4 = 0 THEN split_part(p_type, ' ', 1) ELSE p_name END) AS said, p_size FROM part)
SELECT p_partkey, array_to_string(CASE WHEN p_size % 2 = 0 AND said <> '' AND (len(own) = 0 OR own[-1] <> said) THEN list_append(own, said) ELSE own END, ' > ') AS path FROM p""")
def effective_heading_path(t: Tables) -> DataFrame:
    first = F.split("p_type", " ")[0]
    path = M.effective_heading_path(F.array("p_brand", F.lit(" "), first), F.when(F.col("p_size") % 2 == 0, "heading").otherwise("paragraph"), F.when(F.col("p_size") % 4 == 0, first).otherwise(F.col("p_name")))
    return t.part.select("p_partkey", F.array_join(path, " > ").alias("path"))


def locators(t: Tables) -> DataFrame:
    """The lines of an order as locators of pages, slides and sheets."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    x = F.struct(
        n.alias("l_linenumber"), "l_extendedprice", "l_partkey", F.when(flag == "R", n).alias("page_number"), F.when(flag == "A", n % 3).alias("slide_number"), F.when(flag == "N", F.col("l_linestatus")).otherwise("").alias("sheet_name"),
        F.when(F.col("l_quantity") > 25, F.concat(F.lit("A"), n % 2)).alias("cell_range"), F.when(F.col("l_linestatus") == "O", n).alias("line_start"), F.when(F.col("l_tax") > 0.04, n + 2).alias("line_end"),
    )
    return t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(x)).alias("locators"), F.max("l_tax").alias("tax"), F.array_sort(F.collect_set("l_linestatus")).alias("codes"))


LOCATORS = """x AS (SELECT *, CASE l_returnflag WHEN 'R' THEN l_linenumber END AS page, CASE l_returnflag WHEN 'A' THEN l_linenumber % 3 END AS slide, CASE l_returnflag WHEN 'N' THEN l_linestatus END AS sheet,
  CASE WHEN l_quantity > 25 THEN 'A' || (l_linenumber % 2) END AS cells, CASE l_linestatus WHEN 'O' THEN l_linenumber END AS start, CASE WHEN l_tax > 0.04 THEN l_linenumber + 2 ELSE l_linenumber END AS stop FROM lineitem)"""


@query("source_labels", f"""
WITH {LOCATORS}, l AS (SELECT l_orderkey, flatten(list(list_filter(['page ' || page, 'slide ' || slide, 'sheet ' || sheet || coalesce(' ' || cells, ''), 'lines ' || start || '-' || stop], lambda v: v IS NOT NULL) ORDER BY l_linenumber, l_extendedprice, l_partkey)) AS l FROM x GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), ', ') AS labels FROM l""")
def source_labels(t: Tables) -> DataFrame:
    return locators(t).select("l_orderkey", F.array_join(M.source_labels("locators"), ", ").alias("labels"))


def uniques(c: str) -> str:
    return f"array_to_string(coalesce(list_sort(list_distinct(list({c}) FILTER (WHERE {c} IS NOT NULL))), []), ',')"


@query("node_projection", f"""
WITH {LOCATORS} SELECT l_orderkey, {uniques('page')} AS pages, {uniques('slide')} AS slides, {uniques('sheet')} AS sheets, {uniques('cells')} AS ranges, max(l_tax) AS score, {uniques('l_linestatus')} AS flags FROM x GROUP BY 1""")
def node_projection(t: Tables) -> DataFrame:
    n = L.node_projection(locators(t).withColumn("summary", F.struct(F.col("tax").alias("overall_score"), F.col("codes").alias("issue_codes"))), "locators", "summary")
    names = {"pages": "page_numbers", "slides": "slide_numbers", "sheets": "sheet_names", "ranges": "cell_ranges", "flags": "quality_flags"}
    return n.select("l_orderkey", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(a) for a, c in names.items()], F.col("quality_score").alias("score"))


KIND = "CASE p_partkey % 4 WHEN 0 THEN 'record_table' WHEN 1 THEN 'matrix' WHEN 2 THEN 'key_value' END"


def kind() -> Column:
    k = F.col("p_partkey") % 4
    return F.when(k == 0, "record_table").when(k == 1, "matrix").when(k == 2, "key_value")


@query("table_headers", f"""
SELECT p_partkey, array_to_string(CASE WHEN coalesce({KIND}, '') NOT IN ('record_table', 'matrix') THEN [] WHEN p_size % 5 = 0 THEN [p_brand] WHEN p_size % 3 = 0 THEN [p_type, ''] WHEN p_size % 7 = 0 THEN ['', p_brand]
  ELSE list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> '') END, '/') AS header FROM part""")
def table_headers(t: Tables) -> DataFrame:
    none, rows = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    grid = F.when(F.col("p_size") % 3 == 0, F.array(F.array(F.col("p_type"), F.lit(None).cast("string")), F.array("p_name"))).otherwise(rows)
    shown = F.when(F.col("p_size") % 7 == 0, F.array(F.array(F.lit(""), F.col("p_brand")))).otherwise(rows)
    header = M.table_header(kind(), F.when(F.col("p_size") % 5 == 0, F.array("p_brand")).otherwise(none), [grid, shown], F.concat(F.lit("\n "), F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit("\nnext")))
    return t.part.select("p_partkey", F.array_join(header, "/").alias("header"))


@query("table_header_preparation", f"""
WITH p AS (SELECT p_partkey, coalesce({KIND}, 'complex') IN ('record_table', 'matrix') AND p_size % 3 > 0 AS h, p_size, p_brand FROM part)
SELECT p_partkey, CASE WHEN h THEN p_brand || '/x' ELSE '' END AS header, CASE WHEN h THEN 'shape_analyzer' ELSE 'not_applicable' END AS header_source, greatest(0, p_size % 3 - 1)::BIGINT AS data_rows,
  CASE WHEN h THEN 'TABLE_HEADER_CANDIDATE_PREPARED' ELSE 'TABLE_SHAPE_PROFILE_PREPARED' END AS code FROM p""")
def table_header_preparation(t: Tables) -> DataFrame:
    grid = F.slice(F.array(F.array(F.concat(F.lit(" "), "p_brand"), F.lit("x ")), F.array(F.lit("1"), F.lit("2"))), F.lit(1), F.col("p_size") % 3)
    p = t.part.select("p_partkey", M.prepared_header(F.coalesce(kind(), F.lit("complex")), grid, F.array(F.lit(0))).alias("p"))
    return p.select("p_partkey", F.array_join("p.header", "/").alias("header"), "p.header_source", "p.data_rows", "p.code")


@query("header_children", rf"""
WITH RECURSIVE {LINES}, solid AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS r FROM lines WHERE regexp_matches(line, '\S')),
held AS (SELECT doc_id, list(r ORDER BY i) AS r, list(len(regexp_extract_all(r, '{TOKEN_SQL}')) ORDER BY i) AS k FROM solid GROUP BY 1),
sums AS (SELECT doc_id, len(r)::BIGINT AS z, list_transform(range(0, len(k) + 1), lambda i: coalesce(list_sum(k[1:i]), 0)::BIGINT) AS c FROM held), {greedy('3 + c[e + 2] - c[{s} + 1] > 500')}
SELECT doc_id, n::BIGINT AS child, (3 + c[e + 1] - c[s + 1])::BIGINT AS tokens, sha256('id' || chr(9) || '~' || chr(9) || 'line' || chr(10) || array_to_string(h.r[s + 1:e], chr(10))) AS content FROM walk JOIN held h USING (doc_id)""")
def header_children(t: Tables) -> DataFrame:
    tables = t.documents.filter(F.regexp_like("text", F.lit(r"\S"))).withColumn("header", F.array(F.lit("id"), F.lit("~"), F.lit("line")))
    return M.header_children(tables, "doc_id", "header", "text").withColumn("content", F.sha2("content", 256))


@query("nodes_replaced", "SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE l_returnflag = 'N')::BIGINT AS fresh, count(*)::BIGINT AS nodes FROM lineitem x WHERE l_returnflag = 'N' OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') GROUP BY ALL")
def nodes_replaced(t: Tables) -> DataFrame:
    n = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    out = L.replaced(n.filter("l_returnflag <> 'N'"), n.filter("l_returnflag = 'N'"), ["l_orderkey"])
    return out.groupBy("l_orderkey", "l_linenumber").agg(F.count_if(F.col("l_returnflag") == "N").alias("fresh"), F.count("*").alias("nodes"))


@query("document_projection", """
WITH c AS (SELECT l_orderkey, max((l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_linestatus ELSE '' END, l_returnflag)) AS c FROM lineitem GROUP BY 1)
SELECT o_orderkey AS version_id, CASE WHEN coalesce(c[2], '') <> '' THEN c[2] ELSE o_orderpriority END AS title, c[3] AS language, 'ready' AS status, false AS is_active FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def document_projection(t: Tables) -> DataFrame:
    versions = t.orders.select(F.col("o_orderkey").alias("version_id"), F.col("o_orderpriority").alias("display_name"))
    c = t.lineitem.select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("run"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).otherwise("").alias("title"), F.col("l_returnflag").alias("language"))
    return L.document_projection(versions, c).select("version_id", "title", "language", "status", "is_active")


@query("index_rebuild", """
WITH d AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders GROUP BY 1), r AS (SELECT d.o_custkey, v FROM d JOIN orders ON v = o_orderkey WHERE o_orderstatus = 'F'),
n AS (SELECT r.o_custkey, r.v, l_returnflag, l_shipdate FROM lineitem JOIN r ON v = l_orderkey WHERE l_tax > 0.02), f AS (SELECT v, l_returnflag, max(l_shipdate) AS ts FROM n GROUP BY ALL), w AS (SELECT v, (max({'t': ts, 'r': l_returnflag})).r AS run FROM f GROUP BY v)
SELECT n.o_custkey AS document_id, n.v AS version_id, w.run, count(*)::BIGINT AS nodes FROM n JOIN w ON n.v = w.v AND n.l_returnflag = w.run GROUP BY ALL""")
def index_rebuild(t: Tables) -> DataFrame:
    documents = t.orders.groupBy(F.col("o_custkey").alias("document_id")).agg(F.max("o_orderkey").alias("current_version_id"))
    versions = t.orders.select(F.col("o_orderkey").alias("version_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("processing").alias("status"))
    nodes = t.lineitem.select(F.col("l_orderkey").alias("version_id"), F.col("l_returnflag").alias("run"), F.col("l_shipdate").alias("finished_at"), (F.col("l_tax") > 0.02).alias("embedded"))
    return L.rebuild(documents, versions, nodes).groupBy("document_id", "version_id", "run").agg(F.count("*").alias("nodes"))


@query("projection_lifecycle", """
WITH a AS (SELECT o_custkey, CASE o_custkey % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'restore' WHEN 2 THEN 'purge' ELSE 'none' END AS a FROM (SELECT DISTINCT o_custkey FROM orders)), c AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders GROUP BY 1)
SELECT o_orderkey AS version_id, CASE a WHEN 'delete' THEN false WHEN 'restore' THEN o_orderkey = v ELSE o_orderstatus = 'O' END AS is_active, CASE WHEN a = 'delete' THEN 'stale' WHEN a = 'restore' AND o_orderkey = v THEN 'indexed' ELSE o_orderstatus END AS index_status
FROM orders JOIN a USING (o_custkey) JOIN c USING (o_custkey) WHERE a <> 'purge'""")
def projection_lifecycle(t: Tables) -> DataFrame:
    doc, k = F.col("o_custkey").alias("document_id"), F.col("o_custkey") % 4
    current = t.orders.groupBy(doc).agg(F.max("o_orderkey").alias("current_version_id"))
    rows = t.orders.select(doc, F.col("o_orderkey").alias("version_id"), (F.col("o_orderstatus") == "O").alias("is_active"), F.col("o_orderstatus").alias("index_status")).join(current, "document_id")
    last = t.orders.select(doc, F.lit(2).alias("at"), F.when(k == 0, "delete").when(k == 1, "restore").when(k == 2, "purge").alias("action")).filter("action IS NOT NULL").distinct()
    before = last.withColumn("at", F.lit(1)).withColumn("action", F.lit("delete"))
    return L.apply_lifecycle(rows, last.unionByName(before)).select("version_id", "is_active", "index_status")


@query("capability_gate", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 AND n_regionkey % 2 = 0 THEN NULL ELSE 'INDEX_REQUIRED_PLUGIN_MISSING' END AS issue FROM nation")
def capability_gate(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", L.capability_issue(F.col("n_nationkey") % 2 == 0, F.when(F.col("n_regionkey") % 2 == 0, True)).alias("issue"))


@query("embedding_resume", """
WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (SELECT * FROM part WHERE p_size > 25)
SELECT l_orderkey AS batch_id, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS node_ids, sum(p_size)::BIGINT AS tokens FROM d JOIN p ON l_partkey = p_partkey GROUP BY 1""")
def embedding_resume(t: Tables) -> DataFrame:
    batches = t.lineitem.groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("node_ids"))
    pending = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("node_id"), F.col("p_size").alias("tokens"))
    return L.resumed_batches(batches, pending).withColumn("node_ids", F.array_join(F.col("node_ids").cast("array<string>"), ","))


@query("reevaluation_flags", "SELECT o_orderkey AS assessment_id, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS requested FROM orders")
def reevaluation_flags(t: Tables) -> DataFrame:
    actions = t.lineitem.select(F.col("l_orderkey").alias("assessment_id"), F.when(F.col("l_returnflag") == "R", "re_evaluate").otherwise("release").alias("action"))
    return L.reevaluations(t.orders.select(F.col("o_orderkey").alias("assessment_id")), actions)


@query("queue_health", "SELECT event_type, count(*) FILTER (WHERE value < 30)::BIGINT AS depth, CASE WHEN count(*) FILTER (WHERE value < 30) >= 100 THEN 'warning' ELSE 'ok' END AS status FROM events GROUP BY 1")
def queue_health(t: Tables) -> DataFrame:
    return L.queue_health(t.events, "event_type", F.col("value") < 30, 100)


@query("chat_requests", """
WITH m AS (SELECT conv_id, count(*) AS n, max((turn, role, CASE WHEN turn % 3 = 0 THEN '' ELSE text END)) AS l FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN n > 4 THEN 'MESSAGES_COUNT_INVALID' WHEN l[2] <> 'user' OR trim(l[3]) = '' THEN 'LATEST_MESSAGE_INVALID' END AS issue FROM m""")
def chat_requests(t: Tables) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text"))
    parts = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.lit("text").alias("type"), text.alias("text")), F.struct(F.lit("file").alias("type"), F.lit("x").alias("text"))))
    m = t.conversations.select("conv_id", F.struct("turn", "role", parts.alias("parts"), F.when(F.col("turn") % 2 == 1, text).alias("content")).alias("m"))
    return m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("l")).select("conv_id", L.chat_request_issue("l", 4).alias("issue"))


@query("graph_build_states", """
WITH v AS (SELECT user_id, min(event_id) AS s FROM events WHERE event_type = 'view' GROUP BY 1), k AS (SELECT user_id, min(event_id) AS c FROM events WHERE event_type = 'signup' GROUP BY 1),
u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), f AS (SELECT e.user_id, min((e.event_id, e.event_type)) AS t FROM events e JOIN v USING (user_id) WHERE e.event_id > v.s AND e.event_type IN ('purchase', 'error') GROUP BY 1)
SELECT user_id, CASE WHEN c IS NOT NULL AND (s IS NULL OR c < s) THEN 'cancelled' WHEN s IS NULL THEN 'queued' WHEN t IS NULL THEN 'running' WHEN t[2] = 'purchase' THEN 'succeeded' ELSE 'failed' END AS state,
  (n - CASE WHEN c IS NOT NULL AND (s IS NULL OR c < s) THEN 1 WHEN s IS NULL THEN 0 WHEN t IS NULL THEN 1 ELSE 2 END)::BIGINT AS refused FROM u LEFT JOIN v USING (user_id) LEFT JOIN k USING (user_id) LEFT JOIN f USING (user_id)""")
def graph_build_states(t: Tables) -> DataFrame:
    k = F.col("event_type")
    to = F.when(k == "view", "running").when(k == "signup", "cancelled").when(k == "purchase", "succeeded").when(k == "error", "failed").otherwise("queued")
    return L.build_states(t.events.select("user_id", "event_id", to.alias("to")), "user_id", "event_id")


@query("graph_forced_builds", "SELECT o_orderkey, o_orderkey % 5 = 0 OR o_orderstatus = 'F' OR o_orderpriority LIKE '1%' OR o_orderkey % 7 = 0 AS forced FROM orders")
def graph_forced_builds(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderpriority").startswith("1"), "stale").otherwise("pending")
    return t.orders.select("o_orderkey", L.forced_build(F.col("o_orderkey") % 5 == 0, F.when(F.col("o_orderstatus") == "F", True), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate")), status).alias("forced"))


@query("context_representatives", """
WITH c AS (SELECT DISTINCT o_custkey, o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey), k AS (SELECT DISTINCT o_custkey, l_partkey FROM c JOIN part ON p_partkey = l_partkey WHERE p_size > 25),
f AS (SELECT o_custkey, o_orderkey, min(l_partkey) AS p FROM c JOIN k USING (o_custkey, l_partkey) GROUP BY ALL) SELECT o_custkey, p AS node_id, min(o_orderkey) AS ord FROM f GROUP BY ALL""")
def context_representatives(t: Tables) -> DataFrame:
    bought = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    contexts = bought.groupBy("o_custkey", F.col("o_orderkey").alias("ord")).agg(F.array_sort(F.collect_set("l_partkey")).alias("children"))
    candidates = bought.join(t.part.filter("p_size > 25"), F.col("l_partkey") == F.col("p_partkey")).select("o_custkey", F.col("l_partkey").alias("node_id"))
    return R.representatives(contexts, candidates, "o_custkey")


@query("retrieval_trace", """
SELECT l_orderkey, string_agg(l_returnflag || ':' || CASE WHEN l_linestatus = 'F' THEN 'failed' ELSE 'succeeded' END, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS stages, sum(l_quantity) AS latency_ms, sum(l_linenumber)::BIGINT AS tokens, round(sum(l_discount), 6) AS cost_usd,
  CASE WHEN count(*) FILTER (WHERE l_linestatus = 'F') = count(*) THEN 'failed' WHEN count(*) FILTER (WHERE l_linestatus = 'F') > 0 THEN 'degraded' ELSE 'succeeded' END AS status FROM lineitem GROUP BY 1""")
def retrieval_trace(t: Tables) -> DataFrame:
    status = F.when(F.col("l_linestatus") == "F", "failed").otherwise("succeeded")
    stages = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("stage"), status.alias("status"), F.col("l_quantity").alias("latency_ms"), F.col("l_linenumber").alias("tokens"), F.col("l_discount").alias("cost_usd"))
    shown = F.array_join(F.transform("stages", lambda x: F.concat(x["stage"], F.lit(":"), x["status"])), ",")
    return R.retrieval_trace(stages, "l_orderkey").withColumn("stages", shown).withColumn("cost_usd", F.round("cost_usd", 6))


@query("message_trace", """
WITH c AS (SELECT l_orderkey, string_agg('S' || l_linenumber || '=' || l_partkey, ',' ORDER BY 'S' || l_linenumber, l_partkey) AS c FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT o_orderkey AS message_id, r.c_name AS retrieval, n.n_name AS invocation, coalesce(c.c, '') AS citations FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) r ON c_custkey = o_custkey LEFT JOIN nation n ON n_nationkey = o_orderkey % 30 LEFT JOIN c ON l_orderkey = o_orderkey""")
def message_trace(t: Tables) -> DataFrame:
    messages = t.orders.select(F.col("o_orderkey").alias("message_id"), F.col("o_custkey").alias("retrieval_id"), (F.col("o_orderkey") % 30).alias("invocation_id"))
    retrievals = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("retrieval_id"), F.col("c_name").alias("retrieval"))
    invocations = t.nation.select(F.col("n_nationkey").cast("long").alias("invocation_id"), F.col("n_name").alias("invocation"))
    citations = t.lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("message_id"), F.concat(F.lit("S"), "l_linenumber").alias("label"), F.col("l_partkey").alias("node_id"))
    shown = F.array_join(F.transform("citations", lambda x: F.concat(x["label"], F.lit("="), x["node_id"])), ",")
    return R.message_trace(messages, retrievals, invocations, citations).select("message_id", "retrieval", "invocation", shown.alias("citations"))


@query("graph_trace_metrics", """
WITH e AS (SELECT event_id, event_type, props, value, event_id % 3 AS k, CASE event_type WHEN 'view' THEN 'succeeded' WHEN 'click' THEN 'fallback' WHEN 'error' THEN 'rejected' ELSE 'failed' END AS status, CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'fallback' WHEN 2 THEN 'safe_rejection' END AS expected FROM events)
SELECT event_id, CASE WHEN k > 0 THEN (contains(lower(props), '1') AND contains(lower(props), 'k'))::INT::DOUBLE END AS graph_path_hit, (value > 20)::INT::DOUBLE AS syntax_pass, (k = 1 OR value > 100)::INT::DOUBLE AS schema_compliance, (status = 'succeeded')::INT::DOUBLE AS execution_success, (status = 'rejected')::INT::DOUBLE AS safe_rejection,
  CASE WHEN expected IS NOT NULL THEN ((expected = 'success' AND status = 'succeeded') OR (expected = 'fallback' AND status = 'fallback') OR (expected = 'safe_rejection' AND status = 'rejected'))::INT::DOUBLE END AS expected_outcome FROM e""")
def graph_trace_metrics(t: Tables) -> DataFrame:
    kind_, k, rest = F.col("event_type"), F.col("event_id") % 3, F.col("event_id") % 4
    status = F.when(kind_ == "view", "succeeded").when(kind_ == "click", "fallback").when(kind_ == "error", "rejected").otherwise("failed")
    path = F.when(k > 0, F.array(F.lit("1"), F.lit("K"))).otherwise(F.array().cast("array<string>"))
    expected = F.when(rest == 0, "success").when(rest == 1, "fallback").when(rest == 2, "safe_rejection")
    m = R.graph_trace_metrics(path, F.col("props"), status, F.when(F.col("value") > 20, "MATCH"), F.when(F.col("value") > 100, "MATCH").otherwise(""), F.when(k == 1, True), expected)
    return t.events.select("event_id", m.alias("m")).select("event_id", "m.*")


@query("path_fact_keys", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN lower(p_brand || '|' || p_type || '|' || p_name) END AS key FROM part")
def path_fact_keys(t: Tables) -> DataFrame:
    def path(s: str, p: str, o: str) -> Column:
        return F.create_map(F.lit("kind"), F.lit("x"), F.lit(s), F.col("p_brand"), F.lit(p), F.col("p_type"), F.lit(o), F.when(F.col("p_size") % 4 > 0, F.col("p_name")).otherwise(""))

    k = F.col("p_partkey") % 3
    return t.part.select("p_partkey", R.path_fact_key(F.when(k == 0, path("subject", "predicate", "object")).when(k == 1, path("source", "relationship", "target")).otherwise(path("from", "relation", "to"))).alias("key"))


@query("golden_issues", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 AND p_size % 3 > 0 THEN 'EXPECTATION_MISSING' WHEN p_size % 2 = 0 AND p_partkey % 4 <> 0 AND p_size % 7 = 0 THEN 'RELEVANCE_MISSING' WHEN p_partkey % 6 = 1 AND p_partkey % 4 <> 1 THEN 'TOOL_MISMATCH' WHEN p_size % 11 = 0 THEN 'TAGS_REPEATED'
  WHEN count(*) OVER (PARTITION BY p_brand || p_size) > 1 THEN 'ID_REPEATED' END AS issue FROM part""")
def golden_issues(t: Tables) -> DataFrame:
    size, k, none = F.col("p_size"), F.col("p_partkey") % 4, F.array().cast("array<string>")
    s = t.part.select(
        "p_partkey", F.concat("p_brand", "p_size").alias("id"), F.when(size % 5 > 0, F.col("p_name")).alias("expected_answer"), F.when(size % 3 == 0, F.array("p_type")).otherwise(none).alias("rubric"), (size % 2 == 0).alias("answerable"),
        F.when(k == 0, "direct").when(k == 1, "documents").alias("expected_action"), F.when(F.col("p_partkey") % 6 == 1, R.TOOLS["documents"]).alias("expected_tool"), F.when(size % 7 > 0, F.array("p_brand")).otherwise(none).alias("documents"),
        none.alias("nodes"), F.when(size % 11 == 0, F.array("p_brand", "p_brand")).otherwise(F.array("p_brand")).alias("tags"),
    )
    return R.golden_issues(s).select("p_partkey", "issue")


@query("document_recall", """
WITH w AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey % 3 = 0), h AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3 AND l_quantity > 5),
f AS (SELECT l_orderkey, count(*) AS a, count(h.l_suppkey) AS g FROM w LEFT JOIN h USING (l_orderkey, l_suppkey) GROUP BY 1), r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 5)
SELECT o_orderkey AS sample, CASE WHEN f.a IS NOT NULL OR o_orderstatus <> 'F' THEN coalesce(g / a, 0.0)::DOUBLE END AS parent_document_recall, CASE WHEN f.a IS NULL AND o_orderstatus = 'F' THEN (r.l_orderkey IS NULL)::INT::DOUBLE END AS no_answer_retrieval_empty
FROM orders LEFT JOIN f ON f.l_orderkey = o_orderkey LEFT JOIN r ON r.l_orderkey = o_orderkey""")
def document_recall(t: Tables) -> DataFrame:
    hits = t.lineitem.select(F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("document"), F.col("l_linenumber").alias("rank"), "l_quantity")
    samples = t.orders.select(F.col("o_orderkey").alias("sample"), (F.col("o_orderstatus") != "F").alias("answerable"))
    return R.document_recall(samples, hits.filter("l_quantity > 5"), hits.filter("document % 3 = 0"), "sample", 3)


@query("extraction_inputs", """
WITH n AS (SELECT l_orderkey, string_agg(l_partkey || ':' || sha256(l_linestatus), chr(10) ORDER BY l_partkey, sha256(l_linestatus)) AS l, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 AND l_returnflag <> 'A' GROUP BY 1)
SELECT o_orderkey AS version_id, coalesce(n, 0)::BIGINT AS parents, sha256('v1' || chr(10) || l) AS input_hash FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""")
def extraction_inputs(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    nodes = t.lineitem.select(F.col("l_orderkey").alias("version_id"), F.col("l_partkey").alias("node_id"), F.when(F.col("l_linenumber") <= 2, "parent").otherwise("child").alias("node_level"), F.when(flag == "R", "passed").when(flag == "N", "warning").otherwise("rejected").alias("quality_status"), F.sha2("l_linestatus", 256).alias("text_hash"))
    return R.extraction_inputs(t.orders.select(F.col("o_orderkey").alias("version_id")), nodes, "v1")


@query("graph_usage", """
WITH s AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R')::BIGINT AS s, count(*) FILTER (WHERE l_returnflag = 'A')::BIGINT AS f, sum(CASE WHEN l_tax > 0.02 THEN l_linenumber ELSE 0 END)::BIGINT AS i, sum(l_linenumber)::BIGINT AS o, sum(l_quantity) AS ms FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, o_orderkey % 6 AS p, coalesce(s, 0) AS s, greatest(coalesce(f, 0), o_orderkey % 6 - coalesce(s, 0)) AS f, coalesce(i, 0) AS i, coalesce(o, 0) AS o, coalesce(ms, 0) AS ms FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT o_orderkey AS version_id, p AS parent_count, s AS succeeded, f AS failed, CASE WHEN p > 0 THEN round(f / p, 6) ELSE 0 END::DOUBLE AS failed_ratio, i AS input_tokens, o AS output_tokens, round(ms, 3) AS latency_ms FROM j""")
def graph_usage(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    outcomes = t.lineitem.select(F.col("l_orderkey").alias("version_id"), F.when(flag == "R", "succeeded").when(flag == "A", "failed").otherwise("skipped").alias("status"), F.when(F.col("l_tax") > 0.02, F.col("l_linenumber")).alias("input_tokens"), F.col("l_linenumber").alias("output_tokens"), F.col("l_quantity").alias("latency_ms"))
    return R.usage_snapshot(outcomes, t.orders.select(F.col("o_orderkey").alias("version_id"), (F.col("o_orderkey") % 6).alias("parent_count")), "version_id")


def reviews(t: Tables) -> tuple[DataFrame, DataFrame]:
    reified = evidence(t)[0].withColumn("manual_lock", F.lit(False))
    first = reified.filter(F.length("subject") % 2 == 0).select("fact_id", F.lit(1).alias("at"), (F.length("object") % 2 == 0).alias("approve"))
    return reified, first.unionByName(reified.filter("endswith(subject, '5')").select("fact_id", F.lit(2).alias("at"), F.lit(False).alias("approve")))


REVIEWS = f"""{EVIDENCE}, reviews AS (SELECT fact_id, 1 AS n, length(object) % 2 = 0 AS approve FROM reified WHERE length(subject) % 2 = 0 UNION ALL SELECT fact_id, 2, false FROM reified WHERE ends_with(subject, '5'))"""


@query("graph_reviewed_facts", f"""
WITH {REVIEWS}, l AS (SELECT fact_id, arg_max(approve, n) AS ok FROM reviews GROUP BY 1)
SELECT fact_id, CASE WHEN ok THEN 'approved' WHEN NOT ok THEN 'rejected' ELSE review_status END AS review_status, coalesce(ok, active) AS active, ok IS NOT NULL AS manual_lock FROM reified LEFT JOIN l USING (fact_id)""")
def graph_reviewed_facts(t: Tables) -> DataFrame:
    return R.review_facts(*reviews(t))[0].select("fact_id", "review_status", "active", "manual_lock")


@query("graph_review_audit", f"""
WITH {REVIEWS}, a AS (SELECT fact_id, n, CASE WHEN approve THEN 'approved' ELSE 'rejected' END AS after, CASE WHEN approve THEN 'approve' ELSE 'reject' END AS action, review_status FROM reviews JOIN reified USING (fact_id))
SELECT fact_id, n::BIGINT AS "at", action, coalesce(lag(after) OVER (PARTITION BY fact_id ORDER BY n), review_status) AS before, after FROM a""")
def graph_review_audit(t: Tables) -> DataFrame:
    return R.review_facts(*reviews(t))[1].select("fact_id", F.col("at").cast("long").alias("at"), "action", "before", "after")


@query("document_graph", f"""
WITH {EVIDENCE}, live AS (SELECT e.version, f.fact_id, f.subject, f.object FROM evidence e JOIN reified f USING (fact_id) WHERE e.active AND f.active AND f.review_status <> 'rejected'), v AS (SELECT DISTINCT version FROM evidence UNION SELECT 'v9'),
c AS (SELECT version, count(*) AS e, count(DISTINCT fact_id) AS f FROM live GROUP BY 1), n AS (SELECT version, count(DISTINCT x) AS n FROM (SELECT version, unnest([subject, object]) AS x FROM live) GROUP BY 1), p AS (SELECT 'v' || (p_size % 3) AS version, count(*) AS p FROM part WHERE p_size > 20 GROUP BY 1)
SELECT version AS version_id, coalesce(e, 0)::BIGINT AS evidence, coalesce(f, 0)::BIGINT AS facts, coalesce(n, 0)::BIGINT AS entities, coalesce(p, 0)::BIGINT AS parents FROM v LEFT JOIN c USING (version) LEFT JOIN n USING (version) LEFT JOIN p USING (version)""")
def document_graph(t: Tables) -> DataFrame:
    reified, held = evidence(t)
    held = held.withColumnRenamed("version", "version_id")
    versions = held.select("version_id").distinct().unionByName(t.spark.createDataFrame([("v9",)], "version_id string"))
    nodes = t.part.select(F.concat(F.lit("v"), F.col("p_size") % 3).alias("version_id"), F.when(F.col("p_size") > 20, "parent").otherwise("child").alias("node_level"))
    return R.document_graph(versions, held, reified, nodes)
