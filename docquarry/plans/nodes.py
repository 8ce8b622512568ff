"""Queries of chunking, node admission, context and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import blocks as B
from docquarry.operators import chunking as K
from docquarry.operators import composed as M
from docquarry.operators import context as X
from docquarry.operators import conversation as V
from docquarry.plans.registry import LINES, Tables, query
from docquarry.plans.retrieval import FUSED_CTES, TERM, fused

TOKEN_SQL = r"[\x{3400}-\x{9fff}]|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def greedy(cut: str) -> str:
    """SQL of a walk over each document's runs of rows, in `sums` (doc_id, z rows, c sums of their tokens from 0 on): doc_id, n, s, e (rows s to e - 1); `cut`: what ends a run before row e."""
    return f"""walk AS (
  SELECT doc_id, 0 AS n, 0::BIGINT AS s, coalesce(list_filter(range(1, z), lambda e: {cut.format(s='0')})[1], z) AS e, c, z FROM sums WHERE z > 0
  UNION ALL SELECT doc_id, n + 1, e, coalesce(list_filter(range(w.e + 1, z), lambda e: {cut.format(s='w.e')})[1], z), c, z FROM walk w WHERE w.e < z)"""


@query("chunk_windows_fixed", rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{TERM}') AS l FROM documents), s AS (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 16, 1), 112)) AS first FROM t WHERE len(l) > 0)
SELECT doc_id, first // 112 AS window, first, least(128, len(l) - first)::BIGINT AS terms, sha256(array_to_string(l[first + 1:first + 128], ' ')) AS content FROM s""")
def chunk_windows_fixed(t: Tables) -> DataFrame:
    return K.fixed_windows(t.documents, "doc_id", "text", 128, 16).withColumn("content", F.sha2("content", 256))


#: Windows of 600 tokens at most, from 500 on to the first sentence end, 64 of them shared: tokens with their places, then a walk over each document.
WINDOW_SQL = rf"""
WITH RECURSIVE part AS (SELECT doc_id, unnest(regexp_extract_all(text, '\s*(?:{TOKEN_SQL})')) AS p, unnest(range(len(regexp_extract_all(text, '\s*(?:{TOKEN_SQL})')))) AS k, text FROM documents),
tok AS (SELECT doc_id, k, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) AS b, length(regexp_replace(p, '^\s+', '')) AS n, regexp_replace(p, '^\s+', '') AS w FROM part),
doc AS (SELECT doc_id, count(*) AS total, list(k ORDER BY k) FILTER (WHERE w IN ('.', '!', '?', ';', '。', '！', '？', '；')) AS ends FROM tok GROUP BY doc_id),
cut AS (
  SELECT doc_id, 0 AS win, 0::BIGINT AS lo, CASE WHEN total <= 600 THEN total ELSE coalesce(list_filter(ends, lambda e: e >= 500 AND e < 600)[1] + 1, 500) END AS hi, total, ends FROM doc
  UNION ALL
  SELECT doc_id, win + 1, hi - 64, coalesce(list_filter(ends, lambda e: e >= hi + 436 AND e < least(hi + 536, total))[1] + 1, least(hi + 436, total)), total, ends FROM cut WHERE hi < total)
SELECT c.doc_id, win::BIGINT AS window, (a.b - a.n)::BIGINT AS start, z.b::BIGINT AS stop, (hi - lo)::BIGINT AS tokens, sha256(substr(d.text, (a.b - a.n + 1)::BIGINT, (z.b - a.b + a.n)::BIGINT)) AS content
FROM cut c JOIN tok a ON a.doc_id = c.doc_id AND a.k = c.lo JOIN tok z ON z.doc_id = c.doc_id AND z.k = c.hi - 1 JOIN documents d ON d.doc_id = c.doc_id"""


@query("chunk_sentence_windows", WINDOW_SQL)
def chunk_sentence_windows(t: Tables) -> DataFrame:
    return K.split_texts(t.documents, "doc_id", "text").withColumn("content", F.sha2("content", 256))


@query("chunk_pack_parents", rf"""
WITH RECURSIVE {LINES}, held AS (SELECT doc_id, list(line ORDER BY ord) AS r, list(len(regexp_extract_all(line, '{TOKEN_SQL}')) ORDER BY ord) AS k FROM lines GROUP BY 1),
sums AS (SELECT doc_id, len(r)::BIGINT AS z, list_transform(range(0, len(k) + 1), lambda i: coalesce(list_sum(k[1:i]), 0)::BIGINT) AS c FROM held), {greedy('c[e + 1] - c[{s} + 1] >= 1800 OR c[e + 2] - c[{s} + 1] > 2500')}
SELECT doc_id AS document, n::BIGINT AS parent, s AS first_ord, e - 1 AS last_ord, e - s AS blocks, c[e + 1] - c[s + 1] AS tokens, sha256(array_to_string(h.r[s + 1:e], chr(10) || chr(10))) AS content FROM walk JOIN held h USING (doc_id)""")
def chunk_pack_parents(t: Tables) -> DataFrame:
    lines = B.lines_of(t.documents, "doc_id").withColumn("tokens", T.token_count("line"))
    return K.pack(lines, "doc_id", "ord", "line", "tokens").withColumn("content", F.sha2("content", 256))


def composed(t: Tables) -> DataFrame:
    """Nodes of documents: lines are blocks, some of them headings or tables of one unit."""
    level = F.when(F.length("line") % 5 < 3, F.length("line") % 5 + 1)
    b = B.heading_paths(B.lines_of(t.documents, "doc_id").withColumn("level", level), "doc_id", "ord", "level", "line")
    table = F.col("ord") % 11 == 10
    kind = F.when(table, "table").when(F.col("level").isNotNull(), "heading").otherwise("paragraph")
    b = b.select("doc_id", "ord", kind.alias("kind"), F.col("line").alias("text"), M.effective_heading_path(F.col("heading_path"), kind, F.col("line")).alias("heading_path"), F.when(table, F.array("line")).alias("units"))
    key = K.group_key(F.col("kind"), F.col("heading_path"), F.lit(None).cast("string"), F.when(table, F.col("ord").cast("string")))
    return M.compose(b, "doc_id", "ord", key)


@query("chunk_nodes")
def chunk_nodes(t: Tables) -> DataFrame:
    return composed(t).drop("content")


@query("chunk_report")
def chunk_report(t: Tables) -> DataFrame:
    return K.report(composed(t), ["document"])


@query("structural_groups", f"""
WITH {LINES}, keyed AS (SELECT doc_id, ord, CASE WHEN ord % 7 = 0 THEN 'table:' || (ord // 7) WHEN length(line) % 3 = 0 THEN 'heading:' || left(line, 1) ELSE 'page:' || (ord // 5) END AS key FROM lines),
firsts AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, key) AS f FROM keyed)
SELECT doc_id, ord, dense_rank() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS group_ord FROM firsts""")
def structural_groups(t: Tables) -> DataFrame:
    b = B.lines_of(t.documents, "doc_id")
    table = F.when(F.col("ord") % 7 == 0, F.floor(F.col("ord") / 7).cast("string"))
    path = F.when(F.length("line") % 3 == 0, F.array(F.left("line", F.lit(1)))).otherwise(F.array().cast("array<string>"))
    key = K.group_key(F.lit("paragraph"), path, F.floor(F.col("ord") / 5).cast("string"), table)
    return K.structural_groups(b, "doc_id", "ord", key).select("doc_id", "ord", "group_ord")


@query("retrieval_text", f"""
WITH {LINES}, kw AS (SELECT *, list_slice(list_distinct_order, 1, 16) AS words FROM (SELECT *, list_filter(list_transform(regexp_extract_all(line, '([\\p{{L}}\\p{{N}}_][^\\n:\\x{{ff1a}}]{{0,31}})[:\\x{{ff1a}}]', 1), lambda x: trim(x)), lambda x, i: true) AS list_distinct_order FROM lines))
SELECT doc_id, ord, sha256(concat_ws(chr(10), source, source || ' > ' || doc_id, 'content_types: paragraph', 'source: line ' || (ord + 1), CASE WHEN len(words) > 0 THEN 'keywords: ' || array_to_string(words, ', ') END, line)) AS text FROM kw""")
def retrieval_text(t: Tables) -> DataFrame:
    b = B.lines_of(t.documents, "source", "doc_id")
    path, kinds = F.array("source", F.col("doc_id").cast("string")), F.array(F.lit("paragraph"))
    own = K.retrieval_text(F.col("source"), path, kinds, F.concat(F.lit("line "), F.col("ord") + 1), K.keywords("line"), F.col("line"))
    return b.select("doc_id", "ord", F.sha2(own, 256).alias("text"))


@query("embedding_text", r"""
SELECT doc_id, sha256(concat_ws(chr(10), 'Source document: ' || source, CASE WHEN doc_id % 2 = 1 THEN 'Hierarchy: ' || lang ELSE 'Hierarchy: ' || lang || ' > ' || source END, text)) AS text,
  greatest(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')), ceil(length(text) / 4), 1)::BIGINT AS tokens FROM documents""")
def embedding_text(t: Tables) -> DataFrame:
    path = F.when(F.col("doc_id") % 2 == 1, F.array("source", "lang")).otherwise(F.array("lang", "source"))
    own = K.embedding_text(F.col("source"), path, F.array().cast("array<string>"), F.col("text"))
    return t.documents.select("doc_id", F.sha2(own, 256).alias("text"), K.estimated_tokens(F.size(T.terms("text")), F.col("text")).alias("tokens"))


@query("node_gate", """
WITH n AS (SELECT l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber AS node_id, CASE WHEN l_linenumber = 1 THEN 'parent' ELSE 'child' END AS node_level, l_orderkey || '-1' AS parent_node_id,
  CASE WHEN l_quantity = 1 THEN ' ' ELSE l_returnflag END AS content, (l_quantity::INT % 9)::INT AS source_blocks, CASE WHEN l_tax = 0.08 THEN 'short' ELSE sha256(l_linestatus) END AS content_hash,
  CASE WHEN l_discount = 0.1 THEN 'quarantined' ELSE 'passed' END AS quality_status, l_returnflag = 'A' AS needs_header, l_linestatus = 'F' AND l_quantity > 10 AS has_header FROM lineitem)
SELECT n.l_orderkey, n.l_linenumber, CASE WHEN trim(n.content) = '' THEN 'CONTENT_EMPTY' WHEN n.source_blocks = 0 THEN 'SOURCE_MISSING' WHEN length(n.content_hash) <> 64 THEN 'HASH_INVALID' WHEN n.quality_status NOT IN ('passed', 'warning') THEN 'QUALITY_BLOCKED'
  WHEN n.node_level = 'child' AND p.node_id IS NULL THEN 'PARENT_MISSING' WHEN n.needs_header AND NOT n.has_header THEN 'TABLE_HEADER_MISSING' END AS issue
FROM n LEFT JOIN (SELECT DISTINCT node_id FROM n WHERE node_level = 'parent') p ON n.parent_node_id = p.node_id""")
def node_gate(t: Tables) -> DataFrame:
    n = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("node_id"), F.when(F.col("l_linenumber") == 1, "parent").otherwise("child").alias("node_level"),
        F.concat("l_orderkey", F.lit("-1")).alias("parent_node_id"), F.when(F.col("l_quantity") == 1, " ").otherwise(F.col("l_returnflag")).alias("content"), (F.col("l_quantity").cast("int") % 9).alias("source_blocks"),
        F.when(F.col("l_tax") == 0.08, "short").otherwise(F.sha2("l_linestatus", 256)).alias("content_hash"), F.when(F.col("l_discount") == 0.1, "quarantined").otherwise("passed").alias("quality_status"),
        (F.col("l_returnflag") == "A").alias("needs_header"), ((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 10)).alias("has_header"),
    )
    return K.gate(n).select("l_orderkey", "l_linenumber", "issue")


@query("embed_batches", rf"""
WITH RECURSIVE n AS (SELECT source, doc_id, greatest(len(regexp_extract_all(text, '{TOKEN_SQL}')), ceil(length(text) / 4), 1)::BIGINT AS tokens FROM documents),
fits AS (SELECT source AS doc_id, list(doc_id ORDER BY doc_id) AS r, list(tokens ORDER BY doc_id) AS k FROM n WHERE tokens <= 8000 GROUP BY 1),
sums AS (SELECT doc_id, len(r)::BIGINT AS z, list_transform(range(0, len(k) + 1), lambda i: coalesce(list_sum(k[1:i]), 0)::BIGINT) AS c FROM fits), {greedy('e - {s} >= 128 OR c[e + 2] - c[{s} + 1] > 8000')},
b AS (SELECT w.n AS batch, unnest(f.r[s + 1:e]) AS doc_id FROM walk w JOIN fits f USING (doc_id))
SELECT source, n.doc_id, tokens, coalesce(batch, -1)::BIGINT AS batch FROM n LEFT JOIN b ON b.doc_id = n.doc_id""")
def embed_batches(t: Tables) -> DataFrame:
    n = t.documents.select("source", "doc_id", K.estimated_tokens(T.token_count("text"), F.col("text")).alias("tokens"))
    return K.batches(n, "source", "doc_id", "tokens")


@query("context_islands", f"""
WITH {FUSED_CTES}, p AS (SELECT DISTINCT query_id, doc_id AS p FROM fused WHERE rank <= 60), i AS (SELECT *, p - row_number() OVER (PARTITION BY query_id ORDER BY p) AS g FROM p)
SELECT query_id, min(p) AS first, max(p) AS last, count(*) AS size FROM i GROUP BY query_id, g""")
def context_islands(t: Tables) -> DataFrame:
    return X.islands(fused(t), ["query_id"], "doc_id")


@query("parent_merge_ratio", f"""
WITH {FUSED_CTES}, f AS (SELECT query_id, doc_id // 10 AS parent, count(DISTINCT doc_id) AS found FROM fused WHERE rank <= 60 GROUP BY ALL), c AS (SELECT doc_id // 10 AS parent, count(*) AS children FROM documents GROUP BY 1)
SELECT query_id, parent, found, children, round(found / children, 6) AS ratio, found >= 2 AND found / children >= 0.5 AS merges FROM f JOIN c USING (parent)""")
def parent_merge_ratio(t: Tables) -> DataFrame:
    parent = F.floor(F.col("doc_id") / 10).alias("parent")
    return X.merge_ratio(fused(t).select("query_id", "doc_id", parent), t.documents.select("doc_id", parent), "query_id", "parent", "doc_id")


@query("context_assemble")
def context_assemble(t: Tables) -> DataFrame:
    parent = F.concat(F.lit("p"), F.floor(F.col("doc_id") / 10))
    tokens = F.size(T.terms("text")).cast("long")
    child = t.documents.select(F.concat(F.lit("c"), "doc_id").alias("node_id"), parent.alias("parent_node_id"), F.lit("child").alias("node_level"), F.col("doc_id").alias("ordinal"), F.col("text").alias("content"), tokens.alias("token_count"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "\n\n")
    parents = child.groupBy(F.col("parent_node_id").alias("node_id")).agg(F.lit(None).cast("string").alias("parent_node_id"), F.lit("parent").alias("node_level"), F.min("ordinal").alias("ordinal"), whole.alias("content"), F.sum("token_count").alias("token_count"))
    ranked = fused(t).select("query_id", F.concat(F.lit("c"), "doc_id").alias("node_id"), "rank")
    return X.assemble(ranked, X.load_nodes(ranked, child.unionByName(parents), "query_id"), "query_id")


@query("common_heading_path", """
WITH a AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, r, ['user', 'assistant', 'user', 'system'] AS p FROM a),
c AS (SELECT *, list_min(list_transform(range(1, least(len(r), len(p)) + 1), lambda i: CASE WHEN r[i] <> p[i] THEN i END)) AS stop FROM b)
SELECT conv_id, array_to_string(r[1:coalesce(stop - 1, least(len(r), len(p)))], ' > ') AS common FROM c""")
def common_heading_path(t: Tables) -> DataFrame:
    roles = t.conversations.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    return roles.select("conv_id", F.array_join(X.common_prefix(F.col("r"), F.array(*map(F.lit, ["user", "assistant", "user", "system"]))), " > ").alias("common"))


@query("conversation_history", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations QUALIFY back <= 6")
def conversation_history(t: Tables) -> DataFrame:
    return V.history(t.conversations, "conv_id", [F.desc("turn")]).select("conv_id", "turn", "role", "back")


@query("citations_extract", r"""
WITH answers AS (SELECT conv_id, turn, '[S' || (turn % 4 + 1) || '] ' || text || ' [S' || (length(text) % 5 + 1) || '][S1]' AS answer FROM conversations WHERE role = 'assistant'),
labels AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(answer, '\[(S\d+)\]', 1)) AS label FROM answers), sources AS (SELECT conv_id, 'S' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS label, left(text, 500) AS excerpt FROM conversations)
SELECT conv_id, turn, label AS source_label, row_number() OVER (PARTITION BY conv_id, turn ORDER BY substr(label, 2)::INT) AS citation_index, sha256(excerpt) AS excerpt FROM labels JOIN sources USING (conv_id, label)""")
def citations_extract(t: Tables) -> DataFrame:
    answers = t.conversations.filter("role = 'assistant'").withColumn("message", F.struct("conv_id", "turn"))
    answers = answers.withColumn("answer", F.concat(F.lit("[S"), F.col("turn") % 4 + 1, F.lit("] "), "text", F.lit(" [S"), F.length("text") % 5 + 1, F.lit("][S1]")))
    labelled = V.label_sources(t.conversations, "conv_id", "turn").select("conv_id", "source_label", F.col("text").alias("content"))
    sources = answers.select("message", "conv_id").join(labelled, "conv_id").drop("conv_id")
    return V.citations(answers, sources, "message", "answer").select("message.conv_id", "message.turn", "source_label", "citation_index", F.sha2("excerpt", 256).alias("excerpt"))


@query("grounded_prompts", """
WITH s AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, sha256(string_agg('[S' || n || '] turn ' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY n) || chr(10) || chr(10) || 'Question ' || conv_id) AS prompt, count(*)::BIGINT AS sources FROM s GROUP BY conv_id""")
def grounded_prompts(t: Tables) -> DataFrame:
    s = V.label_sources(t.conversations, "conv_id", "turn")
    s = s.withColumn("block", V.source_block(F.col("source_label"), F.concat(F.lit("turn "), "turn"), F.lit(""), F.col("text"))).withColumn("question", F.concat(F.lit("Question "), "conv_id"))
    return V.grounded_prompt(s, "conv_id", F.col("question")).withColumn("prompt", F.sha2("prompt", 256))


@query("usage_cost", """
SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN NULL ELSE (l_quantity * 3.0 + l_extendedprice * coalesce(CASE WHEN l_returnflag = 'A' THEN NULL ELSE 15.0 END, 0)) / 1e6 END), 9) AS cost FROM lineitem GROUP BY l_orderkey""")
def usage_cost(t: Tables) -> DataFrame:
    price_in = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), None).otherwise(3.0)
    price_out = F.when(F.col("l_returnflag") == "A", None).otherwise(15.0)
    priced = t.lineitem.select("l_orderkey", V.cost(F.col("l_quantity"), F.col("l_extendedprice"), price_in, price_out).alias("cost"))
    return priced.groupBy("l_orderkey").agg(F.round(F.sum("cost"), 9).alias("cost"))


@query("agent_routes", """
SELECT role, CASE WHEN turn % 3 = 0 THEN 'retrieve' WHEN conv_id % 2 = 0 THEN 'documents' ELSE 'direct' END AS route, count(*)::BIGINT AS messages FROM conversations GROUP BY ALL""")
def agent_routes(t: Tables) -> DataFrame:
    calls = F.when(F.col("turn") % 3 == 0, F.array(F.lit("retrieve"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return t.conversations.withColumn("route", V.route(calls, F.col("conv_id") % 2 == 0)).groupBy("role", "route").agg(F.count("*").alias("messages"))


@query("sibling_ordinals", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS ordinal, count(*) OVER (PARTITION BY l_orderkey) AS siblings FROM lineitem")
def sibling_ordinals(t: Tables) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.row_number().over(w.orderBy("l_linenumber")) - 1).cast("long").alias("ordinal"), F.count("*").over(w).alias("siblings"))
