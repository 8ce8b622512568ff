"""Queries of parsers, tables, sources, guarded graph queries and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import blocks as B
from docquarry.operators import cypher as C
from docquarry.operators import parsing as P
from docquarry.operators import tables as H
from docquarry.plans.registry import LINES, Tables, query
from docquarry.sources import files as S
from docquarry.streaming import events as E
from docquarry.streaming.deferral import deferred


@query("html_blocks")
def html_blocks(t: Tables) -> DataFrame:
    return P.parse(t.pages, "page_id", "html", P.html)


@query("html_block_ids")
def html_block_ids(t: Tables) -> DataFrame:
    blocks = P.parse(t.pages, "page_id", "html", P.html)
    return blocks.select("page_id", "ord", B.block_id(F.col("page_id").cast("string"), F.col("locator")).alias("block_id"))


@query("html_heading_paths")
def html_heading_paths(t: Tables) -> DataFrame:
    blocks = P.parse(t.pages, "page_id", "html", P.html)
    return B.heading_paths(blocks, "page_id", "ord", "level", "text").select("page_id", "ord", "kind", F.array_join("heading_path", " > ").alias("path"))


@query("plain_paragraphs")
def plain_paragraphs(t: Tables) -> DataFrame:
    return P.parse(t.documents, "doc_id", "text", P.plain).select("doc_id", "ord", F.length("text").alias("chars"), "locator")


@query("markdown_blocks")
def markdown_blocks(t: Tables) -> DataFrame:
    text = F.concat(F.lit("# "), "source", F.lit("\n\n- "), F.replace("text", F.lit("\n"), F.lit("\n- ")))
    return P.parse(t.documents.select("doc_id", text.alias("text")), "doc_id", "text", P.markdown).groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"))


@query("html_tables")
def html_tables(t: Tables) -> DataFrame:
    row = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("<tr><td>"), F.array_join(F.split(x, r" \| |, "), "</td><td>"), F.lit("</td></tr>")))
    found = t.documents.select("doc_id", F.concat(F.lit("<table>"), F.array_join(row, ""), F.lit("</table>")).alias("html"))
    model = found.select("doc_id", H.table_model("html").alias("m"), H.table_units("html").alias("units"))
    return model.select("doc_id", "m.kind", "m.confidence", "m.rows", "m.columns", "m.status", F.sha2(H.linear_text("m.grid"), 256).alias("text"), F.size("units").alias("units"))


@query("table_grid_stats", rf"""
WITH {LINES}, c AS (SELECT doc_id, ord, trim(unnest(string_split(line, ','))) AS cell FROM lines)
SELECT doc_id, ord, count(*)::BIGINT AS cells, count(*) FILTER (WHERE len(regexp_extract_all(cell, '[0-9.,%\x{{ffe5}}$\x{{a5}}+-]')) / greatest(len(regexp_extract_all(cell, '\S')), 1) >= 0.6)::BIGINT AS numeric_cells FROM c GROUP BY ALL""")
def table_grid_stats(t: Tables) -> DataFrame:
    cells = B.lines_of(t.documents, "doc_id").select("doc_id", "ord", F.explode(F.transform(F.split("line", ","), lambda x: F.trim(x))).alias("cell"))
    return cells.groupBy("doc_id", "ord").agg(F.count("*").alias("cells"), F.count_if(H.numeric_share("cell") >= H.NUMERIC_SHARE).alias("numeric_cells"))


@query("table_padding", rf"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: string_split(x, ' | ')) AS rows FROM documents), w AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS width FROM l)
SELECT doc_id, width::BIGINT AS columns, len(rows)::BIGINT AS rows, sha256(array_to_string(list_transform(rows, lambda r: array_to_string(r || list_transform(range(len(r), width), lambda i: ''), chr(9))), chr(10))) AS text FROM w""")
def table_padding(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", H.padded(F.transform(F.split("text", "\n"), lambda x: F.split(x, r" \| "))).alias("grid"))
    return rows.select("doc_id", F.size(F.col("grid")[0]).cast("long").alias("columns"), F.size("grid").cast("long").alias("rows"), F.sha2(H.linear_text("grid"), 256).alias("text"))


@query("parser_dispatch", """
WITH f AS (SELECT page_id, 'p' || page_id || CASE page_id % 4 WHEN 0 THEN '.HTML' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' ELSE '.exe' END AS name FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'markdown' WHEN 2 THEN 'layout' END AS parser, page_id % 4 <> 3 AS allowed FROM f""")
def parser_dispatch(t: Tables) -> DataFrame:
    name = F.concat(F.lit("p"), "page_id", F.when(F.col("page_id") % 4 == 0, ".HTML").when(F.col("page_id") % 4 == 1, ".md").when(F.col("page_id") % 4 == 2, ".pdf").otherwise(".exe"))
    return t.pages.select("page_id", P.parser_for(name).alias("parser"), S.allowed(name).alias("allowed"))


@query("content_kinds", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'text' ELSE 'ole' END AS kind FROM pages")
def content_kinds(t: Tables) -> DataFrame:
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(b"%PDF-1.7"), F.col("html").cast("binary"))).when(F.col("page_id") % 3 == 1, F.col("html").cast("binary")).otherwise(F.concat(F.unhex(F.lit(S.OLE)), F.col("html").cast("binary")))
    return t.pages.select("page_id", S.content_kind(body).alias("kind"))


@query("layout_blocks", f"""
WITH {LINES}, items AS (SELECT doc_id, ord, CASE ord % 5 WHEN 0 THEN 'header' WHEN 3 THEN 'table' WHEN 4 THEN 'seal' ELSE 'text' END AS type, line AS text, CASE WHEN ord % 5 = 1 THEN 1 ELSE 0 END AS text_level, (ord // 6) AS page_idx FROM lines),
kept AS (SELECT doc_id, page_idx + 1 AS page, CASE WHEN type = 'text' AND text_level > 0 THEN 'heading' WHEN type = 'text' THEN 'paragraph' WHEN type = 'table' THEN 'table' ELSE 'note' END AS kind FROM items WHERE type <> 'header')
SELECT doc_id, page, kind, count(*)::BIGINT AS blocks FROM (SELECT * FROM kept UNION ALL SELECT DISTINCT doc_id, page, 'page' FROM kept) GROUP BY ALL""")
def layout_blocks(t: Tables) -> DataFrame:
    n = F.col("ord") % 5
    items = B.lines_of(t.documents, "doc_id").select("doc_id", "ord", F.when(n == 0, "header").when(n == 3, "table").when(n == 4, "seal").otherwise("text").alias("type"), F.col("line").alias("text"), F.when(n == 1, 1).otherwise(0).alias("text_level"), F.floor(F.col("ord") / 6).alias("page_idx"))
    return P.layout_blocks(items, "doc_id", "ord").groupBy("doc_id", "page", "kind").agg(F.count("*").alias("blocks"))


@query("best_output", """
WITH c AS (SELECT l_orderkey, l_linenumber AS priority, l_partkey % 300 AS items, l_suppkey % 3 AS th, l_quantity::INT % 2 AS ti, l_quantity::INT % 3 AS ex FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)),
s AS (SELECT *, least(items, 10000) + 100 * th - 5000 * ti + CASE WHEN ex > 0 AND th = 0 THEN -100000 ELSE 100000 END AS score FROM c)
SELECT l_orderkey, priority, score::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, priority) = 1""")
def best_output(t: Tables) -> DataFrame:
    one = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x"))
    n = F.col("x.l_quantity").cast("int")
    c = one.select("l_orderkey", F.col("l_linenumber").alias("priority"), (F.col("x.l_partkey") % 300).alias("items"), (F.col("x.l_suppkey") % 3).alias("tables_html"), (n % 2).alias("tables_image"), (n % 3).alias("expected_tables"))
    return P.best_output(c, "l_orderkey").select("l_orderkey", "priority", F.col("score").cast("long").alias("score"))


@query("safe_names")
def safe_names(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.safe_names("url").alias("name"))


@query("provider_embeddings")
def provider_embeddings(t: Tables) -> DataFrame:
    return S.embed(t.documents, "doc_id", "text").select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


@query("masked_logs", r"""
SELECT event_id, regexp_replace('Bearer k' || event_id || ' https://u:p' || event_id || '@host/x', '^Bearer \S+ https://\S+@host', 'Bearer [REDACTED] https://[REDACTED]@host') AS line FROM events""")
def masked_logs(t: Tables) -> DataFrame:
    line = F.concat(F.lit("Bearer k"), "event_id", F.lit(" https://u:p"), "event_id", F.lit("@host/x"))
    return t.events.select("event_id", T.masked(line).alias("line"))


@query("normalized_queries", r"""
SELECT item_id, sha256(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' +([,.;:!?])', '\1', 'g')) AS query FROM benchmark""")
def normalized_queries(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.sha2(T.normalize_query("text"), 256).alias("query"))


@query("cypher_path", """
SELECT s_name AS supplier, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 1000 AND contains(r_name, 'A') ORDER BY 1, 2, 3 LIMIT 50""")
def cypher_path(t: Tables) -> DataFrame:
    nodes = {
        "Supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
        "Nation": t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")),
        "Region": t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")),
    }
    relations = {
        "BASED_IN": t.supplier.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst")),
        "IN_REGION": t.nation.select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst")),
    }
    allowed = C.Allowed(frozenset(nodes), frozenset(relations), frozenset({"name", "balance"}))
    text = "MATCH (s:Supplier)-[:BASED_IN]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE s.balance > 1000 AND r.name CONTAINS 'A' RETURN s.name AS supplier, n.name AS nation, r.name AS region LIMIT 80"
    return C.compile_path(text, nodes, relations, allowed)


def event_stream(t: Tables) -> DataFrame:
    return E.timed(E.read(t.spark, f"{t.folder}/events.parque*", t.events.schema))


@query("stream_tumbling", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, count(*)::BIGINT AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(t: Tables) -> DataFrame:
    out = E.windowed(event_stream(t), ["event_type"], "ts", "1 hour", None, F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return E.finished(out.select("event_type", F.unix_micros("window.start").alias("start"), "events", "total"), "complete")


@query("stream_sliding", """
SELECT user_id, (epoch_us(ts) // 30000000 - i) * 30000000 AS start, count(*)::BIGINT AS calls FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY ALL""")
def stream_sliding(t: Tables) -> DataFrame:
    out = E.windowed(event_stream(t), ["user_id"], "ts", "60 seconds", "30 seconds", F.count("*").alias("calls"))
    return E.finished(out.select("user_id", F.unix_micros("window.start").alias("start"), "calls"), "complete")


@query("stream_sessions", """
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 300000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(epoch_us(ts)) AS start, count(*)::BIGINT AS events FROM s GROUP BY user_id, session""")
def stream_sessions(t: Tables) -> DataFrame:
    out = E.sessions(event_stream(t), ["user_id"], "ts", "5 minutes", F.count("*").alias("events"))
    return E.finished(out.select("user_id", F.unix_micros("window.start").alias("start"), "events"), "complete")


@query("stream_deduplicated", "SELECT DISTINCT event_id, event_type FROM events")
def stream_deduplicated(t: Tables) -> DataFrame:
    return E.finished(E.deduplicated(event_stream(t), ["event_id"]).select("event_id", "event_type"))


@query("stream_admission")
def stream_admission(t: Tables) -> DataFrame:
    return E.finished(E.admission(event_stream(t).withColumn("tokens", F.col("value") * 100), "user_id", "event_id", "ts", "tokens"))


@query("stream_deferral")
def stream_deferral(t: Tables) -> DataFrame:
    """Calls beyond the limit wait and are let go: one row when a call comes, one when a timer releases it."""
    return E.finished(deferred(event_stream(t).withColumn("tokens", F.col("value") * 100), "user_id", "event_id", "ts", "tokens"))
