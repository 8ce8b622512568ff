"""Traces of retrieval and answers, reviews and reads of a graph, and measures taken from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The tool that an action asks for.
TOOLS = {"documents": "retrieve_enterprise_documents", "relationships": "retrieve_enterprise_relationships"}


def representatives(contexts: DataFrame, candidates: DataFrame, query: str) -> DataFrame:
    """For each context (query, ord, children) its first child that is a candidate (query, node_id); a node stands for the first such context only."""
    children = contexts.select(query, "ord", F.posexplode("children").alias("at", "node_id"))
    first = children.join(candidates.select(query, "node_id").distinct(), [query, "node_id"]).groupBy(query, "ord").agg(F.min(F.struct("at", "node_id")).alias("m"))
    return first.groupBy(query, F.col("m.node_id").alias("node_id")).agg(F.min("ord").alias("ord"))


def retrieval_trace(stages: DataFrame, query: str) -> DataFrame:
    """One row a query of its stages (ord, stage, status, latency_ms, tokens, cost_usd): snapshots in order, sums, and status: failed where every stage is, degraded where some are."""
    rows = stages.groupBy(query).agg(
        F.sort_array(F.collect_list(F.struct("ord", "stage", "status", "latency_ms"))).alias("stages"), F.sum("latency_ms").alias("latency_ms"),
        F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("cost_usd"), F.count_if(F.col("status") == "failed").alias("__failed"), F.count("*").alias("__all"),
    )
    status = F.when(F.col("__failed") == F.col("__all"), "failed").when(F.col("__failed") > 0, "degraded").otherwise("succeeded")
    return rows.withColumn("status", status).drop("__failed", "__all")


def message_trace(messages: DataFrame, retrievals: DataFrame, invocations: DataFrame, citations: DataFrame) -> DataFrame:
    """messages (message_id, retrieval_id, invocation_id) with what there is of their retrieval, invocation and citations (label, node_id, in the labels' order)."""
    cited = citations.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("label", "node_id"))).alias("citations"))
    out = messages.join(retrievals, "retrieval_id", "left").join(invocations, "invocation_id", "left").join(cited, "message_id", "left")
    return out.withColumn("citations", F.coalesce("citations", F.array().cast(cited.schema["citations"].dataType)))


def graph_trace_metrics(expected_path: Column, path_text: Column, status: Column, generated: Column, validated: Column, valid: Column, expected: Column) -> Column:
    """Scores of one graph question: whether all of the path was found (null: none is expected), and what became of its Cypher."""
    def there(c: Column) -> Column:
        return F.coalesce(c != "", F.lit(False))

    def score(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    outcome = ((expected == "success") & (status == "succeeded")) | ((expected == "fallback") & (status == "fallback")) | ((expected == "safe_rejection") & (status == "rejected"))
    return F.struct(
        F.when(F.size(expected_path) > 0, score(F.forall(expected_path, lambda x: F.contains(F.lower(path_text), F.lower(x))))).alias("graph_path_hit"),
        score(there(generated)).alias("syntax_pass"),
        score(F.coalesce(valid, F.lit(False)) | there(validated)).alias("schema_compliance"),
        score(status == "succeeded").alias("execution_success"),
        score(status == "rejected").alias("safe_rejection"),
        F.when(there(expected), score(outcome)).alias("expected_outcome"),
    )


def path_fact_key(path: Column) -> Column:
    """The key of a fact in a path's map, whichever names its parts have; null where one is missing or empty."""
    def part(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at(path, F.lit(n)), F.lit("")) for n in names])

    parts = part("subject", "source", "from"), part("predicate", "relationship", "relation"), part("object", "target", "to")
    return F.lower(F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2]))


def golden_issues(samples: DataFrame) -> DataFrame:
    """issue: the first thing wrong with a sample (id, expected_answer, rubric, answerable, expected_action, expected_tool, documents, nodes, tags); null: nothing."""
    def empty(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) < 1

    tool = F.lit(None).cast("string")
    for action, name in TOOLS.items():
        tool = F.when(F.col("expected_action") == action, name).otherwise(tool)
    again = samples.groupBy("id").agg(F.count("*").alias("__n"))
    issue = (
        F.when((F.coalesce("expected_answer", F.lit("")) == "") & empty("rubric"), "EXPECTATION_MISSING")
        .when(F.col("answerable") & ~F.col("expected_action").eqNullSafe(F.lit("direct")) & empty("documents") & empty("nodes"), "RELEVANCE_MISSING")
        .when(F.col("expected_tool").isNotNull() & ~F.col("expected_tool").eqNullSafe(tool), "TOOL_MISMATCH")
        .when(F.size(F.array_distinct("tags")) != F.size("tags"), "TAGS_REPEATED")
        .when(F.col("__n") > 1, "ID_REPEATED")
    )
    return samples.join(again, "id").withColumn("issue", issue).drop("__n")


def document_recall(samples: DataFrame, ranked: DataFrame, relevant: DataFrame, query: str, most: int = 10) -> DataFrame:
    """parent_document_recall: of a sample's relevant documents, the share among the first ten of its hits; no_answer_retrieval_empty: 1 where an unanswerable sample without relevant documents has no hits, 0 where it has. The one that doesn't apply is null."""
    wanted = relevant.select(query, "document").distinct()
    top = ranked.filter(F.col("rank") <= most).select(query, "document").distinct().withColumn("__hit", F.lit(1))
    found = wanted.join(top, [query, "document"], "left").groupBy(query).agg(F.count("*").alias("__all"), F.count("__hit").alias("__found"))
    hits = ranked.groupBy(query).agg(F.count("*").alias("__hits"))
    out = samples.select(query, "answerable").join(found, query, "left").join(hits, query, "left").fillna(0, ["__all", "__found", "__hits"])
    lost = (F.col("__all") == 0) & ~F.col("answerable")
    recall = F.when(~lost, F.when(F.col("__all") > 0, F.col("__found") / F.col("__all")).otherwise(0.0))
    return out.select(query, recall.alias("parent_document_recall"), F.when(lost, (F.col("__hits") == 0).cast("double")).alias("no_answer_retrieval_empty"))


# Graph: inputs of an extraction, its usage, reviews of facts, and a document's graph.


def extraction_inputs(versions: DataFrame, nodes: DataFrame, digest: str) -> DataFrame:
    """version_id, parents, input_hash: parents that passed or were warned of, and what tells one input from another; null where there are none.

    nodes: version_id, node_id, node_level, quality_status, text_hash; digest: the schema's. A version's parents are few.
    """
    good = nodes.filter((F.col("node_level") == "parent") & F.col("quality_status").isin("passed", "warning"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text_hash"))), lambda x: F.concat_ws(":", x["node_id"].cast("string"), x["text_hash"]))
    each = good.groupBy("version_id").agg(F.count("*").alias("parents"), F.sha2(F.concat_ws("\n", F.lit(digest), F.array_join(lines, "\n")), 256).alias("input_hash"))
    return versions.select("version_id").join(each, "version_id", "left").fillna(0, ["parents"])


def usage_snapshot(outcomes: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Sums of an extraction's outcomes (status, input_tokens, output_tokens, latency_ms); parents without any count as failed. parents: key, parent_count."""
    sums = outcomes.groupBy(key).agg(
        F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("__failed"),
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), F.sum("latency_ms").alias("latency_ms"),
    )
    out = parents.join(sums, key, "left").fillna(0, ["succeeded", "__failed", "input_tokens", "output_tokens", "latency_ms"])
    failed = F.greatest(F.col("__failed"), F.col("parent_count") - F.col("succeeded"))
    ratio = F.when(F.col("parent_count") > 0, F.round(failed / F.col("parent_count"), 6)).otherwise(0.0)
    return out.withColumn("failed", failed).withColumn("failed_ratio", ratio).withColumn("latency_ms", F.round("latency_ms", 3)).drop("__failed")


def review_facts(facts: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (fact_id, review_status, manual_lock, active) after reviews (fact_id, at, approve), and the audit: a row for each review, with the status before and after."""
    after = F.when(F.col("approve"), "approved").otherwise("rejected")
    known = reviews.join(facts.select("fact_id", F.col("review_status").alias("__status")), "fact_id").withColumn("after", after)
    before = F.coalesce(F.lag("after").over(Window.partitionBy("fact_id").orderBy("at")), F.col("__status"))
    audit = known.withColumn("before", before).withColumn("action", F.when(F.col("approve"), "approve").otherwise("reject")).drop("__status")
    last = reviews.groupBy("fact_id").agg(F.max(F.struct("at", "approve")).alias("__l"))
    done = F.col("__l.approve")
    out = facts.join(last, "fact_id", "left").withColumns(
        {"review_status": F.when(done, "approved").when(~done, "rejected").otherwise(F.col("review_status")), "active": F.coalesce(done, F.col("active")), "manual_lock": F.col("manual_lock") | done.isNotNull()}
    )
    return out.drop("__l"), audit


def document_graph(versions: DataFrame, evidence: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a version's graph has: entities, facts, evidence, parents. Evidence counts that is active and of an active fact that isn't rejected.

    evidence: version_id, fact_id, active; facts: fact_id, subject, object, active, review_status; nodes: version_id, node_level.
    """
    live = facts.filter("active AND review_status <> 'rejected'").select("fact_id", "subject", "object")
    held = evidence.filter("active").select("version_id", "fact_id").join(live, "fact_id")
    counts = held.groupBy("version_id").agg(F.count("*").alias("evidence"), F.count_distinct("fact_id").alias("facts"))
    ends = held.select("version_id", F.explode(F.array("subject", "object")).alias("e")).groupBy("version_id").agg(F.count_distinct("e").alias("entities"))
    parents = nodes.filter("node_level = 'parent'").groupBy("version_id").agg(F.count("*").alias("parents"))
    out = versions.select("version_id").join(counts, "version_id", "left").join(ends, "version_id", "left").join(parents, "version_id", "left")
    return out.fillna(0, ["evidence", "facts", "entities", "parents"])
