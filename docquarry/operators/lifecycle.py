"""Index projections and their life: what is projected, rebuilt, hidden, restored and purged; resumed runs; health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a graph after which a build has to be forced.
BUILT = ("succeeded", "stale", "hidden")


def document_projection(versions: DataFrame, canonical: DataFrame) -> DataFrame:
    """versions (version_id, display_name, ...) with title and language of their latest canonical document (version_id, run, title, language); without a title, the display name."""
    last = canonical.groupBy("version_id").agg(F.max(F.struct("run", "title", "language")).alias("c"))
    title = F.when(F.coalesce(F.col("c.title"), F.lit("")) != "", F.col("c.title")).otherwise(F.col("display_name"))
    return versions.join(last, "version_id", "left").withColumn("title", title).withColumn("language", F.col("c.language")).withColumn("status", F.lit("ready")).withColumn("is_active", F.lit(False)).drop("c")


def sorted_unique(locators: Column | str, field: str) -> Column:
    """The values of a field of locators, each once, sorted; nulls and empty strings left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(locators, lambda x: x[field]), lambda v: v.isNotNull() & (v.cast("string") != ""))))


def node_projection(nodes: DataFrame, locators: str, summary: str) -> DataFrame:
    """nodes with the fields an index filters by: pages, slides, sheets, ranges, and quality score and flags of the summary (overall_score, issue_codes)."""
    fields = {"page_numbers": "page_number", "slide_numbers": "slide_number", "sheet_names": "sheet_name", "cell_ranges": "cell_range"}
    out = nodes.withColumns({name: sorted_unique(locators, field) for name, field in fields.items()})
    return out.withColumns({"quality_score": F.col(f"{summary}.overall_score").cast("double"), "quality_flags": F.coalesce(F.col(f"{summary}.issue_codes"), F.array().cast("array<string>")), "is_active": F.lit(False)})


def replaced(known: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Nodes after a rerun: those of the same version and configuration make room for the fresh ones."""
    return known.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def rebuild(documents: DataFrame, versions: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes to project anew: of each document's current version, if it is ready, those of the latest run that has embedded nodes.

    documents: document_id, current_version_id; versions: version_id, status; nodes: version_id, run, finished_at, embedded.
    """
    ready = documents.join(versions.filter("status = 'ready'"), F.col("current_version_id") == F.col("version_id")).select("document_id", "version_id")
    held = nodes.filter("embedded").join(ready, "version_id")
    last = held.groupBy("version_id").agg(F.max(F.struct("finished_at", "run")).alias("__last"))
    return held.join(last, "version_id").filter(F.col("run") == F.col("__last.run")).drop("__last")


def apply_lifecycle(projection: DataFrame, actions: DataFrame) -> DataFrame:
    """A projection (document_id, version_id, current_version_id, is_active, index_status) after each document's last action (document_id, at, action).

    delete: hidden and stale; restore: rows of the current version are visible, others stay hidden; purge: gone.
    """
    last = actions.groupBy("document_id").agg(F.max(F.struct("at", "action")).alias("__l"))
    out = projection.join(last, "document_id", "left").withColumn("__a", F.coalesce(F.col("__l.action"), F.lit("none"))).filter("__a <> 'purge'")
    current = F.col("version_id").eqNullSafe(F.col("current_version_id"))
    active = F.when(F.col("__a") == "delete", False).when(F.col("__a") == "restore", current).otherwise(F.col("is_active"))
    status = F.when(F.col("__a") == "delete", "stale").when((F.col("__a") == "restore") & current, "indexed").otherwise(F.col("index_status"))
    return out.withColumn("is_active", active).withColumn("index_status", status).drop("__l", "__a")


def capability_issue(knn: Column, icu: Column) -> Column:
    """Why an index service can't be used; null: it can."""
    return F.when(~(F.coalesce(knn, F.lit(False)) & F.coalesce(icu, F.lit(False))), "INDEX_REQUIRED_PLUGIN_MISSING")


def resumed_batches(batches: DataFrame, pending: DataFrame) -> DataFrame:
    """Batches (batch_id, node_ids) of a run that was stopped, with what is still pending (node_id, tokens) of each, in order: node_ids, tokens. Batches without any are left out."""
    each = batches.select("batch_id", F.posexplode("node_ids").alias("at", "node_id")).join(pending.select("node_id", "tokens"), "node_id")
    kept = each.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("at", "node_id"))).alias("l"), F.sum("tokens").alias("tokens"))
    return kept.select("batch_id", F.transform("l", lambda x: x["node_id"]).alias("node_ids"), "tokens")


def reevaluations(assessments: DataFrame, actions: DataFrame) -> DataFrame:
    """requested: whether some review action asks to evaluate the assessment again."""
    asked = actions.filter("action = 're_evaluate'").select("assessment_id").distinct().withColumn("requested", F.lit(True))
    return assessments.join(asked, "assessment_id", "left").fillna(False, ["requested"])


def queue_health(jobs: DataFrame, queue: str, waiting: Column, warning_depth: int) -> DataFrame:
    """depth and status of each queue."""
    depth = jobs.groupBy(queue).agg(F.count_if(waiting).alias("depth"))
    return depth.withColumn("status", F.when(F.col("depth") >= warning_depth, "warning").otherwise("ok"))


def chat_request_issue(messages: Column | str, most: int = 100) -> Column:
    """Why a request's messages (role, parts of type and text, content) are refused: their number, or a last one that isn't the user's or has no text. Null: they aren't."""
    last = F.try_element_at(F.col(messages) if isinstance(messages, str) else messages, F.lit(-1))
    said = F.array_join(F.transform(F.filter(last["parts"], lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    text = F.when(F.coalesce(said, F.lit("")) != "", said).otherwise(F.coalesce(last["content"], F.lit("")))
    n = F.coalesce(F.size(messages), F.lit(0))
    return F.when((n < 1) | (n > most), "MESSAGES_COUNT_INVALID").when((last["role"] != "user") | (F.trim(text) == ""), "LATEST_MESSAGE_INVALID")


def forced_build(force: Column, active: Column, projected_at: Column, status: Column) -> Column:
    """Whether a graph build replaces an earlier one: asked for, or the version has been projected before."""
    return F.coalesce(force, F.lit(False)) | F.coalesce(active, F.lit(False)) | projected_at.isNotNull() | F.coalesce(status.isin(*BUILT), F.lit(False))


def build_states(events: DataFrame, build: str, *order: str) -> DataFrame:
    """build, state, refused: of builds' events (`to`), those that the state before allows are taken in order, the others are refused.

    queued -> running -> succeeded or failed; queued -> cancelled. A build has a few events.
    """
    allowed = {"queued": ("running", "cancelled"), "running": ("succeeded", "failed")}

    def step(s: Column, e: Column) -> Column:
        ok = F.lit(False)
        for state, to in allowed.items():
            ok = ok | ((s["state"] == state) & e["to"].isin(*to))
        return F.struct(F.when(ok, e["to"]).otherwise(s["state"]).alias("state"), (s["refused"] + F.when(ok, 0).otherwise(1)).cast("long").alias("refused"))

    rows = events.groupBy(build).agg(F.sort_array(F.collect_list(F.struct(*order, "to"))).alias("l"))
    start = F.struct(F.lit("queued").alias("state"), F.lit(0).cast("long").alias("refused"))
    return rows.select(build, F.aggregate("l", start, step).alias("s")).select(build, "s.*")


