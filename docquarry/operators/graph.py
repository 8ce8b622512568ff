"""A reified property graph in three tables: entities, facts between them, and the evidence of facts."""

from __future__ import annotations

import json
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docquarry.sources.scratch import checkpointed

#: Fixed value: the namespace of entity and fact ids.
GRAPH_SPACE = uuid.UUID("0f4f8ac8-56af-57da-9b1f-ff6a10442383")


@F.pandas_udf(StringType())
def graph_id(key: pd.Series) -> pd.Series:
    return key.map(lambda k: None if k is None else str(uuid.uuid5(GRAPH_SPACE, k)))


def entity_id(kind: Column, name: Column) -> Column:
    return graph_id(F.concat_ws(":", F.lit("entity"), kind, name))


def fact_id(subject: Column, predicate: Column, object_: Column) -> Column:
    return graph_id(F.concat_ws(":", F.lit("fact"), subject, predicate, object_))


def canonical(names: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """canonical_name: what an alias table (alias, canonical) says of a name, or the name."""
    return names.join(aliases.select(F.col("alias").alias("__alias"), F.col("canonical").alias("__canonical")), F.col(name) == F.col("__alias"), "left").withColumn("canonical_name", F.coalesce("__canonical", name)).drop("__alias", "__canonical")


def permitted(triples: DataFrame, schema: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triples that a schema (subject_type, predicate, object_type) allows, and the others."""
    key = ["subject_type", "predicate", "object_type"]
    allowed = schema.select(*key).distinct()
    return triples.join(allowed, key, "left_semi"), triples.join(allowed, key, "left_anti")


def upsert_entities(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Entities (entity_type, name, aliases, manual_lock) after an extraction: matched by type and name, then by an alias of a locked one; aliases are united unless the entity is locked."""
    new = incoming.groupBy("entity_type", "name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("new_aliases"))
    locked = known.filter("manual_lock").select("entity_type", F.explode("aliases").alias("name"), F.col("name").alias("target")).groupBy("entity_type", "name").agg(F.min("target").alias("target"))
    names = known.select("entity_type", "name", F.lit(True).alias("exact"))
    matched = new.join(names, ["entity_type", "name"], "left").join(locked, ["entity_type", "name"], "left")
    to = matched.withColumn("name", F.when(F.col("exact").isNull(), F.coalesce("target", "name")).otherwise(F.col("name"))).groupBy("entity_type", "name").agg(F.flatten(F.collect_list("new_aliases")).alias("new_aliases"))
    both = known.join(to, ["entity_type", "name"], "full")
    united = F.array_sort(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("new_aliases", F.array().cast("array<string>"))))
    lock = F.coalesce("manual_lock", F.lit(False))
    return both.select("entity_type", "name", F.when(lock, F.col("aliases")).otherwise(united).alias("aliases"), lock.alias("manual_lock"))


def upsert_facts(known: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (subject, predicate, object, confidence, review_status, manual_lock, active) after an extraction, and the conflicts with locked ones.

    The larger confidence stays; a fact is active again unless it was rejected; a locked fact stays as it is, and a
    different confidence is a conflict.
    """
    key = ["subject", "predicate", "object"]
    new = incoming.groupBy(*key).agg(F.max("confidence").alias("new_confidence"))
    both = known.join(new, key, "full")
    lock, fresh = F.coalesce("manual_lock", F.lit(False)), F.col("new_confidence").isNotNull()
    out = both.select(
        *key,
        F.when(lock, F.col("confidence")).otherwise(F.greatest("confidence", "new_confidence")).alias("confidence"),
        F.coalesce("review_status", F.lit("unreviewed")).alias("review_status"), lock.alias("manual_lock"),
        F.when(lock, F.col("active")).when(fresh, F.coalesce("review_status", F.lit("")) != "rejected").otherwise(F.col("active")).alias("active"),
    )
    conflicts = both.filter(lock & fresh & ~F.col("confidence").eqNullSafe(F.col("new_confidence"))).select(*key, "confidence", F.col("new_confidence").alias("extracted"))
    return out, conflicts


def upsert_evidence(known: DataFrame, incoming: DataFrame, most: int = 2000) -> DataFrame:
    """One row for each fact, version and node: the latest excerpt, cut to `most` characters."""
    key = ["fact_id", "version", "node_id"]
    both = known.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("__new"), "excerpt")
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__new").withColumn("excerpt", F.left("excerpt", F.lit(most)))


def projection(entities: DataFrame, facts: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is online: active facts that aren't rejected and have active evidence, and their entities."""
    live = facts.filter("active AND review_status <> 'rejected'").join(evidence.filter("active").select("fact_id").distinct(), "fact_id", "left_semi")
    ends = live.select(F.explode(F.array("subject", "object")).alias("entity_id")).distinct()
    return live, entities.join(ends, "entity_id", "left_semi")


def deactivate_version(facts: DataFrame, evidence: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence of the versions becomes inactive; a fact stays active if it was made by hand or has other active evidence."""
    gone = versions.select(F.col("version").alias("__v")).distinct()
    after = evidence.join(gone, F.col("version") == F.col("__v"), "left").withColumn("active", F.col("active") & F.col("__v").isNull()).drop("__v")
    alive = after.filter("active").select(F.col("fact_id").alias("__f")).distinct()
    kept = facts.join(alive, F.col("fact_id") == F.col("__f"), "left").withColumn("active", F.col("active") & ((F.col("origin") == "manual") | F.col("__f").isNotNull())).drop("__f")
    return kept, after


def purge(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Without extracted facts that have no active evidence."""
    alive = evidence.filter("active").select("fact_id").distinct()
    return facts.filter("origin = 'manual'").unionByName(facts.filter("origin <> 'manual'").join(alive, "fact_id", "left_semi"))


def search(entities: DataFrame, text: str | None, kind: str | None, limit: int) -> DataFrame:
    """Entities with the text in their name or an alias, of a type, by name: a report of `limit` rows."""
    out = entities
    if text:
        low = text.lower()
        out = out.filter(F.contains(F.lower("name"), F.lit(low)) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(low))))
    if kind:
        out = out.filter(F.col("entity_type") == kind)
    return out.orderBy("name", "entity_id").limit(limit)


def neighborhood(facts: DataFrame, centers: DataFrame) -> DataFrame:
    """Facts that touch each center (entity_id): center, neighbor, direction, predicate. Two equi-joins, never one with OR."""
    ids = centers.select(F.col("entity_id").alias("center")).distinct()
    out = facts.join(ids, F.col("subject") == F.col("center")).select("center", F.col("object").alias("neighbor"), F.lit("out").alias("direction"), "predicate")
    into = facts.filter("subject <> object").join(ids, F.col("object") == F.col("center")).select("center", F.col("subject").alias("neighbor"), F.lit("in").alias("direction"), "predicate")
    return out.unionByName(into)


def paths(facts: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """Directed paths of 1 to `depth` facts from each start (entity_id) without a node twice: start, target, hops, path."""
    if not 1 <= depth <= 3:
        raise ValueError("GRAPH_PATH_DEPTH_INVALID")
    edges = facts.select(F.col("subject").alias("__from"), F.col("object").alias("__to"))
    now = starts.select(F.col("entity_id").alias("start"), F.col("entity_id").alias("target"), F.array("entity_id").alias("nodes"))
    out = []
    for hops in range(1, depth + 1):
        now = now.join(edges, F.col("target") == F.col("__from")).filter(~F.array_contains("nodes", F.col("__to"))).select("start", F.col("__to").alias("target"), F.concat("nodes", F.array("__to")).alias("nodes"))
        out.append(now.withColumn("hops", F.lit(hops).cast("long")))
    return reduce(DataFrame.unionByName, out).select("start", "target", "hops", F.array_join("nodes", ">").alias("path"))


class GraphTooLarge(ValueError):
    """A hop would give more rows than a query may; nothing of it was made."""


def bounded_paths(facts: DataFrame, starts: DataFrame, depth: int = 3, most_rows: int = 10_000) -> DataFrame:
    """`paths`, hop by hop: before each the rows that it would give are counted from the frontier's degrees (a hub counts with all its facts, a fact back to a node of the path as well), and if all together are over `most_rows` the query is refused.

    Degrees are one aggregate over the facts. The frontier is never larger than `most_rows`, so a hop joins a bounded
    table with the facts, however many facts there are.
    """
    if not 1 <= depth <= 3:
        raise ValueError("GRAPH_PATH_DEPTH_INVALID")
    edges = facts.select(F.col("subject").alias("target"), F.col("object").alias("__to"))
    degrees = checkpointed(edges.groupBy("target").agg(F.count("*").alias("__degree")))
    now = checkpointed(starts.select(F.col("entity_id").alias("start"), F.col("entity_id").alias("target"), F.array("entity_id").alias("nodes")))
    made, out = 0, []
    for hops in range(1, depth + 1):
        ahead = now.join(degrees, "target").agg(F.coalesce(F.sum("__degree"), F.lit(0))).first()[0]
        if made + ahead > most_rows:
            raise GraphTooLarge(f"GRAPH_RESULT_TOO_LARGE: hop {hops} would make {made + ahead} rows of {most_rows}")
        now = checkpointed(now.join(edges, "target").filter(~F.array_contains("nodes", F.col("__to"))).select("start", F.col("__to").alias("target"), F.concat("nodes", F.array("__to")).alias("nodes")))
        made += now.count()
        out.append(now.withColumn("hops", F.lit(hops).cast("long")))
    return reduce(DataFrame.unionByName, out).select("start", "target", "hops", F.array_join("nodes", ">").alias("path"))


def merge_entities(facts: DataFrame, moves: DataFrame) -> DataFrame:
    """Facts after entities were merged (moves: old, new): endpoints rewired, facts that became equal united, loops dropped."""
    old = moves.select("old", "new")
    s, o = old.toDF("__s", "__sn"), old.toDF("__o", "__on")
    moved = facts.join(s, F.col("subject") == F.col("__s"), "left").join(o, F.col("object") == F.col("__o"), "left")
    moved = moved.withColumn("subject", F.coalesce("__sn", "subject")).withColumn("object", F.coalesce("__on", "object")).filter("subject <> object")
    return moved.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.count("*").alias("merged"))


def split_entity(facts: DataFrame, entity: Column, new: Column, moves: Column) -> DataFrame:
    """Facts of an entity for which `moves` holds go to a new one."""
    return facts.withColumn("subject", F.when((F.col("subject") == entity) & moves, new).otherwise(F.col("subject"))).withColumn("object", F.when((F.col("object") == entity) & moves, new).otherwise(F.col("object")))


def build_gate(outcomes: DataFrame, group: list[str], most_failed: float = 0.2) -> DataFrame:
    """verdict of an extraction's outcomes (succeeded, candidates, accepted of each parent)."""
    total = outcomes.groupBy(*group).agg(F.count("*").alias("parents"), F.count_if(~F.col("succeeded")).alias("failed"), F.sum("candidates").alias("candidates"), F.sum("accepted").alias("accepted"))
    verdict = F.when((F.col("failed") == F.col("parents")) | (F.col("failed") / F.col("parents") > most_failed), "too_many_failures").when((F.col("candidates") > 0) & (F.col("accepted") == 0), "all_rejected").otherwise("ok")
    return total.withColumn("verdict", verdict)


def preview(documents: DataFrame, nodes: DataFrame, price: float) -> DataFrame:
    """Whether a document's graph can be built (status, active_build, parents), its parents, tokens and estimated cost."""
    held = nodes.groupBy("document_id").agg(F.count("*").alias("parents"), F.sum("token_count").alias("tokens"))
    both = documents.join(held, "document_id", "left").fillna(0, ["parents", "tokens"])
    reason = F.when(F.col("status") != "ready", "DOCUMENT_NOT_READY").when(F.col("active_build"), "BUILD_ALREADY_ACTIVE").when(F.col("parents") == 0, "NO_PARENT_NODES")
    return both.withColumn("reason", reason).withColumn("eligible", reason.isNull()).withColumn("cost", F.round(F.col("tokens") * price / 1e6, 9))


def rows_to_hits(rows: DataFrame, query: str, node: str, order: str) -> DataFrame:
    """Rows of a graph query as hits: each node once, at its first place, with score 1 / rank."""
    first = rows.groupBy(query, node).agg(F.min(order).alias("__at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("__at", node)).cast("long")).withColumn("score", F.round(1 / F.col("rank"), 6)).drop("__at")


def guard_plan(df: DataFrame, most_rows: int = 10_000) -> str | None:
    """Why a plan isn't run: a Cartesian product, or more estimated rows than allowed (where statistics say so). None: it may."""
    plan = df._jdf.queryExecution()
    text = plan.executedPlan().toString()
    if "CartesianProduct" in text or "BroadcastNestedLoopJoin" in text:
        return "CARTESIAN_PRODUCT"
    rows = plan.optimizedPlan().stats().rowCount()
    if rows.isDefined() and int(rows.get().toString()) > most_rows:
        return "ESTIMATED_ROWS_EXCEEDED"
    return None


def properties_json(properties: dict[str, object]) -> str:
    return json.dumps(properties, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
