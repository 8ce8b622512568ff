"""Merging entities of a graph and taking it back: endpoints rewired, facts and evidence united, with a lineage that restores them.

entities: entity_id, name, entity_type, aliases, active, locked, merged_into. facts: fact_id (a digest of its ends and
predicate), subject, predicate, object, confidence, manual. evidence: fact_id, node_id.

A merge moves entities into others. Moves that form chains go to the chain's end. A move is refused, with its reason, if an
end is unknown, not active or locked by hand, if the types differ, if it goes to itself, or if chains form a circle; the
others are carried out. Facts of a moved entity get new ends and so a new id; facts that become equal are one, with
the larger confidence, by hand if any was; facts from an entity to itself go, with their evidence. The lineage has each
touched row as it was and what became of it; undoing a merge puts those rows back, unless one of them was changed
since. Every step is an equi-join or an aggregate over touched rows only; no group comes together in one task but an
entity's aliases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.sources.scratch import checkpointed


class ChangedSince(ValueError):
    """Rows of a merge were changed after it; it can't be taken back."""


@dataclass(frozen=True)
class Graph:
    entities: DataFrame
    facts: DataFrame
    evidence: DataFrame


@dataclass(frozen=True)
class Merge:
    """What a merge gives: the graph after it, the moves that weren't made, and its lineage (old rows and new ids)."""

    graph: Graph
    refused: DataFrame
    entities: DataFrame
    facts: DataFrame
    evidence: DataFrame


def fact_id(subject: Column | str, predicate: Column | str, obj: Column | str) -> Column:
    return F.sha2(F.concat_ws("\x1f", subject, predicate, obj), 256)


def resolved(moves: DataFrame) -> DataFrame:
    """old, new, circle: each move to the end of its chain. Chains are shortened by half in each round, so the rounds are the logarithm of the moves at most; what is open then runs in a circle."""
    now = moves.select("old", F.col("new").alias("end"))
    for _ in range(moves.count().bit_length()):
        step = now.select(F.col("old").alias("end"), F.col("end").alias("__next"))
        joined = now.join(step, "end", "left")
        now = checkpointed(joined.select("old", F.coalesce("__next", "end").alias("end"), F.col("__next").isNotNull().alias("__open")))
        if now.filter("__open").isEmpty():
            break
        now = now.drop("__open")
    inside = now.select(F.col("old").alias("end")).withColumn("circle", F.lit(True))
    return now.join(inside, "end", "left").select("old", F.col("end").alias("new"), F.coalesce("circle", F.lit(False)).alias("circle"))


def judged(entities: DataFrame, moves: DataFrame) -> DataFrame:
    """old, new, reason (null: the move is made)."""
    told = resolved(moves.select("old", "new").dropDuplicates(["old"]))
    look = entities.select("entity_id", F.struct("entity_type", "active", "locked").alias("e"))
    both = told.join(look.withColumnsRenamed({"entity_id": "old", "e": "a"}), "old", "left").join(look.withColumnsRenamed({"entity_id": "new", "e": "b"}), "new", "left")
    reason = (
        F.when(F.col("circle") | (F.col("old") == F.col("new")), "MERGE_CIRCLE")
        .when(F.col("a").isNull() | F.col("b").isNull(), "ENTITY_UNKNOWN")
        .when(~F.col("a.active") | ~F.col("b.active"), "ENTITY_INACTIVE")
        .when(F.col("a.locked") | F.col("b.locked"), "ENTITY_LOCKED")
        .when(F.col("a.entity_type") != F.col("b.entity_type"), "ENTITY_TYPE_MISMATCH")
    )
    return both.select("old", "new", reason.alias("reason"))


def merge(graph: Graph, moves: DataFrame) -> Merge:
    verdict = checkpointed(judged(graph.entities, moves))
    made = verdict.filter("reason IS NULL").select("old", "new")

    # entities: the moved ones end, their names are aliases of the others
    names = graph.entities.join(made, F.col("entity_id") == F.col("old")).select(F.col("new").alias("entity_id"), F.explode(F.concat(F.array("name"), "aliases")).alias("alias"))
    more = names.groupBy("entity_id").agg(F.sort_array(F.collect_set("alias")).alias("__more"))  # of one entity
    gone = made.withColumnRenamed("old", "entity_id").withColumnRenamed("new", "__into")
    joined = checkpointed(graph.entities.join(gone, "entity_id", "left").join(more, "entity_id", "left"))
    touched = F.col("__into").isNotNull() | F.col("__more").isNotNull()
    added = F.filter(F.coalesce("__more", F.array().cast("array<string>")), lambda a: (a != F.col("name")) & ~F.array_contains("aliases", a))
    now = joined.withColumn("active", F.col("active") & F.col("__into").isNull()).withColumn("merged_into", F.coalesce("__into", "merged_into")).withColumn("aliases", F.concat("aliases", added))
    entities = now.select(*graph.entities.columns)
    kept_entities = joined.filter(touched).select(F.struct(*graph.entities.columns).alias("before")).join(now.filter(touched).select(F.struct(*graph.entities.columns).alias("after")), F.col("before.entity_id") == F.col("after.entity_id"))

    # facts: new ends, new ids; those that are equal then are one
    s, o = made.toDF("subject", "__s"), made.toDF("object", "__o")
    ended = graph.facts.join(s, "subject", "left").join(o, "object", "left").withColumn("__moved", F.col("__s").isNotNull() | F.col("__o").isNotNull())
    ended = ended.withColumn("__subject", F.coalesce("__s", "subject")).withColumn("__object", F.coalesce("__o", "object"))
    ended = ended.withColumn("__id", F.when(F.col("__subject") != F.col("__object"), fact_id("__subject", "predicate", "__object")))
    moved = checkpointed(ended.filter("__moved"))
    met = moved.select(F.col("__id").alias("fact_id")).distinct().join(graph.facts, "fact_id").select(*graph.facts.columns).join(moved.select("fact_id"), "fact_id", "left_anti")
    old = checkpointed(moved.select(F.struct(*graph.facts.columns).alias("before"), F.col("__id").alias("new_id")).unionByName(met.select(F.struct(*graph.facts.columns).alias("before"), F.col("fact_id").alias("new_id"))))
    ends = moved.filter("__id IS NOT NULL").select(F.col("__id").alias("fact_id"), F.col("__subject").alias("subject"), "predicate", F.col("__object").alias("object"), "confidence", "manual").unionByName(met.select("fact_id", "subject", "predicate", "object", "confidence", "manual"))
    united = ends.groupBy("fact_id", "subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.bool_or("manual").alias("manual"))
    facts = graph.facts.join(old.select(F.col("before.fact_id").alias("fact_id")), "fact_id", "left_anti").select(*graph.facts.columns).unionByName(united.select(*graph.facts.columns))

    # evidence: follows its fact
    way = old.select(F.col("before.fact_id").alias("fact_id"), "new_id").filter(~F.col("new_id").eqNullSafe(F.col("fact_id")))
    there = checkpointed(graph.evidence.join(way, "fact_id"))
    stays = graph.evidence.join(way, "fact_id", "left_anti").select(*graph.evidence.columns)
    evidence = stays.unionByName(there.filter("new_id IS NOT NULL").drop("fact_id").withColumnRenamed("new_id", "fact_id").select(*graph.evidence.columns)).distinct()
    fresh = there.filter("new_id IS NOT NULL").select(F.col("new_id").alias("fact_id"), "node_id").distinct().join(stays, ["fact_id", "node_id"], "left_anti")
    kept_evidence = there.select("fact_id", "node_id", F.lit(True).alias("old")).unionByName(fresh.withColumn("old", F.lit(False)))
    after = Graph(*(checkpointed(x) for x in (entities, facts, evidence)))
    return Merge(after, verdict.filter("reason IS NOT NULL"), checkpointed(kept_entities), old, checkpointed(kept_evidence))


def undo(graph: Graph, done: Merge) -> Graph:
    """The graph as it would be without the merge. What was added since stays; a touched row that was changed since is an error."""
    made = done.graph.facts.join(done.facts.select(F.col("new_id").alias("fact_id")).distinct(), "fact_id").select(*graph.facts.columns)
    lost = made.exceptAll(graph.facts.select(*made.columns)).count() + done.entities.select("after.*").exceptAll(graph.entities).count()
    if lost:
        raise ChangedSince(f"GRAPH_CHANGED_SINCE: {lost} rows of the merge were changed")
    entities = graph.entities.join(done.entities.select(F.col("after.entity_id").alias("entity_id")), "entity_id", "left_anti").select(*graph.entities.columns).unionByName(done.entities.select("before.*"))
    facts = graph.facts.join(made.select("fact_id"), "fact_id", "left_anti").select(*graph.facts.columns).unionByName(done.facts.select("before.*"))
    fresh = done.evidence.filter("NOT old").select("fact_id", "node_id")
    evidence = graph.evidence.join(fresh, ["fact_id", "node_id"], "left_anti").select(*graph.evidence.columns).unionByName(done.evidence.filter("old").select(*graph.evidence.columns))
    return Graph(entities, facts, evidence)


def split(graph: Graph, moves: DataFrame) -> Graph:
    """Facts told by their ids move from an entity to another one (fact_id, old, new: the end that was `old`); equal facts are one, evidence follows."""
    own = checkpointed(graph.facts.join(moves, "fact_id"))
    ended = own.withColumn("subject", F.when(F.col("subject") == F.col("old"), F.col("new")).otherwise(F.col("subject"))).withColumn("object", F.when(F.col("object") == F.col("old"), F.col("new")).otherwise(F.col("object")))
    ended = checkpointed(ended.withColumn("__id", fact_id("subject", "predicate", "object")))
    rest = graph.facts.join(moves.select("fact_id"), "fact_id", "left_anti").select(*graph.facts.columns)
    both = rest.unionByName(ended.drop("fact_id").withColumnRenamed("__id", "fact_id").select(*graph.facts.columns))
    facts = both.groupBy("fact_id", "subject", "predicate", "object").agg(F.max("confidence").alias("confidence"), F.bool_or("manual").alias("manual")).select(*graph.facts.columns)
    way = ended.select("fact_id", "__id")
    evidence = graph.evidence.join(way, "fact_id", "left").withColumn("fact_id", F.coalesce("__id", "fact_id")).select(*graph.evidence.columns).distinct()
    return Graph(graph.entities, facts, evidence)


def audit(done: Merge, operation: str, actor: str) -> DataFrame:
    """A row for each touched row: operation, actor, kind, id, became."""
    head = [F.lit(operation).alias("operation"), F.lit(actor).alias("actor")]
    entities = done.entities.select(*head, F.lit("entity").alias("kind"), F.col("before.entity_id").alias("id"), F.col("after.merged_into").alias("became"))
    facts = done.facts.select(*head, F.lit("fact").alias("kind"), F.col("before.fact_id").alias("id"), F.col("new_id").alias("became"))
    refused = done.refused.select(*head, F.lit("refused").alias("kind"), F.col("old").alias("id"), F.col("reason").alias("became"))
    return entities.unionByName(facts).unionByName(refused)
