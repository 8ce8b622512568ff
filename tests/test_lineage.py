"""Merges and their undoing against plain dictionaries, and paths that are refused before they grow."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import graph as G
from docquarry.operators import lineage as L

ENTITY = "entity_id string, name string, entity_type string, aliases array<string>, active boolean, locked boolean, merged_into string"
FACT, PROOF = "fact_id string, subject string, predicate string, object string, confidence double, manual boolean", "fact_id string, node_id string"


def key(s, p, o):
    return hashlib.sha256("\x1f".join((s, p, o)).encode()).hexdigest()


def made(spark, seed):
    rng = random.Random(seed)
    names = [f"e{k}" for k in range(30)]
    entities = [(n, f"Name {n}", rng.choice("AB") if k > 3 else "A", [f"alias {n}"] if k % 2 else [], k != 7, k == 8, None) for k, n in enumerate(names)]
    facts = {}
    for _ in range(120):
        s, p, o = rng.choice(names), rng.choice("pq"), rng.choice(names)
        if s != o:
            facts[key(s, p, o)] = (key(s, p, o), s, p, o, rng.randint(1, 9) / 10, rng.random() < 0.2)
    proof = list({(rng.choice(list(facts)), f"n{rng.randrange(20)}") for _ in range(200)})
    return entities, facts, proof, L.Graph(spark.createDataFrame(entities, ENTITY), spark.createDataFrame(list(facts.values()), FACT), spark.createDataFrame(proof, PROOF))


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.mark.parametrize("seed", [1])
def test_merge_against_plain_dictionaries_and_undo(spark, seed):
    entities, facts, proof, graph = made(spark, seed)
    moves = [("e0", "e1"), ("e1", "e2"), ("e3", "e2"), ("e7", "e2"), ("e8", "e2"), ("e10", "e10"), ("e11", "e12"), ("e12", "e11"), ("nobody", "e2"), *[(f"e{k}", f"e{k + 1}") for k in range(14, 28, 2)]]
    done = L.merge(graph, spark.createDataFrame(moves, "old string, new string"))
    refused = {r["old"]: r["reason"] for r in done.refused.collect()}
    kinds = {e[0]: e[2] for e in entities}
    assert refused["e7"] == "ENTITY_INACTIVE" and refused["e8"] == "ENTITY_LOCKED" and refused["nobody"] == "ENTITY_UNKNOWN"
    assert refused["e10"] == refused["e11"] == refused["e12"] == "MERGE_CIRCLE"
    into = {"e0": "e2", "e1": "e2", "e3": "e2", **{f"e{k}": f"e{k + 1}" for k in range(14, 28, 2) if kinds[f"e{k}"] == kinds[f"e{k + 1}"]}}
    assert {k for k, v in refused.items() if v == "ENTITY_TYPE_MISMATCH"} == {f"e{k}" for k in range(14, 28, 2)} - set(into)
    want, moved = {}, {}
    for f, s, p, o, c, m in facts.values():
        s, o = into.get(s, s), into.get(o, o)
        moved[f] = key(s, p, o) if s != o else None
        if s != o:
            held = want.get(moved[f], (None,) * 4 + (0, False))
            want[moved[f]] = (moved[f], s, p, o, max(c, held[4]), m or held[5])
    assert rows(done.graph.facts) == sorted(map(str, want.values()))
    assert rows(done.graph.evidence) == sorted(map(str, {(moved[f], n) for f, n in proof if moved[f]}))
    now = {r["entity_id"]: r for r in done.graph.entities.collect()}
    assert all(now[a]["merged_into"] == b and not now[a]["active"] for a, b in into.items())
    assert set(now["e2"]["aliases"]) >= {"Name e0", "Name e1", "Name e3", "alias e1", "alias e3"}
    back = L.undo(done.graph, done)
    assert rows(back.facts) == rows(graph.facts) and rows(back.evidence) == rows(graph.evidence) and rows(back.entities) == rows(graph.entities)
    assert L.audit(done, "op", "me").filter("kind = 'refused'").count() == len(refused)


def test_undo_keeps_what_was_added_and_refuses_what_was_changed(spark):
    _, _, _, graph = made(spark, 3)
    done = L.merge(graph, spark.createDataFrame([("e0", "e1")], "old string, new string"))
    new = spark.createDataFrame([(key("e1", "new", "e9"), "e1", "new", "e9", 0.5, True)], FACT)
    later = L.Graph(done.graph.entities, done.graph.facts.unionByName(new), done.graph.evidence)
    assert rows(L.undo(later, done).facts) == sorted(rows(graph.facts) + rows(new))
    changed = L.Graph(done.graph.entities, done.graph.facts.withColumn("confidence", F.lit(0.01)), done.graph.evidence)
    with pytest.raises(L.ChangedSince):
        L.undo(changed, done)


def test_split_moves_told_facts(spark):
    _, facts, proof, graph = made(spark, 4)
    f = next(v for v in facts.values() if v[1] == "e2")
    out = L.split(graph, spark.createDataFrame([(f[0], "e2", "new")], "fact_id string, old string, new string"))
    got = key("new", f[2], f[3])
    assert out.facts.filter(F.col("fact_id") == got).count() == 1 and out.facts.count() == len(facts)
    assert out.evidence.filter(F.col("fact_id") == got).count() == len({n for k, n in proof if k == f[0]})


def test_paths_are_refused_before_a_hub_is_walked(spark):
    facts = spark.createDataFrame([("a", "p", "hub")] + [("hub", "p", f"x{k}") for k in range(500)] + [("b", "p", "c"), ("c", "p", "b"), ("c", "p", "d")], "subject string, predicate string, object string")
    few = spark.createDataFrame([("b",)], "entity_id string")
    assert rows(G.bounded_paths(facts, few)) == rows(G.paths(facts, few)) != []
    with pytest.raises(G.GraphTooLarge, match="hop 2"):
        G.bounded_paths(facts, spark.createDataFrame([("a",)], "entity_id string"), most_rows=100)
    assert G.bounded_paths(facts, spark.createDataFrame([("a",)], "entity_id string"), depth=1, most_rows=100).count() == 1
    assert G.bounded_paths(facts, few.limit(0)).count() == 0
