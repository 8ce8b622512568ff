"""The composed chunker, projections and traces on small tables worked out by hand."""

from pyspark.sql import functions as F

from docquarry.operators import composed as M
from docquarry.operators import lifecycle as L
from docquarry.operators import traces as R
from docquarry.operators.chunking import ChunkConfig

SMALL = ChunkConfig(parent_target=8, parent_most=10, child_target=4, child_most=5, overlap=1)
BLOCKS = "d long, o long, kind string, text string, heading_path array<string>, units array<string>, g string"


def test_nearest_ancestor_ends_on_cycles_and_lost_parents(spark):
    rows = [(1, 0, None, True), (1, 1, 0, False), (1, 2, 1, False), (1, 3, 9, False), (1, 4, 5, False), (1, 5, 4, False), (1, 6, 7, True), (1, 7, 6, False), (2, 1, None, True), (1, 8, 2, None)]
    df = spark.createDataFrame(rows, "d long, i long, up long, hit boolean")
    got = {(r["d"], r["i"]): r["ancestor"] for r in M.nearest_ancestor(df, "d", "i", "up", F.col("hit")).collect()}
    assert got == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): None, (1, 4): None, (1, 5): None, (1, 6): 6, (1, 7): 6, (2, 1): None, (1, 8): 0}
    assert M.nearest_ancestor(df.limit(0), "d", "i", "up", F.col("hit")).count() == 0


def composed(spark, rows):
    nodes = M.compose(spark.createDataFrame(rows, BLOCKS), "d", "o", F.col("g"), SMALL).collect()
    parents = sorted((r for r in nodes if r["node_level"] == "parent"), key=lambda r: (r["document"], r["ordinal"]))
    return [(p["content"], p["source_blocks"], [c["content"] for c in sorted((c for c in nodes if c["parent_node_id"] == p["node_id"]), key=lambda c: c["ordinal"])]) for p in parents]


def test_compose_packs_groups_into_parents_and_cuts_children(spark):
    rows = [
        (1, 0, "paragraph", "a b c", ["H"], None, "h"), (1, 1, "paragraph", "x", [], None, "other"), (1, 2, "paragraph", "d e f g h", ["H", "I"], None, "h"),
        (1, 3, "paragraph", "i j", ["H"], None, "h"), (1, 4, "paragraph", " ", [], None, "h"), (1, 5, "paragraph", "k " * 12, [], None, "h"),
    ]
    # 3 + 5 tokens reach the target of 8; the text of 12 is cut at 10; the group of block 0 comes first.
    assert composed(spark, rows) == [
        ("a b c\n\nd e f g h", [0, 2], ["a b c\n\nd", "d e f g", "g h"]),
        ("i j", [3], ["i j"]),
        ("k k k k k k k k k k", [5], ["k k k k", "k k k k", "k k k k"]),
        ("k k", [5], ["k k"]),
        ("x", [1], ["x"]),
    ]


def test_compose_keeps_tables_apart_and_repeats_what_stands_over_a_long_line(spark):
    rows = [(1, 0, "paragraph", "a", [], None, "g"), (1, 1, "table", "t", [], ["h\nr1", "h\nr2 r3", "h\n1 2 3 4 5 6"], "g"), (1, 2, "paragraph", "b", [], None, "g")]
    got = composed(spark, rows)
    assert got == [
        ("a", [0], ["a"]),
        ("h\nr1\n\nh\nr2 r3\n\nh\n1 2 3 4", [1], ["h\nr1", "h\nr2 r3", "h\n1 2 3 4"]),
        ("h\n5 6", [1], ["h\n5 6"]),
        ("b", [2], ["b"]),
    ]


def test_nodes_have_siblings_and_stable_ids(spark):
    df = spark.createDataFrame([(1, k, "paragraph", "w " * 9, [], None, "g") for k in range(3)], BLOCKS)
    first, second = (M.compose(df, "d", "o", F.col("g"), SMALL).filter("node_level = 'parent'").orderBy("ordinal").collect() for _ in range(2))
    assert [r["node_id"] for r in first] == [r["node_id"] for r in second] and len(first) == 3
    assert [r["previous_node_id"] for r in first] == [None, first[0]["node_id"], first[1]["node_id"]]


def test_header_children():
    assert M.with_header(["a", "b"], "a | b\n1\t2\n3\t4\n5\t6", 6) == ["a\tb\n1\t2\n3\t4", "a\tb\n5\t6"]
    assert M.with_header(["a", "b"], "a\tb\n", 6) == ["a\tb"] and M.with_header([], "", 6) == [""]
    assert M.with_header(["a"], "1 2 3 4 5 6 7 8 9", 4) == ["a\n1 2 3 4 5 6 7 8 9"]


def test_lifecycle_takes_the_last_action(spark):
    rows = spark.createDataFrame([(1, 10, 10, True, "indexed"), (1, 9, 10, True, "indexed"), (2, 20, 20, True, "indexed"), (3, 30, 30, True, "indexed"), (4, 40, None, True, "indexed")], "document_id long, version_id long, current_version_id long, is_active boolean, index_status string")
    actions = spark.createDataFrame([(1, 1, "delete"), (1, 2, "restore"), (2, 1, "delete"), (3, 1, "purge"), (4, 1, "restore")], "document_id long, at long, action string")
    got = {r["version_id"]: (r["is_active"], r["index_status"]) for r in L.apply_lifecycle(rows, actions).collect()}
    assert got == {10: (True, "indexed"), 9: (False, "indexed"), 20: (False, "stale"), 40: (False, "indexed")}


def test_build_states_refuse_what_a_state_does_not_allow(spark):
    rows = [(1, 1, "running"), (1, 2, "cancelled"), (1, 3, "failed"), (2, 1, "succeeded"), (3, 1, "cancelled"), (3, 2, "running")]
    got = {r["b"]: (r["state"], r["refused"]) for r in L.build_states(spark.createDataFrame(rows, "b long, at long, to string"), "b", "at").collect()}
    assert got == {1: ("failed", 1), 2: ("queued", 1), 3: ("cancelled", 1)}


def test_document_recall_of_unanswerable_samples(spark):
    samples = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True), (5, False)], "q long, answerable boolean")
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 11), (3, 7, 1), (5, 7, 1)], "q long, document long, rank long")
    relevant = spark.createDataFrame([(1, 7), (1, 8), (5, 7)], "q long, document long")
    got = {r["q"]: tuple(r)[1:] for r in R.document_recall(samples, ranked, relevant, "q").collect()}
    assert got == {1: (0.5, None), 2: (None, 1.0), 3: (None, 0.0), 4: (0.0, None), 5: (1.0, None)}
