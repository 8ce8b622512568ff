"""Retrieval queries over whole passages, on small tables worked out by hand."""

import docquarry.plans as plans
from docquarry.plans.registry import Tables
from docquarry.plans.retrieval import candidates

OPENING = "the quick brown fox jumps over the lazy dog while everybody is looking on"


def written(spark, folder, docs, passages=()):
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(passages), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, [1.0, float(k)], 0) for k in docs], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_exact_match_flag_takes_whole_passages(spark, tmp_path):
    docs = {1: f"x {OPENING.upper()} and then home y", 2: OPENING + " but not home", 3: "looking on and then home", 4: "see part-77x there", 5: "part-77 only"}
    folder = written(spark, tmp_path, docs, [(7, OPENING + " and then home"), (8, "a long passage that ends with the number of part-77x")])
    got = {(r["item_id"], r["doc_id"]) for r in plans.QUERIES["exact_match_flag"](spark, folder).collect()}
    assert got == {(7, 1), (8, 4)}


def test_candidates_are_exact_by_the_whole_query(spark, tmp_path):
    docs = {0: OPENING + " with part-77x", 1: OPENING + " at night", 2: "the part-77x dog", 3: "the dog"}
    got = {r["doc_id"]: r["exact"] for r in candidates(Tables(spark, written(spark, tmp_path, docs))).collect() if r["query_id"] == 0}
    assert got == {0: True, 1: False, 2: True, 3: False}


def test_candidates_send_queries_to_texts(spark, tmp_path):
    docs = {0: OPENING, 100: OPENING + " at night", 1: OPENING + " by day", 2: "the dog"}
    frame = candidates(Tables(spark, written(spark, tmp_path, docs)))
    joined = [x for x in frame._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
    assert "doc_id" in joined[0] and "query_id" in joined[1]  # the outer join meets the texts
    assert {(r["query_id"], r["doc_id"]) for r in frame.collect()} == {(q, d) for q in (0, 100) for d in docs}
