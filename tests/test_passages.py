"""Passages in texts: the candidates' way gives what a test of every pair gives."""

import random

from pyspark.sql import functions as F

from docquarry.operators import fusion
from docquarry.operators import passages as P


def data(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "AB-12.3", "x9", "den", "İstanbul", "naïve", "--1", "a/b-7", "7"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for k in range(120)] + [(500, None), (501, ""), (502, "prefixalpha beta gammasuffix")]
    asked = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))) for k in range(40)] + [(90, None), (91, "  "), (92, "lpha beta gam"), (93, "beta"), (94, "a b"), (95, "nowhere to be found 55zz")]
    return spark.createDataFrame(texts, "doc long, body string"), spark.createDataFrame(asked, "item long, q string")


def test_exact_passages_are_those_of_every_pair(spark):
    texts, asked = data(spark)
    pairs = asked.join(texts, fusion.exact_match("q", "body")).select("item", "doc")  # every pair
    want = {tuple(r) for r in pairs.collect()}
    got = [tuple(r) for r in P.exact_passages(texts, "doc", "body", asked, "item", "q").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_plan_has_no_nested_loop(spark):
    texts, asked = data(spark)
    plan = P.exact_passages(texts, "doc", "body", asked, "item", "q")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (" in plan and "Join Cross" not in plan and "Join Inner\n" not in plan


def test_counts_against_replacing(spark, monkeypatch):
    texts, asked = data(spark)
    want = {}
    for q in asked.collect():
        terms = {w for w in spark.range(1).select(F.lit(q["q"]).cast("string").alias("t")).select(P.T.terms("t").alias("w")).first()["w"] or []}
        for t in texts.collect():
            low = (t["body"] or "").lower()
            n = sum(low.count(w) for w in terms)
            if n:
                want[q["item"], t["doc"]] = n
    for most in (200_000, 3):
        monkeypatch.setattr(P, "TERMS_AT_ONCE", most)
        got = {(r["item"], r["doc"]): r["score"] for r in P.counted_terms(texts, "doc", "body", asked, "item", "q").collect()}
        assert got == want
