"""Kept postings: the hits of an index are those of a scan, from fewer blocks."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from docquarry.operators import postings as P

SMALL = (P.Field("title", "title", P.folding, 4.0), P.Field("body", "body", P.standard, 1.0), P.Field("tags", "tags", P.bigrams, 2.0))


def corpus(spark, n, seed=1):
    """Texts with frequent words, rare words, empty fields and ties."""
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "to", "in"], [f"w{k}" for k in range(300)]
    rows = []
    for k in range(n):
        body = [rng.choice(common) if rng.random() < 0.6 else rare[int(rng.paretovariate(1)) % 300] for _ in range(rng.randint(0, 60))]
        rows.append((k, rng.choice(["a", "b"]), " ".join(rng.choice(rare + ["Été", "日本語"]) for _ in range(rng.randint(0, 3))), " ".join(body), [rng.choice(rare) for _ in range(rng.randint(0, 3))]))
    rows += [(n, "a", None, None, None), (n + 1, "b", "", "", []), (n + 2, "a", rows[3][2], rows[3][3], rows[3][4])]
    return spark.createDataFrame(rows, "id long, kind string, title string, body string, tags array<string>")


def asked(spark):
    return spark.createDataFrame([(1, "the w1 of w2"), (2, "w5"), (3, "the of and to in"), (4, "nothing known"), (5, ""), (6, None), (7, "ete 日本語 w9 the"), (8, "w1 " * 30 + "w250 w251 w252 the")], "q long, text string")


@pytest.fixture(scope="module")
def built(spark):
    docs = corpus(spark, 900).repartition(4).cache()
    return docs, P.build(docs, "id", SMALL, tempfile.mkdtemp(prefix="spark-") + "/index", ("kind",))


def rows(df):
    return sorted((r["q"], r["id"], r["score"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 2000])
def test_index_equals_a_scan(spark, built, k):
    docs, index = built
    assert rows(index.search(asked(spark), "q", "text", k)) == rows(P.scanned(docs, "id", SMALL, asked(spark), "q", "text", k)) != []


def test_filters_hold_before_the_best_are_chosen(spark, built):
    docs, index = built
    got = rows(index.search(asked(spark), "q", "text", 10, F.col("kind") == "b"))
    every = P.scanned(docs, "id", SMALL, asked(spark), "q", "text", 10**6).join(docs.filter("kind = 'b'").select("id"), "id").collect()
    best = {}
    for r in sorted(every, key=lambda r: (r["q"], -r["score"], r["rank"])):
        best.setdefault(r["q"], []).append((r["q"], r["id"], r["score"]))
    assert [(q, i, s) for q, i, s, _ in got] == sorted(x for hits in best.values() for x in hits[:10])


def test_blocks_that_cannot_reach_the_best_are_not_read(spark):
    """A stop word stands in all of 6,000 texts; rare words decide."""
    docs = spark.range(6000).select(F.col("id"), F.concat_ws(" ", F.lit("the the"), F.concat(F.lit("u"), F.col("id") % 60), F.expr("repeat('the ', int(id % 40))")).alias("body"))
    index = P.build(docs, "id", (P.Field("body", "body", P.standard, 1.0),), tempfile.mkdtemp(prefix="spark-") + "/index")
    questions = spark.createDataFrame([(1, "the u7"), (2, "the u8 u9")], "q long, text string")
    need = P.needed_blocks(index, questions, "q", "text", 10)
    read, there = need.blocks.filter("term = 'the'").count(), need.bounds.filter("term = 'the'").count()
    assert there >= 40 and read == 0
    assert rows(index.search(questions, "q", "text")) == rows(P.scanned(docs, "id", index.fields, questions, "q", "text"))


def test_bounds_are_no_less_than_what_is_in_their_blocks(built):
    _, index = built
    held = index.table("blocks").join(index.table("fields"), "field").select("bound", "average", F.inline("held"))
    assert held.filter(P.impact("tf", "dl", "average") > F.col("bound") + 1e-12).count() == 0
    assert index.table("bounds").filter("ahead < 0").count() == 0


def test_analysers(spark):
    (row,) = spark.createDataFrame([("Été 日本語 foo_bar 3x",)], "t string").select(P.standard(F.col("t")), P.folding(F.col("t")), P.bigrams(F.col("t"))).collect()
    assert row[0] == ["été", "日", "本", "語", "foo", "bar", "3x"] or row[0] == ["été", "日", "本", "語", "foo_bar", "3x"]
    assert row[1][0] == "ete" and row[2] == ["été", "日本", "本語", "foo_bar", "3x"]


def test_empty_index(spark):
    docs = spark.createDataFrame([], "id long, kind string, title string, body string, tags array<string>")
    index = P.build(docs, "id", SMALL, tempfile.mkdtemp(prefix="spark-") + "/index")
    assert index.search(asked(spark), "q", "text").count() == 0
