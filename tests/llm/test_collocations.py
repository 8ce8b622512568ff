"""Collocations against a count in plain Python and against DuckDB."""

import random
import re
from collections import Counter

import duckdb
import numpy as np

from docquarry.llm.collocations import PhraseConfig, collocations, pieces
from docquarry.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import SCHEMA, empty, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, most_words=5, percent=100, top=2000):
    counts = {}
    for lang, text in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(words[i : i + n]) for n in range(1, most_words + 1) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        total = sum(n for p, n in own.items() if len(p) == 1)
        often = {p: n for p, n in own.items() if n >= least}
        held = []
        for p, a in often.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * n >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in often.items()):
                continue
            score, _, left, right = min((1000 * a * total // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            held.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, total, -score) for k, (score, a, p, left, right) in enumerate(sorted(held)[:top], 1)]
    return sorted(out)


def test_against_a_plain_count(spark):
    rng = random.Random(9)
    words = ["New", "york", "CITY", "of", "the", "é", "ÉÈ", "city,", "x.", "a\xa0b", "\x0b", "日本", "'"]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) + rng.choice(["", "\n", "\t ", "  "])) for _ in range(60)]
    rows += [("en", "once upon a time there was"), ("fr", None), ("fr", ""), (None, "\n\n")] + [("en", "once upon a time!")] * 5
    docs = spark.createDataFrame([(k, t, g, "s", 0, 0, 0.0, "", 0, "", "", "", 0.0) for k, (g, t) in enumerate(rows)], SCHEMA).repartition(3)
    for config in (PhraseConfig(least_count=3), PhraseConfig(least_count=2, most_words=3, part_percent=60, top=7), PhraseConfig(least_count=4, most_words=2)):
        got = sorted(map(tuple, collocations(docs, config).collect()))
        assert got == plain(rows, config.least_count, config.most_words, config.part_percent, config.top)


def test_counts_beyond_sixty_four_bits():
    total, a = 9 * 10**14, 4 * 10**14
    assert 1000 * a * total > 2**63  # what the decimals have to hold: 15 digits each and 3 more
    assert len(str(1000 * 10**15 * 10**15)) <= 38


def test_very_large_counts_are_exact(spark):
    from docquarry.llm.collocations import scored

    big = 987_654_321_012_345
    total = spark.createDataFrame([("en", big)], "lang string, total long")
    every = spark.createDataFrame([("en", "a", big // 7, 1), ("en", "b", big // 9, 1), ("en", "a b", big // 11, 2)], "lang string, phrase string, n long, words int")
    (row,) = scored(total, every).collect()
    assert row["score"] == 1000 * (big // 11) * big // ((big // 7) * (big // 9))


def test_awkward_rows(spark):
    docs = table(spark)
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    assert sorted(map(tuple, collocations(docs, PhraseConfig(least_count=2)).collect())) == plain(rows, 2)
    assert collocations(empty(spark)).count() == 0


def test_words_of_pieces():
    codes, words = pieces([b"A b,  c\n", b"", b"d"])
    said = [b"|" if c < 0 else words[int(c)].as_py() for c in codes]
    assert b" ".join(said) == b"a b | c | | | d |"
    assert len(pieces([])[0]) == 0 or np.all(pieces([])[0] < 0)


def test_query_against_duckdb(spark):
    folder = "/root/testdata/sf0.01"
    got = sorted(map(tuple, QUERIES["op12_collocations"](spark, folder).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert got and got == sorted(con.sql(ORACLE["op12_collocations"]).fetchall())
