"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, fp string, `__id` long, key string, digest string, parts string, score double"


def words(rng, n, low=2, high=9):
    return [("".join(rng.choice("abcdefgh") for _ in range(rng.randint(low, high)))) for _ in range(n)]


def texts(seed=3):
    rng = random.Random(seed)
    base = " ".join(words(rng, 120))
    near = base.split()
    near[60] = "changed"
    line = "This very same line stands in MANY documents  "
    out = [base, base, " ".join(near), "", None, " \n\t ", "x", "tie tie tie", "tie tie tie", "é" * 40 + " " + "日本" * 30, "a" * 5000]
    out += [f"{line}\n{' '.join(words(rng, 30))}\n {line.lower()}" for _ in range(5)]
    out += ["\n".join(" ".join(words(rng, rng.randint(1, 20))) for _ in range(rng.randint(1, 12))) for _ in range(20)]
    out += [" ".join(words(rng, 4000))]
    return out


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    sources = ["b", None, "a", "c"]
    data = [(10 * i + 1, t, ["en", "de", None][i % 3], sources[i % 4], len(t or ""), 7, 1.0, "z", 5, "k", "d", "p", 0.5) for i, t in enumerate(rows)]
    data += [(1, rows[0], "en", "b", 0, 7, 1.0, "z", 5, "k", "d", "p", 0.5)] if rows else []  # a row again
    data += [(None, "null id " + "w " * 30, "en", "a", 0, 7, 1.0, "z", 5, "k", "d", "p", 0.5)] if rows else []
    return spark.createDataFrame(data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
