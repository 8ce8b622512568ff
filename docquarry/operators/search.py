"""First-stage search: postings and BM25, dense vectors, index projections and their visibility."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions import vectors as V

#: The usual constants of BM25.
K1, B = 1.2, 0.75
#: Digits that scores are ranked by: beyond them, sums of equal parts differ by the order of adding.
EXACT = 10
#: Queries of a dense search that are held at once.
BLOCK = 4096
#: Parts of a term's postings.
SALTS = 8


def postings(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """term, ident, tf, dl (the length of the text in terms), n (that of the corpus in texts), average."""
    words = docs.select(ident, T.terms(text).alias("__terms"))
    lengths = words.agg(F.count("*").alias("n"), F.avg(F.size("__terms")).alias("average"))
    tf = words.select(ident, F.size("__terms").alias("dl"), F.explode("__terms").alias("term")).groupBy("term", ident, "dl").agg(F.count("*").alias("tf"))
    return tf.withColumn("__one", F.lit(1)).join(F.broadcast(lengths.withColumn("__one", F.lit(1))), "__one").drop("__one")  # one row


def top_hits(scored: DataFrame, query: str, ident: str, k: int, score: str = "score", digits: int | None = None) -> DataFrame:
    """The best k of each query, ties by id: query, ident, score, rank. Scores are rounded to `digits` after ranking."""
    w = Window.partitionBy(query).orderBy(F.desc(score), ident)
    best = scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return best if digits is None else best.withColumn(score, F.round(score, digits))


def bm25(index: DataFrame, queries: DataFrame, ident: str, query: str, text: str, k: int = 10, digits: int = 4) -> DataFrame:
    """query, ident, score, rank. Only postings of the queries' terms take part; the frequency of a term is counted among them.

    A term's postings are dealt by id into SALTS parts, each of which meets its own copy of the term's queries: a stop
    word is no group of one task. The parts of a query's score are added within a part of the ids.
    """
    asked = queries.select(query, F.explode(F.array_distinct(T.terms(text))).alias("term"))
    needed = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = needed.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("average")))
    salt = F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int").alias("__salt")
    weighed = needed.join(df, "term").select("term", ident, part.alias("part"), salt)
    copies = asked.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    scored = weighed.join(copies, ["term", "__salt"]).groupBy(query, ident).agg(F.round(F.sum("part"), EXACT).alias("score"))
    return top_hits(scored, query, ident, k, digits=digits)


def best_field(hits: list[tuple[DataFrame, float]], query: str, ident: str, k: int = 10) -> DataFrame:
    """Several fields' scores with their boosts: a hit has its best field's."""
    every = [h.select(query, ident, (F.col("score") * boost).alias("score")) for h, boost in hits]
    union = every[0]
    for other in every[1:]:
        union = union.unionByName(other)
    return top_hits(union.groupBy(query, ident).agg(F.max("score").alias("score")), query, ident, k)


def occurrences(text: Column, term: Column) -> Column:
    """How often a string is in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def dense(vectors: DataFrame, queries: DataFrame, ident: str, query: str, vector: str, k: int = 10, digits: int = 4) -> DataFrame:
    """Exact cosine top k: query, ident, score, rank.

    The queries are sent to all vectors in blocks of about BLOCK rows, so what is held and broadcast at once is bounded;
    each task keeps its own best k of each query, and the last ranking sees k rows of each task and query.
    """
    blocks = -(-queries.count() // BLOCK)
    parts = [queries.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == b) if blocks > 1 else queries for b in range(blocks)]
    scored = [near(vectors, part, ident, query, vector, k) for part in parts] or [near(vectors, queries, ident, query, vector, k)]
    return top_hits(reduce(DataFrame.unionByName, scored), query, ident, k, digits=digits)


def near(vectors: DataFrame, queries: DataFrame, ident: str, query: str, vector: str, k: int) -> DataFrame:
    """Of one block of queries: query, ident, score of each task's best k."""
    rows = queries.select(query, F.col(vector).cast("array<double>").alias("v")).collect()  # a block
    names = [r[query] for r in rows]
    q = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), len(rows[0]["v"]) if rows else 0)
    q = q / np.where((n := np.sqrt((q**2).sum(1, keepdims=True))) > 0, n, 1)
    kind, asked = vectors.schema[ident].dataType.simpleString(), queries.schema[query].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast((names, q))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        best: pd.DataFrame | None = None
        for batch in batches:
            batch = batch[batch["v"].map(len) == q.shape[1]] if len(names) else batch[:0]
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy()).astype(np.float64)
            size = np.sqrt((x**2).sum(1))
            scores = np.round((x @ q.T) / np.where(size > 0, size, 1)[:, None], EXACT)
            ids = batch["i"].to_numpy()
            parts = [] if best is None else [best]
            for j, name in enumerate(names):
                order = np.lexsort((ids, -scores[:, j]))[:k]
                parts.append(pd.DataFrame({query: name, ident: ids[order], "score": scores[order, j]}))
            best = pd.concat(parts).sort_values([query, "score", ident], ascending=[True, False, True]).groupby(query).head(k)
        if best is not None:
            yield best

    return vectors.select(F.col(ident).alias("i"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(run, f"{query} {asked}, {ident} {kind}, score double")


def dense_pairs(vectors: DataFrame, queries: DataFrame, ident: str, query: str, vector: str, k: int, digits: int = 4) -> DataFrame:
    """The same for query vectors of the table itself, joined by a key that both have (candidates are given, not all rows)."""
    scored = vectors.join(queries, ident).withColumn("score", F.round(V.cosine(vector, f"query_{vector}"), EXACT))
    return top_hits(scored, query, ident, k, digits=digits)


# Index projections: a table keyed by id, with a flag for what readers may see.


def upsert_latest(table: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row a key: the one with the latest version, of the changes where versions are equal."""
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__new")


def activate(table: DataFrame, group: str, current: str, active: str = "is_active") -> DataFrame:
    """Of each group's rows, only those of its current run are visible: the flag is written anew."""
    return table.withColumn(active, F.col(group) == F.col(current))


def visible(table: DataFrame, active: str = "is_active") -> DataFrame:
    return table.filter(F.col(active))


def drop_stale(table: DataFrame, key: list[str], keep: DataFrame) -> DataFrame:
    return table.join(keep.select(*key).distinct(), key, "left_semi")


def publish(spark_table: DataFrame, staged: DataFrame, key: str, run: str, expected: int, view: str) -> DataFrame:
    """Two-phase publication: the staged rows are counted before the view turns to them; a wrong count leaves the view as it was."""
    found = staged.count()
    if found != expected:
        raise ValueError(f"INDEX_COUNT_MISMATCH: {found} rows staged, {expected} expected")
    kept = spark_table.join(staged.select(key).distinct(), key, "left_anti")
    after = kept.unionByName(staged.withColumn("is_active", F.lit(True)))
    after.filter("is_active").createOrReplaceTempView(view)
    return after
