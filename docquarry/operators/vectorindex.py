"""A vector index: trained coarse centroids with inverted lists, of which a search reads the nearest ones and ranks what is in them exactly.

Centroids are trained by spherical k-means on a bounded sample (`SAMPLE_PER_LIST` vectors a list; the rows with the smallest
hashes of their ids, so reruns agree); every vector is in the list of its nearest centroid. Lists are written as
folders, in parts of at most about `PART` vectors, and a search joins its queries with the parts of the lists that they
probe: a part and up to `QUERIES` queries are one task's matrix product, so a crowded list is many tasks. With all lists
probed the result is the exact one. How many lists a search probes is measured when the index is built: the exact hits of a
bounded sample of the vectors are looked up, and as many lists are probed as hold `SHARE` of them. `recall` compares results.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.operators.search import EXACT, dense, top_hits
from docquarry.sources.scratch import checkpointed

#: Vectors of a list's part, queries that meet it at once; lists at most; vectors of the sample a list; rounds of training.
PART, QUERIES, MOST_LISTS, SAMPLE_PER_LIST, ROUNDS = 20_000, 4_096, 4_096, 64, 12
#: What the probes are measured by: vectors searched exactly, hits of each, and the share of them to be found.
MEASURED, MEASURED_HITS, SHARE = 128, 10, 0.96


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of an array column that have `dims` numbers, as rows, and where they stand."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.flatnonzero(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == dims)
    return values.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dims), rows


def trained(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means: starts at sample rows far from each other (in order, each the farthest from those before); an emptied centroid keeps its place."""
    x = unit(sample)
    lists = min(lists, len(x))
    nearest, picks = np.full(len(x), -2.0), []
    at = 0
    for _ in range(lists):
        picks.append(at)
        nearest = np.maximum(nearest, x @ x[at])
        at = int(np.argmin(nearest))
    centres = x[picks].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        there = (sums**2).sum(1) > 0
        centres[there] = unit(sums[there])
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """A written index: its folder, centroids, the names of its key and vector, and how many lists a search probes."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    ident: str
    vector: str
    kind: str
    probes: int = 1

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"{self.ident} {self.kind}, v array<double>, part int, list int").parquet(os.path.join(self.path, "lists"))


def near_lists(vectors: DataFrame, keep: str, vector: str, centres: np.ndarray, probes: int) -> DataFrame:
    """keep, v, list: each vector with its nearest `probes` centroids, one a row. Vectors of another length are left out."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = matrix(batch.column(1), dims)
            score = unit(x) @ shared.value.T
            best = np.argsort(-score, axis=1, kind="stable")[:, :probes] if len(x) else np.zeros((0, probes), np.int64)
            again = np.repeat(rows, best.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(again)), batch.column(1).take(pa.array(again)), pa.array(best.ravel().astype(np.int32))], [keep, "v", "list"])

    return vectors.select(keep, F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"{keep} {vectors.schema[keep].dataType.simpleString()}, v array<double>, list int")


def build(vectors: DataFrame, ident: str, vector: str, path: str, lists: int | None = None) -> VectorIndex:
    """Write the index of all vectors into an empty folder; about a list for each root of the number of vectors, unless told otherwise."""
    spark, there = vectors.sparkSession, vectors.filter(F.size(vector) > 0)
    n = there.count()
    lists = min(MOST_LISTS, lists or max(1, int(math.sqrt(n))))
    dims = there.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    fit = there.orderBy(F.xxhash64(ident), ident).limit(lists * SAMPLE_PER_LIST).select(F.col(vector).cast("array<double>").alias("v")).collect()  # a bounded sample
    size = dims[0]["d"] if dims else 1
    sample = np.array([r["v"] for r in fit if len(r["v"]) == size], np.float64).reshape(-1, size)
    centres = trained(sample, lists) if len(sample) else np.zeros((1, size))
    told = checkpointed(near_lists(there, ident, vector, centres, 1))
    counts = told.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    laid = told.join(F.broadcast(counts), "list").withColumn("part", F.pmod(F.xxhash64(ident), F.col("parts")).cast("int"))  # MOST_LISTS rows at most
    laid.repartition("list", "part").select(ident, "v", "part", "list").write.partitionBy("list").parquet(os.path.join(path, "lists"))
    index = VectorIndex(spark, path, centres, ident, vector, vectors.schema[ident].dataType.simpleString())
    return replace(index, probes=measured(index))


def measured(index: VectorIndex) -> int:
    """The least number of lists that hold SHARE of the exact hits of a sample (the vectors with the largest hashes of their ids)."""
    held = index.vectors()
    asked = held.orderBy(F.xxhash64(index.ident).desc(), index.ident).limit(MEASURED).select(F.col(index.ident).alias("q"), "v")
    hits = dense(held, asked, index.ident, "q", "v", MEASURED_HITS + 1).filter(F.col("q") != F.col(index.ident))
    order = near_lists(asked, "q", "v", index.centres, len(index.centres)).withColumn("nth", F.monotonically_increasing_id())
    place = order.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("nth")))  # lists of a sample, nearest first
    found = hits.join(held.select(index.ident, "list"), index.ident).join(place.select("q", "list", "place"), ["q", "list"])
    got = found.agg(F.expr(f"percentile_approx(place, {SHARE}, 10000)").alias("p")).first()["p"]
    return int(got or 1)


def search(index: VectorIndex, queries: DataFrame, query: str, vector: str, k: int = 10, probes: int | None = None, digits: int = 4) -> DataFrame:
    """query, id, score, rank: the best k by cosine of the `probes` lists that are nearest to each query (those of the index, unless told otherwise)."""
    ident, asked_kind = index.ident, queries.schema[query].dataType.simpleString()
    asked = checkpointed(near_lists(queries.filter(F.size(vector) > 0), query, vector, index.centres, probes or index.probes))
    groups = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    asked = asked.join(F.broadcast(groups), "list").withColumn("nth", F.pmod(F.xxhash64(query), F.col("groups")).cast("int"))  # MOST_LISTS rows at most
    parts = index.vectors().join(F.broadcast(groups), "list").withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("list", "part", "nth", ident, "v")
    numbers = index.vectors().select("list", "part").distinct()
    meets = asked.join(numbers, "list").select("list", "part", "nth", F.col(query).alias("q"), F.col("v").alias("w"))
    dims = index.centres.shape[1]

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        x, rows = matrix(left.column("v"), dims)
        w, names = matrix(right.column("w"), dims)
        kept = min(k, len(x))
        if not kept or not len(w):
            return pa.table({"q": right.column("q").slice(0, 0), "i": left.column(ident).slice(0, 0), "score": pa.array([], pa.float64())})
        order = np.argsort(np.array(left.column(ident).take(pa.array(rows)).to_pylist(), dtype=object), kind="stable")  # ties: by id
        x, rows = x[order], rows[order]
        score = np.round(unit(w) @ unit(x).T, EXACT)
        best = np.argsort(-score, axis=1, kind="stable")[:, :kept]
        return pa.table({"q": right.column("q").take(pa.array(np.repeat(names, kept))), "i": left.column(ident).take(pa.array(rows[best.ravel()])), "score": np.take_along_axis(score, best, 1).ravel()})

    keys = ["list", "part", "nth"]
    found = parts.groupBy(*keys).cogroup(meets.groupBy(*keys)).applyInArrow(rank, f"q {asked_kind}, i {index.kind}, score double")
    return top_hits(found.select(F.col("q").alias(query), F.col("i").alias(ident), "score"), query, ident, k, digits=digits)


def recall(found: DataFrame, exact: DataFrame, query: str, ident: str) -> DataFrame:
    """queries, wanted, hits, recall: how many of the exact hits were found."""
    both = exact.select(query, ident).join(found.select(query, ident, F.lit(1).alias("hit")), [query, ident], "left")
    return both.agg(F.count_distinct(query).alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
