"""Quality scores by nearest neighbours: labelled latent-semantic vectors are broadcast, each document is compared with
all of them in blocks of exact cosine products, and its neighbours' labels are weighed by similarity.

The labelled vectors come from a bounded sample (`QualityConfig.sample` rows, those with the smallest hashes of doc_id),
which bounds the broadcast; every document is scored over its whole text.

Defined cases: a null text is an empty one; a text without a trigram (under 3 bytes) has no direction, and gets the
share of label 1 among the learned rows; with no labelled row every score is 0.5; null labels aren't learned from, and
of several labels for one document the largest counts; ties among neighbours go to the
smaller doc_id; of rows that share a learned doc_id, the one of the smallest vector is learned from. Only doc_id and
text of the documents, and doc_id and quality of the labels, are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import flat, text_bytes
from docquarry.llm.grams import counted, repeated


@dataclass(frozen=True)
class QualityConfig:
    #: Labelled rows learned from at most, hashed trigrams (a power of two), latent dimensions.
    sample: int = 4096
    bits: int = 12
    latent: int = 48
    neighbours: int = 25
    threshold: float = 0.3
    #: How much a text's repetition of itself counts beside its direction in latent space.
    echo: float = 2.0
    seed: int = 7


@dataclass
class QualityModel:
    """The projection from trigram counts to latent space, the labelled vectors in it, and their labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    bits: int
    echo: float

    def score(self, counts: np.ndarray, echoes: np.ndarray) -> np.ndarray:
        cosine = placed((np.log1p(counts) * self.idf) @ self.axes, echoes * self.echo) @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        near = nearest(cosine, k)
        sure = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 4 + 1e-9
        voted = (sure * self.labels[near]).sum(1) / sure.sum(1)
        return np.where(counts.sum(1) > 0, voted, self.labels.mean()).astype(np.float64)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k largest values; among equal ones the first columns."""
    bits = np.ascontiguousarray(cosine, np.float32).view(np.int32).astype(np.int64)
    order = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits)  # floats as numbers of the same order
    keys = (-order << 32) + np.arange(cosine.shape[1])
    return np.argpartition(keys, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.tile(np.arange(k), (len(cosine), 1))


def placed(z: np.ndarray, echoes: np.ndarray) -> np.ndarray:
    """Unit vectors: the direction in latent space, and beside it how far the text repeats itself."""
    z = z / np.maximum(np.sqrt((z**2).sum(1, keepdims=True)), 1e-9)
    z = np.hstack([z, echoes[:, None]]).astype(np.float32)
    return z / np.maximum(np.sqrt((z**2).sum(1, keepdims=True)), 1e-9)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def axes(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The leading right singular vectors of x, by randomised subspace iteration."""
    k = min(k, *x.shape)
    basis = np.random.default_rng(seed).standard_normal((x.shape[1], min(k + 16, x.shape[1]))).astype(np.float32)
    for _ in range(5):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ right.T)[:, :k].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> QualityModel | None:
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample)  # so many rows at most: small enough to broadcast
    ids = ids.select(F.col("doc_id").alias("__dq_id"), F.col("quality").cast("int").alias("__dq_label"))
    picked = docs.join(F.broadcast(ids), docs["doc_id"] == ids["__dq_id"]).select("doc_id", ids["__dq_label"].alias("label"), docs["text"].cast("binary").alias("text"))
    bits = config.bits

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            rows = [r.astype(np.float16).tobytes() for _, _, c in counted(raw, offsets, bits) for r in np.log1p(c)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary()), pa.array(repeated(raw, offsets))], ["doc_id", "label", "x", "echo"])

    rows = picked.mapInArrow(features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, x binary, echo float")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct("x", "echo")).alias("v")).select("doc_id", "label", "v.*").collect()  # a row for each id: the sample's bound
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.1).astype(np.float32)
    x *= idf
    own = axes(x, config.latent, config.seed)
    vectors = placed(x @ own, np.array([r["echo"] for r in rows], np.float32) * config.echo)
    return QualityModel(idf, own, vectors, np.array([r["label"] for r in rows], np.float32), config.neighbours, bits, config.echo)


def scored(docs: DataFrame, model: QualityModel | None, config: QualityConfig = QualityConfig()) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    threshold = config.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            echoes = repeated(raw, offsets) if own else None
            got = [own.score(c, echoes[lo:hi]) for lo, hi, c in counted(raw, offsets, own.bits)] if own else [np.full(batch.num_rows, 0.5)]
            score = np.clip(np.concatenate([np.zeros(0), *got]), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return text_bytes(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return scored(docs, fit(docs, labels, config), config).select("doc_id", held_out().alias("held_out"), "score", "predicted")
