"""Homomorphic multiset fingerprints of documents.

A paragraph (a line of the text, also an empty one) is hashed to a wide vector; a document's fingerprint is the sum of
its paragraphs' vectors, each lane modulo a power of two. So the order of paragraphs doesn't matter, equal multisets
have equal fingerprints, and a paragraph is inserted or deleted by adding or subtracting its vector. The first lanes
are the words of a paragraph's BLAKE2b digest of 512 bits (equality); the others hold, in 32 bits, the signed counts of
the paragraph's word windows in a fast AMS sketch: the squared length of a difference estimates the size of the
multisets' difference, and from it their likeness, 1 - |A - B|^2 / (|A|^2 + |B|^2), cut to 0..1. Words are hashed by two
polynomials modulo primes of 31 bits.

`edited` compares each document with its text as edited from the next document's beginning. Documents meet their
successors in ranges of doc_id: the bounds of the ranges are quantiles (so many documents a range, whatever the input),
each range gets a copy of the first document of the next one, and every document is read once in order.

Defined cases: a null text is an empty one; an empty text has no paragraph and the zero fingerprint, and two such are
alike (1); rows are ordered by doc_id, and among repeated rows of an id by text; a null doc_id comes before all others;
a single document is its own next one; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import bounded_batches

#: Lanes of 64 bits for equality, lanes of 32 bits for likeness, words of a window.
EXACT, SKETCH, WINDOW = 8, 64, 3
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
#: Documents of a range of doc_id, about, and ranges (a long and an int each) that are broadcast at most.
RANGE_DOCS, BROADCAST_ROWS = 1_000_000, 1 << 19
ODD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: White space of ASCII.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Primes of 31 bits, and a base for each.
MODULI = ((2147483647, 1103515245), (2147483629, 1812433253))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: Bytes of a word that are hashed at once.
SPAN = 32


def powers(prime: int, base: int) -> np.ndarray:
    out = [1]
    for _ in range(SPAN - 1):
        out.append(out[-1] * base % prime)
    return np.array(out, np.uint64)


POWERS = [(np.uint64(prime), powers(prime, base)) for prime, base in MODULI]


def word_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64 bits of each word raw[first:last]: words of up to SPAN bytes by two polynomials, all at once; longer ones (rare) by BLAKE2b."""
    size = last - first
    out = np.zeros(len(first), np.uint64)
    short = size <= SPAN
    lengths = size[short]
    owner = np.repeat(np.flatnonzero(short), lengths)
    begins = np.cumsum(lengths) - lengths
    place = np.arange(len(owner)) - np.repeat(begins, lengths)
    values = raw[first[owner] + place].astype(np.uint64) + np.uint64(1)
    for k, (prime, base) in enumerate(POWERS):
        if len(values):
            part = np.add.reduceat(values * base[place] % prime, begins) % prime
            out[short] |= part << np.uint64(32 * k)
    out[short] ^= lengths.astype(np.uint64) * ODD
    for k in np.flatnonzero(~short).tolist():
        out[k] = np.frombuffer(hashlib.blake2b(raw[first[k] : last[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return mixed(out)


class Vector:
    """A fingerprint: sums of lanes."""

    __slots__ = ("exact", "sketch")

    def __init__(self, exact: np.ndarray, sketch: np.ndarray) -> None:
        self.exact, self.sketch = exact, sketch

    def __add__(self, other: Vector) -> Vector:
        return Vector(self.exact + other.exact, self.sketch + other.sketch)

    def __sub__(self, other: Vector) -> Vector:
        return Vector(self.exact - other.exact, self.sketch - other.sketch)

    def hex(self) -> str:
        return (self.exact.tobytes() + self.sketch.tobytes()).hex()

    def like(self, other: Vector) -> float:
        a, b = self.sketch.view(np.int32).astype(np.float64), other.sketch.view(np.int32).astype(np.float64)
        if (self.exact == other.exact).all():
            return 1.0
        both = (a @ a) + (b @ b)
        return float(min(1.0, max(0.0, 1 - ((a - b) @ (a - b)) / both))) if both else 0.0


def vector(text: bytes) -> Vector:
    """The sum over the paragraphs of a text."""
    return paragraphs(text) if text else Vector(np.zeros(EXACT, np.uint64), np.zeros(SKETCH, np.uint32))


def paragraphs(text: bytes) -> Vector:
    """The sum over the lines of a text, an empty text being an empty line."""
    sketch = np.zeros(SKETCH, np.uint32)
    own = b"".join([hashlib.blake2b(line).digest() for line in text.split(b"\n")])
    exact = np.frombuffer(own, np.uint64).reshape(-1, EXACT).sum(0, dtype=np.uint64)
    raw = np.frombuffer(text, np.uint8)
    dark = np.concatenate([[True], BLANK[raw], [True]])
    edge = np.flatnonzero(dark[1:] != dark[:-1])
    first, last = edge[::2], edge[1::2]
    if len(first):
        word = word_hashes(raw, first, last)
        line = np.searchsorted(np.flatnonzero(raw == 10), first, "left")
        window = word.copy()
        for k in range(1, WINDOW):  # the words that follow in the same paragraph
            window[:-k] += np.where(line[k:] == line[:-k], word[k:] * np.uint64(2 * k + 1), np.uint64(0)) if len(word) > k else 0
        window = mixed(window)
        lane, sign = (window & np.uint64(SKETCH - 1)).astype(np.int64), (window >> np.uint64(63)).astype(np.int64)
        counts = np.bincount(lane + SKETCH * sign, minlength=2 * SKETCH)
        sketch = (counts[:SKETCH] - counts[SKETCH:]).astype(np.int64).astype(np.uint32)
    return Vector(exact, sketch)


def edit(text: bytes, after: bytes) -> tuple[int, bytes, int]:
    """Code points of the text, the text with its last quarter replaced by as much of the next one's beginning, and the bytes that stay."""
    if text.isascii() and after.isascii():
        n = len(text)
        return n, text[: n - n // 4] + after[: n // 4], n - n // 4
    whole, other = text.decode("utf-8", "replace"), after[: len(text) + 4].decode("utf-8", "ignore")
    n = len(whole)
    kept = whole[: n - n // 4].encode()
    return n, kept + other[: n // 4].encode(), len(kept)


def changed_vector(text: bytes, own: Vector, changed: bytes, same: int) -> Vector:
    """The vector of `changed`, which begins with the first `same` bytes of `text`: the paragraphs from there on are deleted and inserted."""
    line = text.rfind(b"\n", 0, same) + 1
    if not line:
        return vector(changed)
    return own - paragraphs(text[line:]) + paragraphs(changed[line:])


def bounds(docs: DataFrame) -> list[int]:
    """Where the ranges of doc_id begin, the first excepted: quantiles, sorted and told apart."""
    spark: SparkSession = docs.sparkSession
    want = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")), docs.count() // RANGE_DOCS)
    found = docs.agg(F.percentile_approx("doc_id", [k / want for k in range(1, want)], max(10_000, 2 * want))).first()[0] if want > 1 else []
    return sorted(set(found or []))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    starts = bounds(docs)
    cuts = np.array(starts, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.fillna(-(2**63)).to_numpy(np.int64), "right").astype(np.int32))

    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.col("text").cast("binary").alias("__dq_text"), range_of(F.col("doc_id").cast("long")).alias("__dq_range"))
    heads = docs.select(F.struct(F.col("doc_id").isNotNull(), "doc_id").alias("__dq_key"), range_of(F.col("doc_id").cast("long")).alias("__dq_range")).groupBy("__dq_range").agg(F.min("__dq_key")["doc_id"].alias("__dq_head")).collect()  # a row for each range
    filled = sorted(r["__dq_range"] for r in heads)
    head = {r["__dq_range"]: r["__dq_head"] for r in heads}
    before = {head[b]: a for a, b in zip([filled[-1], *filled[:-1]], filled, strict=True)} if heads else {}
    owners = spark.createDataFrame([(k, v) for k, v in before.items()], f"__dq_head {kind}, __dq_before int")
    # the head of each range, once more, behind the range before it; the first head ends the last range
    texts = docs.select(F.col("doc_id").alias("__dq_head_id"), F.col("text").cast("binary").alias("__dq_text"))
    if len(before) <= BROADCAST_ROWS:
        owners = F.broadcast(owners)
    guard = texts.join(owners, texts["__dq_head_id"].eqNullSafe(owners["__dq_head"]))  # a row for each range
    guard = guard.groupBy("__dq_before").agg(F.min_by("__dq_text", F.struct(F.coalesce("__dq_text", F.lit(b"")))).alias("__dq_text"))
    rows = given.withColumn("__dq_last", F.lit(False)).unionByName(guard.select(F.lit(None).cast(kind).alias("doc_id"), "__dq_text", F.col("__dq_before").alias("__dq_range"), F.lit(True).alias("__dq_last")))
    ordered = rows.repartition("__dq_range").sortWithinPartitions("__dq_range", "__dq_last", F.col("doc_id").asc_nulls_first(), F.coalesce("__dq_text", F.lit(b"")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            for own, text, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text or b""
                now = vector(text)
                if held is not None:
                    ident, before_text, was = held
                    n, changed, same = edit(before_text, text)
                    other = changed_vector(before_text, was, changed, same)
                    out.append((ident, n, hashlib.sha256(changed).hexdigest(), was.hex(), other.hex(), was.like(other), was.like(now)))
                held = None if last else (own, text, now)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], NAMES)

    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
