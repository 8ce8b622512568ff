"""Line deduplication by two Bloom filters, of hashes seen once and of hashes seen twice.

A first pass over the texts sets, for the key of each line that is long enough, its bits in the filters: a bit that
two keys set, in one task or in two, is set in the second filter as well. A second pass sends only keys whose bits are
all in the second filter to a shuffle, where 128-bit digests confirm exactly how many documents hold a key and which
of them keeps it. A third pass drops the lines. Neither filter misses a repeated key; a key that is alone gets into
the shuffle when other keys happen to share its bits, which costs time and changes nothing.

Defined cases: a null or empty text is one empty line; white space is ASCII only; rows that share a doc_id count as
one document and are treated alike; all rows of a null doc_id count as one document, smaller than any other; an empty
table gives an empty result. `dedup_lines` reads doc_id and text only; `drop_lines` keeps the other columns as they
are, whatever their names (names that begin with __dq_ are its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.blooms import filter_bits, suspected, twice_seen
from docquarry.llm.common import bounded_batches, materialize


@dataclass(frozen=True)
class LineConfig:
    #: A key is compared when it has so many code points, and dropped when so many documents hold it.
    least_chars: int = 20
    least_docs: int = 3
    #: Bits of each of the two filters: a power of two of about so many a line that is long enough, between these bounds
    #: (64 MB at most: a proven bound of what is broadcast, filled at 30 million lines); parts they are merged in.
    bits_per_key: int = 16
    least_bits: int = 1 << 20
    most_bits: int = 1 << 29
    slices: int = 1024
    #: Parts that a repeated key's documents are dealt into.
    salts: int = 16


def key_of(line: bytes, least: int) -> bytes | None:
    """The line without ASCII white space at its ends, A-Z in lower case; None if it is too short to compare."""
    key = line.strip().lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def digests(text: bytes | None, least: int) -> set[bytes]:
    return {digest(key) for line in (text or b"").split(b"\n") if (key := key_of(line, least)) is not None}


def whole_id() -> Column:
    """doc_id with a value in place of null, so that it can be compared and joined."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("__dq_id")


def narrow(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(whole_id(), F.col("text").cast("binary").alias("__dq_text"))


def lines_at_most(docs: DataFrame, least: int) -> int:
    """No fewer lines than those that are long enough to be compared: by line ends, and by how many of them fit into a text."""
    size = F.octet_length("text")
    ends = size - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return docs.agg(F.sum(F.least(ends, F.floor(size / least)).cast("long"))).first()[0] or 0


def drops(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """__dq_id and __dq_drop: for each document that loses lines, the digests of their keys."""
    bits, least = filter_bits(lines_at_most(docs, config.least_chars), config.bits_per_key, config.least_bits, config.most_bits), config.least_chars
    twice = twice_seen(narrow(docs), 1, lambda text: digests(text, least), bits, config.slices)
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in batches:
            owners, keys = [], []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(digests(text, least))
                keys += found
                owners += [own] * len(found)
            if not keys:
                continue
            hit = np.flatnonzero(suspected(keys, twice, bits))
            yield pa.RecordBatch.from_arrays([pa.array([owners[k] for k in hit], pa.int64()), pa.array([keys[k] for k in hit], pa.binary())], ["__dq_id", "__dq_key"])

    found = materialize(narrow(docs).mapInArrow(suspects, "__dq_id long, __dq_key binary"))
    repeated = found.groupBy("__dq_key").agg(F.count_distinct("__dq_id").alias("__dq_docs"), F.max("__dq_id").alias("__dq_keeps")).filter(F.col("__dq_docs") >= config.least_docs)
    # A key that very many documents hold is dealt by document as well: each of its parts meets its own copy of the one row.
    salt = F.pmod(F.xxhash64("__dq_id"), F.lit(config.salts)).cast("int").alias("__dq_salt")
    copies = repeated.withColumn("__dq_salt", F.explode(F.sequence(F.lit(0), F.lit(config.salts - 1))))
    lost = found.select("*", salt).join(copies, ["__dq_key", "__dq_salt"]).filter(F.col("__dq_id") != F.col("__dq_keeps"))
    return lost.groupBy("__dq_id").agg(F.collect_set("__dq_key").alias("__dq_drop"))


def cut(text: bytes | None, lost: set[bytes], least: int) -> tuple[int, int, bytes]:
    """Lines of the text, lines dropped, and what stays."""
    if not lost:
        text = text or b""
        return text.count(b"\n") + 1, 0, text
    lines = (text or b"").split(b"\n")
    kept = [line for line in lines if (key := key_of(line, least)) is None or digest(key) not in lost]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def dedup_lines(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    least = config.least_chars
    bounded_batches(docs.sparkSession)
    both = docs.select("doc_id", whole_id(), F.col("text").cast("binary").alias("__dq_text")).join(drops(docs, config), "__dq_id", "left").select("doc_id", "__dq_text", "__dq_drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [cut(text, set(lost or ()), least) for text, lost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            sums = [hashlib.sha256(kept).hexdigest() for _, _, kept in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array(sums, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return both.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """The rows of `docs` without the dropped lines; n_chars, where there is one, follows the text. A null text stays null."""
    least = config.least_chars
    names = docs.columns
    both = docs.withColumn("__dq_id", whole_id()).join(drops(docs, config), "__dq_id", "left").select(*names, "__dq_drop")
    spot = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = batch.column(spot), batch.column(len(names)).to_pylist()
            hit = [k for k, x in enumerate(lost) if x]
            columns = list(batch.columns[: len(names)])
            if hit:
                values = texts.to_pylist()
                for k in hit:
                    if values[k] is not None:
                        values[k] = cut(values[k].encode(), set(lost[k]), least)[2].decode()
                columns[spot] = pa.array(values, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = both.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in names else out
