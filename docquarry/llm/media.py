"""Media columns: payloads of 8-bit samples, cut into chunks by their content and stored with repeated chunks once.

A gear hash rolls over the payload and cuts it where the hash has enough zero bits, within a least and a largest chunk.
A first pass puts the chunks' digests into a pair of Bloom filters. The second writes the media: for each document the
ordered list of its chunks, those that no other place can have in line, and the others (suspected repeats) as digests
only, with their bytes in a chunk table that a Spark aggregation by digest reduces to one row a chunk. Reading joins
the lists with the chunk table by digest, puts the chunks in order, verifies every digest and the payload's, and works
on what it has read. Only documents with shared chunks take part in that join, each distinct payload once.

The stored form of a medium, self-contained, is "GEAR", the number of chunks (32 bits, little-endian), and for each
chunk its length (32 bits), digest (16 bytes) and samples; `media_bytes` and `media_sha256` are of that form, which
depends on the payload only.

Defined cases: a null or empty text has a payload of one frame of spaces; equal texts have equal values, also under
several or null doc_ids; very long texts have more chunks, never longer ones; an empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.blooms import filter_bits, suspected, twice_seen
from docquarry.llm.common import materialize, text_bytes


@dataclass(frozen=True)
class MediaConfig:
    #: Samples of a frame: payloads are multiples of it.
    frame: int = 192
    #: Least and largest bytes of a chunk, and the zero bits that end one (2,048 bytes beyond the least, on average).
    least: int = 512
    most: int = 8192
    zeros: int = 11
    #: Bits of the filters are a power of two of about so many a chunk, between these bounds (64 MB at most, filled at 30 million chunks).
    bits_per_chunk: int = 16
    least_bits: int = 1 << 20
    most_bits: int = 1 << 29
    slices: int = 1024


GEAR = (lambda x: ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(32))(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def payload_of(text: bytes | None, frame: int) -> bytes:
    text = text or b""
    return text + b" " * (max(frame, -(-len(text) // frame) * frame) - len(text))


def chunks(payload: bytes, config: MediaConfig) -> list[bytes]:
    if len(payload) <= config.least:
        return [payload]
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # a gear hash of the last 32 bytes, by doubling
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends = (np.flatnonzero(h >> np.uint32(32 - config.zeros) == 0) + 1).tolist()
    out, start, at = [], 0, 0
    while start < len(payload):
        while at < len(ends) and ends[at] < start + config.least:
            at += 1
        end = min(ends[at] if at < len(ends) else len(payload), start + config.most, len(payload))
        out.append(payload[start:end])
        start = end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def feature(payload: bytes, frame: int) -> str:
    """Frames, mean, root mean square about the mean, crossings of the mean, peak frame energy: of the samples as numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    total, squares = int(x.sum()), int((x * x).sum())
    above = x * len(x) > total
    energy = int((x.reshape(-1, frame) ** 2).sum(1).max())
    spread = max(0, squares * len(x) - total * total) ** 0.5 / len(x)
    return f"frames={len(x) // frame};mean={total / len(x):.4f};rms={spread:.4f};crossings={int((above[1:] != above[:-1]).sum())};peak={energy}"


def stored_form(parts: list[bytes], digests: list[bytes]) -> bytes:
    return b"GEAR" + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(p)) + d + p for p, d in zip(parts, digests, strict=True))


def samples_of(form: bytes) -> bytes:
    """The payload of a stored form, with each chunk verified."""
    if form[:4] != b"GEAR":
        raise ValueError("not a stored form")
    (n,), at, out = struct.unpack_from("<I", form, 4), 8, []
    for _ in range(n):
        (size,) = struct.unpack_from("<I", form, at)
        part = form[at + 20 : at + 20 + size]
        if digest(part) != form[at + 4 : at + 20]:
            raise ValueError("a chunk's bytes don't have its digest")
        out.append(part)
        at += 20 + size
    return b"".join(out)


def store(docs: DataFrame, config: MediaConfig = MediaConfig()) -> tuple[DataFrame, DataFrame]:
    """The media table (doc_id, n_bytes, media, digests, parts: null for those in the chunk table) and the chunk table (digest, samples), written to the shared folder."""
    # a chunk has `least` bytes and 2**zeros more on average; what is left of a text is one more
    about = docs.agg(F.sum(1 + F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / (config.least + (1 << config.zeros))))).first()[0] or 0
    bits = filter_bits(int(about), config.bits_per_chunk, config.least_bits, config.most_bits)
    frame = text_bytes(docs, "doc_id")
    twice = twice_seen(frame, 1, lambda text: map(digest, chunks(payload_of(text, config.frame), config)), bits, config.slices)
    shared = docs.sparkSession.sparkContext.broadcast(twice)
    ident = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # of this task
        for batch in batches:
            ids, sizes, media, lists, parts, extra = [], [], [], [], [], []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                payload = payload_of(text, config.frame)
                pieces = chunks(payload, config)
                names = [digest(p) for p in pieces]
                out = suspected(names, shared.value, bits).tolist()
                ids.append(own)
                sizes.append(len(text or b""))
                media.append(hashlib.sha256(payload).digest())
                lists.append(names)
                parts.append([None if s else p for p, s in zip(pieces, out, strict=True)])
                for name, p, s in zip(names, pieces, out, strict=True):
                    if s and name not in sent:
                        sent.add(name)
                        extra.append((name, p))
            n, m = len(ids), len(extra)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * n + [1] * m, pa.int32()),
                    pa.array(ids + [None] * m, batch.column(0).type),
                    pa.array(sizes + [None] * m, pa.int64()),
                    pa.array(media + [d for d, _ in extra], pa.binary()),
                    pa.array(lists + [None] * m, pa.list_(pa.binary())),
                    pa.array(parts + [[p] for _, p in extra], pa.list_(pa.binary())),
                ],
                ["kind", "doc_id", "n_bytes", "media", "digests", "parts"],
            )

    both = materialize(frame.mapInArrow(write, f"kind int, doc_id {ident}, n_bytes long, media binary, digests array<binary>, parts array<binary>"))
    table = both.filter("kind = 1").select(F.col("media").alias("digest"), F.col("parts")[0].alias("samples"))
    return both.filter("kind = 0").drop("kind"), table.groupBy("digest").agg(F.first("samples").alias("samples"))


VALUES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read(media: DataFrame, table: DataFrame, config: MediaConfig = MediaConfig(), payloads: bool = False) -> DataFrame:
    """doc_id, n_bytes and what is read of each medium's stored form; with its payload, where that is asked for."""
    ident = media.schema["doc_id"].dataType.simpleString()
    extra = ", payload binary" if payloads else ""
    names = [*(x.split()[0] for x in VALUES.split(", ")), *(["payload"] if payloads else [])]

    def work(columns: int):  # noqa: ANN202
        """Of rows that begin with `columns` columns to keep: then media, digests, parts, and the parts of the chunk table by place."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in zip(*(c.to_pylist() for c in batch.columns[columns:]), strict=True):
                    media, digests, parts = row[:3]
                    if len(row) > 3:
                        for x in row[3] or ():
                            parts[x["place"]] = x["samples"]
                    if any(p is None for p in parts):
                        raise ValueError("the chunk table lacks a chunk")
                    form = stored_form(parts, digests)
                    payload = samples_of(form)
                    whole = hashlib.sha256(payload)
                    if whole.digest() != media:
                        raise ValueError("a payload isn't what was stored")
                    out.append((len(payload), whole.hexdigest(), zlib.crc32(payload[-16:]), len(form), hashlib.sha256(form).hexdigest(), feature(payload, config.frame), payload)[: len(names)])
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                kept = batch.schema.names[:columns]
                yield pa.RecordBatch.from_arrays([*batch.columns[:columns], *(pa.array([x[k] for x in out], kinds[k]) for k in range(len(names)))], [*kept, *names])

        return run

    lacks = F.exists("parts", lambda p: p.isNull())
    alone = media.filter(~lacks).mapInArrow(work(2), f"doc_id {ident}, n_bytes long, {VALUES}{extra}")
    split = media.filter(lacks)
    lists = split.groupBy("media").agg(F.first(F.struct("digests", "parts")).alias("x")).select("media", "x.*")
    wanted = lists.select("media", F.posexplode(F.arrays_zip("digests", "parts")).alias("place", "x")).filter("x.parts IS NULL").select("media", "place", F.col("x.digests").alias("digest"))
    fetched = wanted.join(table, "digest").groupBy("media").agg(F.collect_list(F.struct("place", "samples")).alias("fetched"))  # of one medium
    joined = lists.join(fetched, "media").select(F.col("media").alias("own"), "media", "digests", "parts", "fetched")
    values = joined.mapInArrow(work(1), f"own binary, {VALUES}{extra}")
    return alone.unionByName(split.select("doc_id", "n_bytes", F.col("media").alias("own")).join(values, "own").drop("own"))


def media_column(docs: DataFrame, config: MediaConfig = MediaConfig()) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document, read back from what was stored."""
    return read(*store(docs, config), config)
