"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has 64 bits, each the majority of that bit in the hashes of its word shingles. Two
fingerprints that differ in at most four bits differ in at most two in the upper half or in at most one in the lower
one. Each distinct fingerprint enters the tables of its two halves under every value in the Hamming ball of radius 1
around its half, so fingerprints whose halves are at most two bits apart meet under some value; their complete
distances are then verified. Of a table's entry only a spanning star of each verified group is kept, never all pairs.
Entries with very many fingerprints are dealt anew by parts of the other half: of its eight parts of four bits, four at
least are equal, so each of the 70 choices of four is a further table, whose entries are bounded by construction.
Copies are one fingerprint from the start.

Defined cases: a null text, or one without words, has fingerprint zero and is linked like any other; a text of fewer
words than a shingle has is one shingle; rows with equal texts have equal fingerprints and one component; rows of a
null doc_id belong to components like others, but never name one (a component of such rows only has a null name); an
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import ROW, first_of_each, materialize, named_rows, text_bytes
from docquarry.llm.components import components


@dataclass(frozen=True)
class SimhashConfig:
    words: int = 4
    seed: int = 42
    distance: int = 4
    #: Fingerprints of a table's entry that are compared in one go; longer entries are dealt anew.
    entry: int = 4096


#: Of each byte, its bits from the lowest.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
LANES = (np.arange(8) * 256).astype(np.uint16)
BALL = np.concatenate([[0], 1 << np.arange(32, dtype=np.uint64)]).astype(np.uint64)


def fingerprint(text: bytes | None, words: int, seed: int) -> int:
    found = (text or b"").lower().split()  # of bytes: A-Z only, and white space of ASCII only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate(len(w) + 1 for w in found))
        starts = [0, *ends]
        one = xxhash.xxh64_intdigest
        hashes = [one(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :])]  # noqa: B905
    lanes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8) + LANES
    ones = (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ BITS).ravel()
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, config: SimhashConfig = SimhashConfig(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, and fp (the 64 bits of a text's fingerprint as a long) of every row."""
    words, seed = config.words, config.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got.view(np.int64))], [*keep, "fp"])

    return text_bytes(docs, *keep).mapInArrow(run, ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep), "fp long"]))


def verified(members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of members linked by verified distances, each as (member, its group's smallest): a search that compares the newly reached with all that aren't."""
    left, nodes, roots = np.unique(members), [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        reached = np.array([root], np.uint64)
        while len(reached) and len(left):
            hit = np.zeros(len(left), bool)
            for k in range(0, len(reached), 64):
                hit |= (np.bitwise_count(reached[k : k + 64, None] ^ left[None, :]) <= distance).any(0)
            reached, left = left[hit], left[~hit]
            nodes.append(reached)
            roots.append(np.full(len(reached), root, np.uint64))
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *nodes]), np.concatenate([empty, *roots])


def matcher(distance: int, entry: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by key: (member, root, 0) for verified groups; of keys with more than `entry` rows, (member, key, 1) for each row."""

    def packed(a: np.ndarray, b: np.ndarray, late: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), late, np.int32))], ["u", "v", "late"])

    def runs(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.diff(keys)) + 1
        lo, hi = np.append(0, edge), np.append(edge, len(keys))
        two = lo[hi - lo == 2]
        a, b = fps[two], fps[two + 1]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        if near.any():
            yield packed(np.maximum(a, b)[near], np.minimum(a, b)[near], 0)
        for x, y in zip(lo[hi - lo > 2], hi[hi - lo > 2], strict=True):
            if entry and y - x > entry:
                yield packed(fps[x:y], keys[x:y].view(np.uint64), 1)
            else:
                nodes, roots = verified(fps[x:y], distance)
                if len(nodes):
                    yield packed(nodes, roots, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, late = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if late is not None:  # the rest of a key whose rows went on before
                n = int(np.searchsorted(keys, late, "right"))
                if n:
                    yield packed(fps[:n], keys[:n].view(np.uint64), 1)
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    continue
                late = None
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield from runs(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
            if entry and len(keys) > entry:
                yield packed(fps, keys.view(np.uint64), 1)
                keys, fps, late = keys[:0], fps[:0], keys[-1]
        if len(keys):
            yield from runs(keys, fps)

    return run


def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) for every value within a bit of either half; the key names the half."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            fps = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
            upper = (fps >> np.uint64(32))[:, None] ^ BALL
            lower = ((fps & np.uint64(0xFFFFFFFF))[:, None] ^ BALL) | np.uint64(1 << 32)
            keys = np.hstack([upper, lower]).ravel().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(fps, 2 * len(BALL)).view(np.int64))], ["key", "fp"])


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) for each choice of four of the other half's eight parts, with the first key."""
    masks = np.array([sum(15 << 4 * p for p in c) for c in combinations(range(8), 4)], np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
            first = batch.column(1).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
            other = np.where(first >> np.uint64(32), fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF))
            mixed = (first[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (((other[:, None] & masks) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (masks * np.uint64(0x165667B19E3779F9))
            yield pa.RecordBatch.from_arrays([pa.array(mixed.ravel().view(np.int64)), pa.array(np.repeat(fps, len(masks)).view(np.int64))], ["key", "fp"])


def links(distinct: DataFrame, config: SimhashConfig = SimhashConfig()) -> DataFrame:
    """u, v: edges that join exactly the fingerprints (column fp, each once) which chains of links join."""
    if config.distance > 4:
        raise ValueError("two halves with balls of radius 1 find distances up to 4 only")
    kind = "u long, v long, late int"

    def met(keyed: DataFrame, entry: int | None) -> DataFrame:
        return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(matcher(config.distance, entry), kind)

    first = materialize(met(distinct.select("fp").mapInArrow(balls, "key long, fp long"), config.entry))
    late = first.filter("late = 1").select(F.col("u").alias("fp"), F.col("v").alias("key"))
    again = met(late.mapInArrow(parts, "key long, fp long"), None)
    return first.filter("late = 0").select("u", "v").unionByName(again.select("u", "v"))


def rooted(distinct: DataFrame, config: SimhashConfig = SimhashConfig()) -> DataFrame:
    """`distinct` (column fp, each once) with root: a fingerprint that names the component."""
    linked = components(links(distinct, config))
    return materialize(distinct.join(linked, distinct["fp"] == linked["node"], "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root")))


def grouped(docs: DataFrame, config: SimhashConfig = SimhashConfig(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, fp, root (a fingerprint that names the component) and component_id of every row."""
    prints = materialize(fingerprints(docs, config, keep))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = rooted(distinct, config)
    heads = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(heads, "root").select("fp", "root", "component_id"), "fp").select(*keep, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, config: SimhashConfig = SimhashConfig()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return grouped(docs, config).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, config: SimhashConfig = SimhashConfig()) -> DataFrame:
    """One row of each group: of those of its smallest doc_id (a null one only where there is no other), the first in its file."""
    named = named_rows(docs)
    return first_of_each(named, grouped(named, config, ROW), "root").select(*docs.columns)
