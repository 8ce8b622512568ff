"""A pair of Bloom filters over the digests of a table: one for those seen once, one for those seen twice."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def filter_bits(keys: int, per_key: int, least: int, most: int) -> int:
    """A power of two of about `per_key` bits a key, between the bounds (which are powers of two)."""
    return min(most, max(least, 1 << (keys * per_key).bit_length()))


def places(keys: list[bytes], bits: int) -> np.ndarray:
    """Two bit positions of each digest of 16 bytes."""
    words = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return (words & np.uint64(bits - 1)).astype(np.int64)


def suspected(keys: list[bytes], twice: np.ndarray, bits: int) -> np.ndarray:
    """Which of the digests have all their bits in the second filter: all repeated ones, and some others."""
    at = places(keys, bits)
    return ((twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def twice_seen(rows: DataFrame, spot: int, digests: Callable[[bytes | None], Iterable[bytes]], bits: int, slices: int) -> np.ndarray:
    """The second filter (bits / 8 bytes) over the digests of the values in column number `spot`.

    `slices` is the number of parts at most: smaller filters have fewer, of 32 KB each.
    A task fills both filters; they travel in slices, and a slice's parts are merged in one stream: a bit that two
    parts have set once is set twice. What reaches the driver is one filter, whatever the input.
    """

    slices = min(slices, max(16, bits >> 18))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys = [d for value in batch.column(spot).to_pylist() for d in digests(value)]
            if keys:
                at, n = np.unique(places(keys, bits).ravel(), return_counts=True)
                byte, mask = at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)
                again = (n > 1) | (once[byte] & mask > 0)
                np.bitwise_or.at(twice, byte[again], mask[again])
                np.bitwise_or.at(once, byte, mask)
        once, twice = once.reshape(slices, -1), twice.reshape(slices, -1)
        for k in np.flatnonzero(once.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([once[k].tobytes()]), pa.array([twice[k].tobytes()])], ["slice", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
                if k in held:
                    had, hit = held[k]
                    two, one = hit | two | (had & one), had | one
                held[k] = one, two
        for k, (one, two) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([one.tobytes()]), pa.array([two.tobytes()])], ["slice", "once", "twice"])

    kind = "slice int, once binary, twice binary"
    merged = rows.mapInArrow(fill, kind).repartition(slices, "slice").mapInArrow(merge, kind)
    out = np.zeros((slices, bits // 8 // slices), np.uint8)
    for row in merged.select("slice", "twice").toLocalIterator():
        out[row["slice"]] = np.frombuffer(row["twice"], np.uint8)
    return out.ravel()
