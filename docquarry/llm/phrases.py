"""Phrases of many texts at once: words as numbers, hashes of phrases, and a bitmap of those that are looked for."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte that no UTF-8 text has: it stands between pieces.
MARK = 255
SEED = 42
#: Bits of a bitmap: about so many a phrase, a power of two between these bounds (128 MB at most, whatever the input).
BITS_PER_PHRASE, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 30


def coded(raw: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The words of `raw` (bytes, cut at blanks) as numbers of the second array's entries; -1 stands for MARK.

    alone: the bytes that are words by themselves, MARK among them; the last byte has to be one.
    """
    begins = alone.copy()
    begins[1:] |= (raw[:-1] == 32) | alone[:-1]
    begins[:1] = True
    keep = raw != 32
    solid = raw[keep]
    starts = np.flatnonzero(begins[keep])
    offsets = np.append(starts, len(solid)).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]).dictionary_encode()
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    codes[solid[starts] == MARK] = -1
    return codes, found.dictionary.cast(pa.binary())


def numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each distinct number is found first, how often, and each one's rank."""
    _, first, inverse, n = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
    return first, n, inverse


def hashed(codes: np.ndarray, words: pa.Array, place: np.ndarray, size: int, group: bytes = b"") -> np.ndarray:
    """The hash of the phrase of `size` words at each place: what there is is turned by seven bits, and the next word's XXH64 laid over it."""
    seed, digest = xxhash.xxh64_intdigest(group, SEED), xxhash.xxh64_intdigest
    own = np.fromiter((digest(w, seed) for w in words.to_pylist()), np.uint64, len(words))
    out = np.zeros(len(place), np.uint64)
    for k in range(size):
        out = ((out << np.uint64(7)) | (out >> np.uint64(57))) ^ own[codes[place + k]]
    return out


def places(codes: np.ndarray, size: int) -> np.ndarray:
    """Where phrases of `size` words begin."""
    inside = np.append(codes >= 0, np.zeros(size, bool))
    return np.flatnonzero(np.logical_and.reduce([inside[k : len(codes) + k] for k in range(size)]))


def bit_count(looked_for: DataFrame) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (looked_for.count() * BITS_PER_PHRASE).bit_length()))


def bitmap(looked_for: DataFrame, bits: int, group: str = "lang", phrase: str = "phrase") -> list[tuple[int, bytes]]:
    """Parts of 32,768 bits with the bits of all phrases: what reaches the driver has `bits` bits, whatever the input."""
    hashes = F.expr(f"aggregate(split({phrase}, ' '), 0L, (h, w) -> (shiftleft(h, 7) | shiftrightunsigned(h, 57)) ^ xxhash64({group}, w))")
    at = hashes.bitwiseAND(F.lit(bits - 1)) + 1  # parts and positions are numbered from 1
    parts = looked_for.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return [(row["part"], zlib.compress(row["bits"], 1)) for row in parts.toLocalIterator()]


class Passed:
    """The bitmap in a task: whether a phrase is perhaps looked for (one that is always passes)."""

    def __init__(self, parts: list[tuple[int, bytes]], bits: int) -> None:
        self.mask = np.uint64(bits - 1)
        self.bytes = np.zeros(max(bits // 8, 4096), np.uint8)
        for part, packed in parts:
            self.bytes[(part - 1) * 4096 : part * 4096] = np.frombuffer(zlib.decompress(packed), np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
