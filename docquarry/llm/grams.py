"""Hashed byte trigrams of many texts at once, counted with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes and documents counted together: bounds the memory of one step.
STEP_BYTES, STEP_DOCS = 1 << 19, 64


def steps(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of at most STEP_DOCS, and of about STEP_BYTES unless one text alone is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + STEP_BYTES, "right")) - 1
        hi = min(n, lo + STEP_DOCS, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def counted(raw: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, counts): how often each of 2**bits hashed trigrams is in each of the documents lo to hi - 1."""
    size = 1 << bits
    for lo, hi in steps(offsets):
        part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        docs = hi - lo
        if len(part) < 3:
            yield lo, hi, np.zeros((docs, size), np.float32)
            continue
        code = part[:-2].astype(np.uint32)
        code <<= np.uint32(8)
        code |= part[1:-1]
        code <<= np.uint32(8)
        code |= part[2:]
        code *= np.uint32(2654435761)
        code >>= np.uint32(32 - bits)
        inside = np.ones(len(part), bool)
        for back in (1, 2):  # a trigram must end in the text in which it begins
            last = own[1:] - back
            inside[last[last >= own[:-1]]] = False
        code += np.repeat(np.arange(docs, dtype=np.uint32) << np.uint32(bits), np.diff(own))[:-2]
        got = np.bincount(code[inside[:-2]], minlength=docs * size)
        yield lo, hi, got.reshape(docs, size).astype(np.float32)


#: Distances, in bytes, at which a text is compared with itself.
LAGS = range(3, 25)


def repeated(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The share of each text's four-byte windows that stand in it at a distance in LAGS before, too: words said again at once."""
    out = np.zeros(len(offsets) - 1, np.float32)
    for lo, hi in steps(offsets):
        part, own = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if len(part) < 4 + LAGS[0]:
            continue
        code = part[:-3].astype(np.uint32)
        for k in (1, 2, 3):
            code <<= np.uint32(8)
            code |= part[k : len(part) - 3 + k]
        again = np.zeros(len(code), bool)
        for lag in LAGS:
            again[lag:] |= code[lag:] == code[:-lag]
        total = np.concatenate([[0], np.cumsum(again)])
        at = np.minimum(own, len(code))
        # what the first windows of a text share with the text before is not a repetition
        start = np.minimum(at[:-1] + LAGS[-1], at[1:])
        out[lo:hi] = (total[at[1:]] - total[start]) / np.maximum(at[1:] - start, 1)
    return out
