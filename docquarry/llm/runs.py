"""Runs of words that repeat periodically, found in a suffix tree of each text (the method of Stoye and Gusfield).

A batch of texts makes one forest of suffix trees, kept as arrays: suffixes are sorted by doubling, and the classes of
equal stretches of 1, 2, 4, ... words, which the sort goes through anyway, answer how far two suffixes agree. The inner
nodes are the intervals of that order. At a node of depth d, all children but the one with the most leaves are walked
(so a leaf is walked a logarithmic number of times in all): a leaf i for which i + d is a leaf below the same node, and
one for which i - d is, begins a tandem repeat of period d, which is branching if the words after both halves differ.
A branching repeat is the last of its run: rotated to the left as far as words agree, it covers the run. Repeats
that cover the same stretch are merged, and the smallest period stays.

Defined cases: a null text has no words; words are what stands between ASCII white space; repeats never go across texts;
repeated rows are treated alike; an empty table gives an empty result. `runs` reads the text and the columns named; a
text is worked on in one task, with about 150 bytes a word and 4 more for each doubling of its longest repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import bounded_batches

KIND = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@dataclass(frozen=True)
class RunConfig:
    #: A run has at least so many words, and at least so many periods.
    least_words: int = 6
    least_periods: int = 4


@dataclass
class Forest:
    """Suffixes of all texts in order, and the classes of equal stretches of 2**k words (levels[k])."""

    order: np.ndarray
    slot: np.ndarray
    levels: list[np.ndarray]


def sorted_suffixes(symbols: np.ndarray) -> Forest:
    """Suffixes sorted by doubling; each text ends with a symbol of its own, which is nowhere else."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    heads = np.append(True, np.diff(symbols[order]) != 0)
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    levels, step = [rank], 1
    single = heads & np.append(heads[1:], True)
    slots = np.flatnonzero(~single)
    while len(slots):
        own = order[slots]
        key = rank[own].astype(np.int64) * (n + 1) + rank[own + step]
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[slots] = own
        heads = np.append(True, np.diff(key) != 0)
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(heads, slots, 0))
        step *= 2
        slots = slots[~(heads & np.append(heads[1:], True))]
        if len(slots):  # a level without a repeated stretch answers nothing
            levels.append(rank)
    slot = np.empty(n, np.int32)
    slot[order] = np.arange(n, dtype=np.int32)
    return Forest(order, slot, levels)


def agreement(forest: Forest, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words agree from the places a and b on, or right before them: a binary search over the levels."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(forest.levels) - 1, -1, -1):
        size, rank = 1 << k, forest.levels[k]
        x, y = (a - out - size, b - out - size) if back else (a + out, b + out)
        ok = np.minimum(x, y) >= 0
        ok[ok] = rank[x[ok]] == rank[y[ok]]
        out[ok] += size
    return out


def bounds(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest ones before and behind with a smaller value (or the ends), by minima of 2**k values."""
    n = len(depth)
    tables, size = [depth], 1
    gap = np.diff(np.append(np.append(-1, np.flatnonzero(depth == 0)), n)).max()  # no interval is longer
    while 2 * size <= min(gap, n):
        tables.append(np.minimum(tables[-1][:-size], tables[-1][size:]))
        size *= 2
    at = np.arange(n)
    left, right = at.copy(), at + 1
    for k in range(len(tables) - 1, -1, -1):
        size, table = 1 << k, tables[k]
        go = left >= size
        go[go] = table[left[go] - size] >= depth[go]
        left[go] -= size
        go = right + size <= n
        go[go] = table[right[go]] >= depth[go]
        right[go] += size
    return left - 1, right


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, ... of each stretch, and which stretch each is of."""
    which = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


def light_children(forest: Forest) -> tuple[np.ndarray, ...]:
    """For each inner node, the leaves of all its children but the largest: leaf, the node's depth, and its first and last slot."""
    order = forest.order
    # the slots that agree with the one before in a word at least: each parts two children of one node
    first = forest.levels[0][order]
    parts = np.flatnonzero(first[1:] == first[:-1]) + 1
    depth = np.ones(len(parts), np.int64)
    if len(forest.levels) > 1:  # most agree in one word only
        second = forest.levels[1][order]
        deep = np.flatnonzero(second[parts] == second[parts - 1])
        depth[deep] = agreement(forest, order[parts[deep] - 1], order[parts[deep]])
    # a barrier before each series of parting slots that follow each other
    breaks = np.append(True, np.diff(parts) != 1) if len(parts) else np.zeros(0, bool)
    place = np.arange(len(parts)) + np.cumsum(breaks)
    laid = np.zeros(len(parts) + int(breaks.sum()) + 1, np.int64)
    laid[place] = depth
    lo, hi = bounds(laid)
    low, high = parts - (place - lo[place]), parts + (hi[place] - place)  # the node has the slots low .. high - 1
    by = np.lexsort((parts, high, low))
    low, high, cut, depth = low[by], high[by], parts[by], depth[by]
    fresh = np.append(True, (np.diff(low) != 0) | (np.diff(high) != 0)) if len(low) else np.zeros(0, bool)
    node = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    # children: from low to the first cut, from cut to cut, from the last cut to high
    ends = np.append(cut[1:], 0)[: len(cut)]
    last = np.append(fresh[1:], True) if len(low) else fresh
    ends[last] = high[last]
    begin, end = np.concatenate([low[heads], cut]), np.concatenate([cut[heads], ends])
    owner = np.concatenate([node[heads], node])
    sizes = end - begin
    most = np.zeros(len(heads), np.int64)
    np.maximum.at(most, owner, sizes)
    heavy = np.flatnonzero(sizes == most[owner])
    _, one = np.unique(owner[heavy], return_index=True)
    light = np.ones(len(begin), bool)
    light[heavy[one]] = False
    slots, which = spread(begin[light], sizes[light])
    which = owner[light][which]
    return order[slots], depth[heads][which], low[heads][which], high[heads][which]


def branching_repeats(forest: Forest, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start and period of each tandem repeat whose next word differs from the word at its half."""
    leaf, depth, low, high = light_children(forest)
    found = []
    for shift in (depth, -depth):
        ok = (leaf + shift >= 0) & (leaf + shift < len(symbols))
        at = forest.slot[(leaf + shift)[ok]]
        ok[ok] = (at >= low[ok]) & (at < high[ok])
        start, period = np.minimum(leaf[ok], leaf[ok] + shift[ok]), depth[ok]
        parted = symbols[start + period] != symbols[start + 2 * period]
        found.append(start[parted] * len(symbols) + period[parted])
    return np.divmod(np.unique(np.concatenate(found)), len(symbols))


def maximal_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end (exclusive) and smallest period of all maximal runs of two periods or more, by start and period.

    `symbols` are the words of all texts as numbers of 0 or more, each text followed by a symbol that is nowhere else.
    """
    if len(symbols) < 2:
        return (np.zeros(0, np.int64),) * 3
    forest = sorted_suffixes(symbols)
    start, period = branching_repeats(forest, symbols)
    end = start + 2 * period
    start = start - agreement(forest, start, start + period, back=True)
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    kept = np.append(True, (np.diff(start) != 0) | (np.diff(end) != 0))[: len(start)]
    start, end, period = start[kept], end[kept], period[kept]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def numbered_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers that differ between texts, each text with its own last symbol, and where texts begin."""
    sizes = np.array([len(words) for words in texts], np.int64)
    flat = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    codes, kinds = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(flat.dictionary) + 1
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.repeat(np.arange(len(texts), dtype=np.int64) * kinds, sizes + 1)
    inside = np.ones(len(symbols), bool)
    inside[begins[1:] - 1] = False
    symbols[inside] += codes
    symbols[~inside] += kinds - 1
    return symbols, begins


def summary(words: list[bytes], start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple:
    """The columns of KIND for one text and its runs (places within the text)."""
    if not len(start):
        return 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
    each = list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True))
    s, n, q = min(each, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]))
    said = "".join(f"{a},{b},{c}\n" for a, b, c in each)
    drops = np.bincount(start + period, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
    kept = np.flatnonzero(np.cumsum(drops)[: len(words)] == 0).tolist()
    collapsed = b" ".join([words[k] for k in kept])
    return len(each), s, n, q, 1000 * n // q, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()


def batch_summaries(texts: list[bytes | None], config: RunConfig) -> list[tuple]:
    words = [(text or b"").split() for text in texts]  # bytes are split at ASCII white space
    symbols, begins = numbered_words(words)
    start, end, period = maximal_runs(symbols)
    long = (end - start >= config.least_words) & (end - start >= config.least_periods * period)
    start, end, period = start[long], end[long], period[long]
    cuts = np.searchsorted(start, begins)
    return [summary(w, start[lo:hi] - at, end[lo:hi] - at, period[lo:hi]) for w, at, lo, hi in zip(words, begins, cuts, cuts[1:], strict=False)]


def runs(docs: DataFrame, *keep: str, text: Column | str = "text", config: RunConfig = RunConfig()) -> DataFrame:
    """The columns `keep`, and of each text: its number of runs, the run of most periods (ties: first, then shortest period), and digests of all runs and of the words that stay when each run keeps its first period only."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = zip(*batch_summaries(batch.column(len(keep)).to_pylist(), config), strict=True) if batch.num_rows else [()] * 7
            values = [pa.array(list(v), pa.string() if k > 4 else pa.int64()) for k, v in enumerate(got)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *values], [*keep, *names])

    names = [field.split()[0] for field in KIND.split(", ")]
    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    value = F.col(text) if isinstance(text, str) else text
    return docs.select(*keep, value.cast("binary").alias("__dq_text")).mapInArrow(work, fields + KIND)


def planted(ident: str = "doc_id", text: str = "text") -> Column:
    """The text, for one in ten ids with its words from a place on replaced by a stretch of them again and again (the words then have one blank between them)."""
    words = F.expr(rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    seed = F.crc32(F.col(ident).cast("string").cast("binary"))
    chosen = (F.pmod(seed, F.lit(10)) == 0) & (F.size(words) > 0)
    bare = F.struct(words.alias("w"), F.floor(seed / 10).cast("long").alias("g"))
    again = F.transform(F.array(bare), lambda x: F.struct(x.w.alias("w"), F.pmod(x.g, F.size(x.w)).alias("a"), x.g.alias("g")))
    sized = F.transform(again, lambda x: F.struct(x.w.alias("w"), x.a.alias("a"), (1 + F.floor((F.size(x.w) - x.a) / (3 + F.pmod(x.g, F.lit(8))))).cast("long").alias("p")))
    made = F.transform(sized, lambda x: F.concat_ws(" ", F.transform(x.w, lambda w, i: F.when(i < x.a, w).otherwise(F.get(x.w, (x.a + F.pmod(i - x.a, x.p)).cast("int"))))))
    return F.when(chosen, F.get(made, 0)).otherwise(F.col(text))
