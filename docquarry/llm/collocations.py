"""Phrase collocations: all n-grams as rows, counted by language, scored by their weakest cut, without parts of longer phrases.

Texts in lower case (A-Z) are split into pieces at punctuation and line ends, and pieces into words. Every phrase of 1 to
`most_words` words that can still be a candidate becomes a row (lang, phrase, n) and is counted by a hash aggregate; a task
adds up what one batch repeats before it hands its rows on. Words come first, then pairs, then all longer phrases: a phrase
that is found `least_count` times has parts that are found as often, so pairs of words and longer phrases are only exploded
where all their words, or all their pairs, passed a bitmap of the frequent ones. The bitmap misses none; what it lets
through by chance is counted exactly and then dropped, so it changes the size of the shuffle and nothing else.

Each cut of a candidate is joined with the counts of its two parts and scored in exact decimals; the lowest score counts
(ties: the smallest cut). A candidate goes if a phrase with one word more, before or behind, is found nearly as often:
any longer phrase has such a one between, at least as frequent as itself, so one step decides about all lengths.

Defined cases: a null text is an empty one; a null language is `und`; words are cut at blanks and tabs only, so what
other white space there is belongs to words; repeated rows count each time; an empty table gives no rows. Counts are exact
up to 15 digits. Only text and lang are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import bounded_batches, materialize
from docquarry.llm.phrases import MARK, Passed, bit_count, bitmap, coded, hashed, numbered, places

#: What ends a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
CLEAN = bytes.maketrans(ENDS + b"\t", bytes([MARK]) * len(ENDS) + b" ")
COUNT = "lang string, phrase string, n long"


@dataclass(frozen=True)
class PhraseConfig:
    most_words: int = 5
    least_count: int = 100
    #: A candidate goes if one extension is found at least this share of its count (in hundredths).
    part_percent: int = 100
    top: int = 2000
    #: Copies of a count that a very frequent part's candidates are dealt over.
    salts: int = 16


def pieces(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The words of many texts as numbers of the second array's entries; -1 stands between pieces and behind the last word."""
    raw = np.frombuffer(bytes([MARK]).join([*texts, b""]).lower().translate(CLEAN), np.uint8)
    return coded(raw, raw == MARK)


def exploded(codes: np.ndarray, words: pa.Array, sizes: range, lang: bytes, passed: Passed | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """For each of the sizes, the phrases of so many words and how often each is found, where all their parts of the size before the first have passed."""

    def phrases(at: np.ndarray, size: int) -> pa.Array:
        return pc.binary_join_element_wise(*[words.take(pa.array(codes[at + k])) for k in range(size)], b" ")

    base = sizes[0] - 1  # the size of the parts that the bitmap knows
    if not base:
        n = np.bincount(codes[codes >= 0], minlength=len(words))
        found = np.flatnonzero(n)
        yield words.take(pa.array(found)), n[found]
        return
    place = places(codes, base)
    place = place[passed(hashed(codes, words, place, base, lang))]
    rank = codes[place]
    for k in range(1, base):
        rank = numbered(rank * len(words) + codes[place + k])[2]
    for size in sizes:  # both the phrase without its last word and the one without its first have passed
        keep = np.flatnonzero(place[1:] == place[:-1] + 1)
        rank, place = rank[keep] * len(words) + codes[place[keep] + size - 1], place[keep]
        if not len(place):
            return
        first, n, rank = numbered(rank)
        yield phrases(place[first], size), n


def rows(docs: DataFrame, sizes: range, shared: Broadcast | None, bits: int) -> DataFrame:
    """lang, phrase, n: each batch's phrases of these sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = Passed(shared.value, bits) if shared is not None else None
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                codes, words = pieces(own)
                for found, n in exploded(codes, words, sizes, lang.encode(), passed):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), found.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, COUNT)


def counted(docs: DataFrame, sizes: range, frequent: DataFrame | None, config: PhraseConfig) -> DataFrame:
    """lang, phrase, n: how often each phrase of these sizes is found, if all its parts (see `exploded`) are frequent."""
    shared, bits = None, 0
    if frequent is not None:
        bits = bit_count(frequent)
        shared = docs.sparkSession.sparkContext.broadcast(bitmap(frequent, bits))
    return rows(docs, sizes, shared, bits).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequencies(docs: DataFrame, config: PhraseConfig = PhraseConfig()) -> tuple[DataFrame, DataFrame]:
    """lang, total: the words of each language; and lang, phrase, n, words: all phrases that are frequent enough, single words among them."""
    often = F.col("n") >= config.least_count
    words = materialize(counted(docs, range(1, 2), None, config))
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    levels = [words.filter(often)]
    for sizes in [range(2, 3), range(3, config.most_words + 1)]:
        if len(sizes) and sizes[0] <= config.most_words:
            levels.append(materialize(counted(docs, sizes, levels[-1], config).filter(often)))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return total, every.withColumn("words", F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)


def scored(total: DataFrame, every: DataFrame, config: PhraseConfig = PhraseConfig()) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of each candidate: the cut that scores lowest."""
    salts, whole = config.salts, "decimal(15,0)"
    cuts = every.filter("words > 1").withColumnRenamed("n", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int"))
    counts = every.filter(F.col("words") < config.most_words).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"), "salt")
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"), "salt")
    joined = cuts.join(left, ["lang", "first", "salt"]).join(right, ["lang", "rest", "salt"]).join(total.withColumnRenamed("total", "n"), "lang")
    score = F.expr(f"(1000BD * (CAST(a AS {whole}) * CAST(n AS {whole}))) div (CAST(l AS {whole}) * CAST(r AS {whole}))")
    best = joined.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r", "n")).alias("x"))
    return best.select("lang", "phrase", "x.words", "x.a", "x.l", "x.r", "x.n", "x.score")


def extensions(every: DataFrame) -> DataFrame:
    """lang, phrase, most: of each phrase with an extension by one word, how often its most frequent one is found."""
    long = every.filter("words > 2")
    head = long.select("lang", F.expr("substring_index(phrase, ' ', words - 1)").alias("phrase"), "n")
    tail = long.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "n")
    return head.unionByName(tail).groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, config: PhraseConfig = PhraseConfig()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    total, every = frequencies(docs, config)
    longer = extensions(every).select("lang", "phrase", "most")
    single = scored(total, every, config).join(longer, ["lang", "phrase"], "left").filter(f"most IS NULL OR 100 * most < {config.part_percent} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = single.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", *[F.col(c).cast("long") for c in ("a", "l", "r", "n", "score")])
