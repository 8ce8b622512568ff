"""Finding passages of a stated set in texts: by a word that has to be there, and by counts of substrings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators.fusion import exact_match, identifiers
from docquarry.sources.scratch import checkpointed

#: Search terms that are looked for in one pass over the texts: what a task holds at once.
TERMS_AT_ONCE = 200_000
#: Characters of the runs that stand for what has no whole word.
GRAM = 3


def inner_words(passage: Column) -> Column:
    """The words of a passage that stand whole in any text that has it: not the first and the last, which may be parts of longer ones there."""
    words = T.terms(passage)
    return F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<string>"))


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a lower-case text."""
    low = F.lower(text)
    starts = F.when(F.length(low) >= n, F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(n))))


def needles(passages: DataFrame, ident: str, passage: str) -> DataFrame:
    """ident, way (which part has to be there), keys: a text matches only if, for one way, it has all keys. Keys of kind 0 are whole words, others runs of so many characters, as many as the part has up to GRAM."""
    q = F.lower(F.trim(passage))
    whole = F.struct(F.lit("whole").alias("way"), inner_words(q).alias("words"), q.alias("part"))
    parts = F.transform(identifiers(q), lambda x: F.struct(F.concat(F.lit("id "), x).alias("way"), T.terms(x).alias("words"), x.alias("part")))
    ways = passages.filter(q != "").select(ident, F.inline(F.concat(F.array(whole), parts)))
    kind = F.when(F.size("words") > 0, 0).otherwise(F.least(F.length("part"), F.lit(GRAM)))
    keys = F.array_distinct("words")
    for n in range(1, GRAM + 1):
        keys = F.when(kind == n, grams(F.col("part"), n)).otherwise(keys)
    return ways.select(ident, "way", kind.alias("kind"), keys.alias("keys"))


def exact_passages(texts: DataFrame, key: str, text: str, passages: DataFrame, ident: str, passage: str) -> DataFrame:
    """ident, key: the texts that have a passage whole, or an identifier of it that stands alone (`fusion.exact_match`).

    Of the words that have to be there, the one that is in the fewest texts names a passage's candidates, which are
    then verified. Passages without such a word (two words or fewer) are found by their rarest run of GRAM characters.
    """
    every = needles(passages, ident, passage).select(ident, "way", "kind", F.explode("keys").alias("key"))
    every = checkpointed(every)
    found = []
    for kind in range(GRAM + 1):
        told = grams(F.col(text), kind) if kind else F.array_distinct(T.terms(text))
        asked = every.filter(F.col("kind") == kind)
        if asked.isEmpty():
            continue
        wanted = asked.select("key").distinct()
        hits = checkpointed(texts.select(F.col(key).alias("__text"), F.explode(told).alias("key")).join(wanted, "key"))
        counts = hits.groupBy("key").count()
        rarest = asked.join(counts, "key", "left").withColumn("__n", F.row_number().over(Window.partitionBy(ident, "way").orderBy(F.coalesce("count", F.lit(0)), "key"))).filter("__n = 1")
        found.append(rarest.select(ident, "key").join(hits, "key").select(ident, F.col("__text").alias(key)))
    if not found:
        return passages.select(ident).limit(0).crossJoin(texts.select(key).limit(0))  # no rows on either side
    pairs = reduce(DataFrame.unionByName, found)
    own = passages.select(ident, F.col(passage).alias("__passage"))
    there = pairs.distinct().join(texts.select(key, F.col(text).alias("__text")), key).join(own, ident)
    return there.filter(exact_match("__passage", "__text")).select(ident, key)


def term_counts(texts: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, term, n: how often each of the terms is in the lower-case texts, without overlaps with itself. One automaton reads a text once, however many terms there are."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for k, term in enumerate(shared.value):
            machine.add_word(term, (k, len(term)))
        machine.make_automaton()
        for batch in batches:
            rows, which, counts = [], [], []
            for at, value in enumerate(batch.column(1).to_pylist()):
                seen: dict[int, list[int]] = {}
                for end, (k, size) in machine.iter(value) if value else ():
                    held = seen.setdefault(k, [0, -1])
                    if end - size >= held[1]:
                        held[0] += 1
                        held[1] = end
                rows += [at] * len(seen)
                which += [shared.value[k] for k in seen]
                counts += [n for n, _ in seen.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(which, pa.string()), pa.array(counts, pa.int64())], [key, "term", "n"])

    return texts.select(key, F.lower(text).alias("t")).mapInArrow(run, f"{key} {kind}, term string, n long")


def counted_terms(texts: DataFrame, key: str, text: str, passages: DataFrame, ident: str, passage: str) -> DataFrame:
    """ident, key, score: how often the terms of a passage are in a text, added up. Terms are looked for in blocks of TERMS_AT_ONCE, each term once for all passages."""
    asked = checkpointed(passages.select(ident, F.explode(F.array_distinct(T.terms(passage))).alias("term")))
    terms = asked.select("term").distinct()
    blocks = max(1, -(-terms.count() // TERMS_AT_ONCE))
    found = None
    for b in range(blocks):
        block = [r["term"] for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b).toLocalIterator()]  # one block
        part = term_counts(texts, key, text, block)
        found = part if found is None else found.unionByName(part)
    return found.join(asked, "term").groupBy(ident, key).agg(F.sum("n").alias("score"))
