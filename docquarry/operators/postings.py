"""Kept postings: an index of weighted fields, written once, and an exact top k that reads the blocks it needs.

Tables of an index, in one folder:

* `blocks`: the postings of a term in a field, in blocks of texts of like impact (what BM25 gives for term frequency and
  length); `bound` is the largest impact in the block, `ahead` the number of postings in better blocks. Dealt by term.
* `terms`: of each field and term the number of texts and the largest impact; `fields`: of each field the number of texts
  and their mean length.
* `texts`: of each text the frequencies of its terms by field. Dealt by id, so what is read follows the candidates.

A search takes four steps, and none reads a text. (1) The first blocks of each term give sums that are too small, if anything; the
k-th best is a score that the k-th hit has at least. (2) A field's terms are ordered by what they can add. Those at the end
that together can't reach that score are left out: no hit has them alone. (3) Of the other terms, blocks are
left out whose bound and all other terms together can't reach it. (4) What is in a block that is left is a
candidate, if what was added up and what was left out can reach the score; its exact score is taken from `texts`.
A hit's score is that of its best field, times the field's boost, as a search engine's `best_fields` has it.

Nothing is collected: bounds, blocks and candidates are joined by key, and a frequent term's postings are many blocks.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docquarry.functions import text as T
from docquarry.operators.search import B, EXACT, K1, top_hits
from docquarry.sources.scratch import checkpointed

#: Postings of a block; levels of impact that blocks are made within; parts that a term's postings of a level are collected in.
BLOCK, LEVELS, SALTS = 256, 32, 8
#: Parts of the tables, each a folder of its own, which a search reads or leaves.
PARTS = 16
#: Sums of equal parts differ by the order of adding.
SLACK = 1e-7

Analyzer = Callable[[Column], Column]
#: Letters with marks, and what they fold to.
MARKED, UNMARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def standard(text: Column) -> Column:
    """Lower-case words, CJK characters one by one."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{T.CJK}|[\p{{L}}\p{{N}}_&&[^\x{{3400}}-\x{{9fff}}]]+"), F.lit(0))


def folding(text: Column) -> Column:
    """`standard` without marks on Latin letters. Letters become letters, so the words are those of `standard`."""
    return F.transform(standard(text), lambda w: F.when(F.octet_length(w) == F.length(w), w).otherwise(F.translate(w, MARKED, UNMARKED)))


def bigrams(text: Column) -> Column:
    """Lower-case words; a run of CJK characters as its pairs of neighbours."""
    runs = T.terms(text)
    pairs = F.transform(runs, lambda w: F.when((F.length(w) > 1) & F.rlike(w, F.lit(rf"^{T.CJK}+$")), F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w)))
    return F.when(F.rlike(text, F.lit(T.CJK)), F.flatten(pairs)).otherwise(runs)


@dataclass(frozen=True)
class Field:
    """A field of an index: the column it is made of, how it is told apart, and what its score counts."""

    name: str
    source: str
    analyze: Analyzer
    boost: float


#: The fields of a search for chunks, and of one for documents.
CHUNK_FIELDS = (
    Field("heading_path", "heading_path", folding, 3.0), Field("content", "content", folding, 2.0), Field("retrieval_keywords", "retrieval_keywords", folding, 4.0),
    Field("heading_path.icu", "heading_path", bigrams, 3.0), Field("content.icu", "content", bigrams, 1.0), Field("retrieval_keywords.icu", "retrieval_keywords", bigrams, 4.0),
    Field("heading_path.standard", "heading_path", standard, 2.0), Field("content.standard", "content", standard, 1.0), Field("retrieval_keywords.standard", "retrieval_keywords", standard, 3.0),
)
DOCUMENT_FIELDS = (
    Field("title", "title", folding, 4.0), Field("original_filename", "original_filename", folding, 2.0), Field("title.icu", "title", bigrams, 4.0), Field("original_filename.icu", "original_filename", bigrams, 2.0),
    Field("title.standard", "title", standard, 3.0), Field("original_filename.standard", "original_filename", standard, 1.0),
)


def impact(tf: Column | str, dl: Column | str, average: Column | str) -> Column:
    """What BM25 gives for a term's frequency in a text of a length: less than K1 + 1."""
    tf, dl, average = (T.column(c) for c in (tf, dl, average))
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def rarity(n: Column | str, df: Column | str) -> Column:
    n, df = T.column(n), T.column(df)
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


@dataclass(frozen=True)
class Index:
    """A written index and its fields. `ident` is the name of its key; `kept` the columns that searches may filter by. Without `schemas`, those of the files hold (an empty index has none)."""

    spark: SparkSession
    path: str
    fields: tuple[Field, ...]
    ident: str
    kept: tuple[str, ...] = ()
    schemas: dict[str, StructType] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(self.schemas[name]) if name in self.schemas else self.spark.read
        return reader.parquet(os.path.join(self.path, name))

    def put(self, name: str, rows: DataFrame, *part: str) -> DataFrame:
        """Write a table of the index, a folder for each value of `part`, and read it."""
        rows.write.partitionBy(*part).parquet(os.path.join(self.path, name))
        self.schemas[name] = StructType([f for f in rows.schema if f.name not in part] + [rows.schema[c] for c in part])
        return self.table(name)

    def search(self, queries: DataFrame, query: str, text: str, k: int = 10, where: Column | None = None, digits: int = 4) -> DataFrame:
        return search(self, queries, query, text, k, where, digits)


def build(docs: DataFrame, ident: str, fields: tuple[Field, ...], path: str, kept: tuple[str, ...] = ()) -> Index:
    """Write the index of `docs` (one row an id) into an empty folder. An array is told apart item by item."""
    index, own = Index(docs.sparkSession, path, fields, ident, kept), []
    for f in fields:
        value = F.array_join(f.source, "\n") if docs.schema[f.source].dataType.typeName() == "array" else F.col(f.source)
        own.append(F.struct(F.lit(f.name).alias("field"), f.analyze(value).alias("words")))
    told = docs.select(ident, *kept, F.array(*own).alias("__fields"))
    counted = told.select(ident, *kept, F.inline("__fields")).select(ident, *kept, "field", F.size("words").alias("dl"), F.explode("words").alias("term"))
    frequencies = counted.groupBy(ident, *kept, "field", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
    texts = frequencies.groupBy(ident, *kept, "field", "dl").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tf")).groupBy(ident, *kept)
    texts = texts.agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("dl", "tf")))).alias("fields"))
    written = index.put("texts", texts.withColumn("part", F.pmod(F.xxhash64(ident), F.lit(PARTS)).cast("int")), "part")
    total = docs.agg(F.count("*").alias("n"))  # texts without any word count as well
    lengths = written.select(F.explode("fields").alias("field", "x")).groupBy("field").agg(F.sum("x.dl").alias("words")).crossJoin(total)  # two tables of a few rows
    known = index.put("fields", lengths.select("field", "n", (F.col("words") / F.col("n")).alias("average")).coalesce(1))

    entry = written.select(ident, *kept, F.explode("fields").alias("field", "x")).select(ident, *kept, "field", "x.dl", F.explode("x.tf").alias("term", "tf"))
    rated = entry.join(F.broadcast(known), "field").withColumn("impact", impact("tf", "dl", "average"))  # a row a field
    level = F.floor(F.col("impact") * LEVELS / (K1 + 1)).cast("int")
    salt = F.pmod(F.xxhash64(ident, "term"), F.lit(SALTS)).cast("int")
    held = F.struct((-F.col("impact")).alias("__order"), ident, *kept, "tf", "dl")
    series = rated.groupBy("field", "term", level.alias("level"), salt.alias("salt")).agg(F.array_sort(F.collect_list(held)).alias("all"))
    firsts = F.sequence(F.lit(1), F.size("all"), F.lit(BLOCK))
    blocks = series.select("field", "term", "level", "salt", F.posexplode(F.transform(firsts, lambda a: F.slice("all", a, F.lit(BLOCK)))).alias("nth", "held"))
    blocks = blocks.select("field", "term", F.xxhash64("level", "salt", "nth").alias("block"), (-F.col("held")[0]["__order"]).alias("bound"), F.size("held").alias("size"), F.transform("held", lambda h: h.dropFields("__order")).alias("held"))
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int").alias("part")
    laid = index.put("blocks", blocks.select("*", part).repartition("part", "term", F.pmod("block", F.lit(SALTS))).sortWithinPartitions("part", "field", "term"), "part")

    narrow = laid.select("part", "field", "term", "block", "bound", "size")
    better = Window.partitionBy("part", "field", "term").orderBy(F.desc("bound"), "block")
    ahead = F.coalesce(F.sum("size").over(better.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index.put("bounds", narrow.withColumn("ahead", ahead), "part")
    index.put("terms", narrow.groupBy("part", "field", "term").agg(F.sum("size").alias("df"), F.max("bound").alias("most")), "part")
    return index


def asked_terms(index: Index, queries: DataFrame, query: str, text: str) -> DataFrame:
    """query, field, term, weight (rarity times boost), most (what the term can add), part: the queries' terms that the index has."""
    told = queries.select(query, F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(f.boost).alias("boost"), F.array_distinct(f.analyze(F.col(text))).alias("words")) for f in index.fields]).alias("x"))
    wanted = told.select(query, F.inline("x")).select(query, "field", "boost", F.explode("words").alias("term"))
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int"))
    found = wanted.join(index.table("terms"), ["part", "field", "term"]).join(F.broadcast(index.table("fields")), "field")
    weight = rarity("n", "df") * F.col("boost")
    return found.select("part", query, "field", "term", "average", weight.alias("weight"), (weight * F.col("most")).alias("most"))


def added(blocks: DataFrame, index: Index, query: str, where: Column | None) -> DataFrame:
    """query, field, id, partial: what the postings of these blocks add up to."""
    each = blocks.select(query, "field", "weight", "average", F.inline("held"))
    each = each if where is None else each.filter(where)
    return each.groupBy(query, "field", index.ident).agg(F.sum(F.col("weight") * impact("tf", "dl", "average")).alias("partial"))


@dataclass(frozen=True)
class Needed:
    """What a search reads: the queries' terms, all their blocks, the blocks that are needed, what the terms left out can add, and the score that the k-th hit has at least."""

    asked: DataFrame
    bounds: DataFrame
    blocks: DataFrame
    rest: DataFrame
    floor: DataFrame


def needed_blocks(index: Index, queries: DataFrame, query: str, text: str, k: int, where: Column | None = None) -> Needed:
    ident, keys = index.ident, ["part", "field", "term"]
    asked = checkpointed(asked_terms(index, queries, query, text))
    bounds = checkpointed(asked.join(index.table("bounds"), keys))

    # (1) the k-th best of sums over the first blocks
    first = bounds.filter(F.col("ahead") < 2 * k)
    some = added(first.join(index.table("blocks").select(*keys, "block", "held"), [*keys, "block"]), index, query, where)
    place = Window.partitionBy(query).orderBy(F.desc("partial"), ident)
    best = some.groupBy(query, ident).agg(F.max("partial").alias("partial")).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k)
    floor = checkpointed(best.groupBy(query).agg(F.when(F.count("*") == k, F.min("partial")).alias("least")))

    # (2) and (3) the terms and blocks that a hit may be found by
    every = Window.partitionBy(query, "field")
    tail = F.sum("most").over(every.orderBy(F.desc("most"), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ordered = asked.withColumn("tail", tail).withColumn("all", F.sum("most").over(every)).join(floor, query, "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
    found_by = ordered.filter(F.col("tail") >= F.col("least"))
    reach = F.col("weight") * F.col("bound") + F.col("all") - F.col("most")
    blocks = bounds.select(query, *keys, "block", "bound").join(found_by, [query, *keys]).filter(reach >= F.col("least"))
    rest = ordered.filter(F.col("tail") < F.col("least")).groupBy(query, "field").agg(F.sum("most").alias("rest"))
    return Needed(asked, bounds, blocks, rest, floor)


def search(index: Index, queries: DataFrame, query: str, text: str, k: int = 10, where: Column | None = None, digits: int = 4) -> DataFrame:
    """query, id, score, rank: the best k texts of each query by their best field, of those for which `where` (of the kept columns) holds. Exact; see the module."""
    ident, keys = index.ident, ["part", "field", "term"]
    need = needed_blocks(index, queries, query, text, k, where)
    found = added(need.blocks.join(index.table("blocks").select(*keys, "block", "held"), [*keys, "block"]), index, query, where)
    able = found.join(need.rest, [query, "field"], "left").join(need.floor, query, "left")
    able = able.filter(F.col("partial") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce("least", F.lit(0.0)) - SLACK)
    chosen = able.select(query, ident).distinct().withColumn("part", F.pmod(F.xxhash64(ident), F.lit(PARTS)).cast("int"))
    scored = chosen.join(index.table("texts").select("part", ident, "fields"), ["part", ident])
    words = need.asked.groupBy(query, "field", "average").agg(F.collect_list(F.struct("term", "weight")).alias("words"))  # of one query's terms
    lists = words.groupBy(query).agg(F.collect_list(F.struct("field", "average", "words")).alias("asked"))
    return top_hits(scored.join(lists, query).select(query, ident, F.round(exact("asked", "fields"), EXACT).alias("score")), query, ident, k, digits=digits)


def exact(asked: str, fields: str) -> Column:
    """The score of a text's best field, from its own frequencies."""

    def one(f: Column) -> Column:
        own = F.try_element_at(F.col(fields), f["field"])

        def part(total: Column, w: Column) -> Column:
            tf = F.try_element_at(own["tf"], w["term"])
            return total + F.when(tf.isNotNull(), w["weight"] * impact(tf, own["dl"], f["average"])).otherwise(0.0)

        return F.aggregate(f["words"], F.lit(0.0), part)

    return F.array_max(F.transform(F.col(asked), one))


def scanned(docs: DataFrame, ident: str, fields: tuple[Field, ...], queries: DataFrame, query: str, text: str, k: int = 10, digits: int = 4) -> DataFrame:
    """The same hits from a scan of all texts, without an index."""
    sides = []
    for f in fields:
        value = F.array_join(f.source, "\n") if docs.schema[f.source].dataType.typeName() == "array" else F.col(f.source)
        words = docs.select(ident, f.analyze(value).alias("w"))
        stats = words.agg(F.count("*").alias("n"), (F.sum(F.size("w")) / F.count("*")).alias("average"))
        tf = words.select(ident, F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy(ident, "dl", "term").agg(F.count("*").alias("tf"))
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        asked = queries.select(query, F.explode(F.array_distinct(f.analyze(F.col(text)))).alias("term"))
        part = rarity("n", "df") * f.boost * impact("tf", "dl", "average")
        sides.append(tf.join(asked, "term").join(df, "term").crossJoin(F.broadcast(stats)).groupBy(query, ident).agg(F.sum(part).alias("score")))  # stats: one row
    every = reduce(DataFrame.unionByName, sides).groupBy(query, ident).agg(F.round(F.max("score"), EXACT).alias("score"))
    return top_hits(every, query, ident, k, digits=digits)
