"""Ordered block trees: construction from lines, sibling links, heading paths, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import uuid5_of
from docquarry.sources.scratch import checkpointed

#: Fixed value: the namespace of block ids.
BLOCK_SPACE = "17a4dce8-74e6-4c0c-b6d1-c9108dfdc505"
LEVELS = 6
block_uuid = uuid5_of(BLOCK_SPACE)


def lines_of(docs: DataFrame, *keep: str) -> DataFrame:
    """A block for each line of a text: `keep` columns, ord, line."""
    return docs.select(*keep, F.posexplode(F.split("text", "\n", -1)).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))


def block_id(version: Column | str, ref: Column | str) -> Column:
    """The stable id of a block of a document version."""
    return block_uuid(F.concat_ws(":", version, F.lit("block"), ref))


def sibling_links(blocks: DataFrame, parent: list[str], order: str, ident: str) -> DataFrame:
    """previous_id and next_id among the blocks of one parent."""
    w = Window.partitionBy(*parent).orderBy(order)
    return blocks.withColumn("previous_id", F.lag(ident).over(w)).withColumn("next_id", F.lead(ident).over(w))


def heading_paths(blocks: DataFrame, document: str, order: str, level: str, text: str) -> DataFrame:
    """heading_path: the headings that a block stands under, a heading's own text left out.

    For each level the last heading at or above it is looked up; it counts if it is of that level, that is if no higher
    heading has come since. A heading looks at what stands before it only, and at levels above its own; headings
    without text aren't entered.
    """
    before = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    entered = F.when(F.col(level).isNotNull(), F.struct(F.col(level).alias("l"), F.trim(F.col(text)).alias("t"), F.col(order).alias("at")))
    parts = []
    for k in range(1, LEVELS + 1):
        seen = F.last(F.when(F.col(level) <= k, entered), ignorenulls=True).over(before)
        own = (seen["l"] == k) & (seen["t"] != "") & (F.col(level).isNull() | (F.col(level) > k))
        parts.append(F.when(own, seen["t"]))
    return blocks.withColumn("heading_path", F.array_compact(F.array(*parts)))


def validate_tree(nodes: DataFrame, ident: str, parent: str) -> DataFrame:
    """One row: nodes, roots, duplicate ids, orphans (a parent that isn't there), and their ratio."""
    ids = nodes.select(F.col(ident).alias("__known")).distinct()
    repeated = nodes.groupBy(ident).count().filter("count > 1").agg(F.count("*").alias("duplicate_ids"))
    lost = nodes.filter(F.col(parent).isNotNull()).join(ids, F.col(parent) == F.col("__known"), "left_anti").agg(F.count("*").alias("orphans"))
    total = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col(parent).isNull()).alias("roots"))
    # three tables of one row each, put side by side by a constant key
    one = reduce(lambda a, b: a.join(b, "__one"), [t.withColumn("__one", F.lit(1)) for t in (total, repeated, lost)]).drop("__one")
    return one.withColumn("score", F.when((F.col("duplicate_ids") > 0) | (F.col("roots") != 1), 0.0).otherwise(1 - F.col("orphans") / F.greatest(F.col("nodes"), F.lit(1))))


def cycle_nodes(nodes: DataFrame, ident: str, parent: str) -> DataFrame:
    """The nodes from which following parents never reaches a root: those on a cycle, and those that lead to one.

    Pointers are doubled in each round: after k rounds a node points 2**k steps up, so the rounds are the logarithm of
    the longest path, however large the forest is. The number of rounds follows from the number of nodes.
    """
    now = nodes.select(F.col(ident).alias("id"), F.col(parent).alias("up"))
    known = now.select(F.col("id").alias("up"))
    now = now.join(known, "up", "left_semi").select("id", "up").unionByName(now.join(known, "up", "left_anti").select("id", F.lit(None).cast(now.schema["up"].dataType).alias("up")))
    rounds = max(1, nodes.count().bit_length())
    for _ in range(rounds):
        step = now.select(F.col("id").alias("__id"), F.col("up").alias("__up"))
        now = now.join(step, now["up"] == step["__id"], "left").select("id", F.when(F.col("up").isNotNull(), F.col("__up")).alias("up"))
        now = checkpointed(now.filter("up IS NOT NULL"))  # what has come to a root is done
        if now.isEmpty():
            break
    return now.filter("up IS NOT NULL").select(F.col("id").alias(ident))


def repair(blocks: DataFrame, document: str, ident: str, parent: str, order: str, root: str) -> DataFrame:
    """Blocks whose parent is gone go to the root; orders are numbered anew, and siblings linked."""
    known = blocks.select(F.col(document).alias("__d"), F.col(ident).alias("__i"))
    there = blocks.join(known, (F.col(document) == F.col("__d")) & (F.col(parent) == F.col("__i")), "left")
    mended = there.withColumn(parent, F.when(F.col(ident) == F.col(root), F.col(parent)).when(F.col("__i").isNull(), F.col(root)).otherwise(F.col(parent))).drop("__d", "__i")
    numbered = mended.withColumn("new_order", (F.row_number().over(Window.partitionBy(document).orderBy(order)) - 1).cast("long"))
    return sibling_links(numbered, [document, parent], "new_order", ident)


def with_mark(flags: Column, findings: Column, code: str, detail: Column) -> tuple[Column, Column]:
    """A block's flags and findings with one more finding: a flag is there once, a later finding replaces an earlier one."""
    kept = F.map_filter(findings, lambda k, v: k != code)
    return F.array_union(flags, F.array(F.lit(code))), F.map_concat(kept, F.create_map(F.lit(code), detail))
