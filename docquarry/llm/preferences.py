"""Preference formatting: pairs of a chosen and a rejected conversation with their common beginning as one prompt.

The longest common prefix of the two lists of turns (role and text equal) is rendered once, as the prompt; what follows
in each is rendered as a completion, with a mask of character spans that training counts: the text of assistant turns
and the end mark behind it. Both completions are emitted together, in one row.

Two sources of pairs for a table of conversations: `pairs_by_prompt` groups those that open alike (the same first user
turn, and what stands before it) and pairs each with the next one of its group by conv_id (a chain, never all pairs; of
the two, the one with more assistant text is chosen, of equal ones the first). `stale_pairs` holds each conversation,
up to its last assistant turn, against itself with that turn's text taken from the turn before it that the assistant
had, or else the user's. Groups are told apart by a digest, and the order in a very large one comes from ranges of
conv_id and their first members, so no task holds a group.

Defined cases: null roles and texts are empty ones; a null conv_id is one conversation; turns with equal numbers are
ordered by role and text, null numbers come first; a conversation alone in its group has no pair; equal conversations
give an empty completion on both sides and `differs` false; an empty table gives an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize

TURN = "struct<role: string, text: string>"


@dataclass(frozen=True)
class ChatConfig:
    head: str = "<|{role}|>\n"
    end: str = "<|end|>\n"
    trained: str = "assistant"
    #: Conversations of a group that one task orders.
    slice_size: int = 5000


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order. A conversation is the unit that this operator works on: its turns come together."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.transform(F.sort_array(F.collect_list(row)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.groupBy("conv_id").agg(ordered.alias("turns"))


def opening(turns: Column) -> Column:
    """A digest of the turns up to the first of a user, it included (of all where there is none)."""
    roles = F.transform(turns, lambda t: t["role"])
    first = F.array_position(roles, F.lit("user"))
    own = F.when(first > 0, F.slice(turns, 1, first.cast("int"))).otherwise(turns)
    return F.sha2(F.to_json(own), 256)


def pairs_by_prompt(talks: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """chosen_id, rejected_id, chosen, rejected (their turns), of `conversations`: each with the next one, by conv_id (null first), that opens alike.

    The chain is made of ids alone. They are sorted over all tasks by group and id (ranges that Spark takes from the
    ids as they are, so neither a far-off id nor a null one makes a long range), each range links its own, and the first
    of a group's range follows the last of the range before. Turns join the finished pairs.
    """
    named = materialize(talks.withColumn("group", opening(F.col("turns"))).withColumn("none", F.col("conv_id").isNull()))
    own = F.struct("none", "conv_id", "said")
    narrow = named.select("group", "none", "conv_id", assistant_chars(F.col("turns"), config).alias("said"))
    parts = max(1, -(-narrow.count() // config.slice_size))
    order = ["group", F.desc("none"), "conv_id"]
    laid = materialize(narrow.repartitionByRange(parts, *order).withColumn("slice", F.spark_partition_id()))
    inside = Window.partitionBy("group", "slice").orderBy(F.desc("none"), "conv_id")
    heads = laid.groupBy("group", "slice").agg(F.min_by(own, F.struct(~F.col("none"), "conv_id")).alias("head"))
    after = heads.select("group", "slice", F.lead("head").over(Window.partitionBy("group").orderBy("slice")).alias("after"))  # a row for each range
    linked = laid.withColumn("next", F.lead(own).over(inside)).join(after, ["group", "slice"]).withColumn("other", F.coalesce("next", "after")).filter("other IS NOT NULL")
    swap = F.col("other.said") > F.col("said")
    pairs = linked.select(F.when(swap, F.col("other")).otherwise(own).alias("a"), F.when(swap, own).otherwise(F.col("other")).alias("b"))
    pairs = pairs.select(F.col("a.none").alias("a_none"), F.col("a.conv_id").alias("chosen_id"), F.col("b.none").alias("b_none"), F.col("b.conv_id").alias("rejected_id"))

    def side(name: str, ident: str, none: str) -> DataFrame:
        return named.select(F.coalesce("conv_id", F.lit(0).cast(named.schema["conv_id"].dataType)).alias(f"__{ident}"), F.col("none").alias(none), F.col("turns").alias(name))

    out = pairs
    for name, ident, none in (("chosen", "chosen_id", "a_none"), ("rejected", "rejected_id", "b_none")):
        out = out.withColumn(f"__{ident}", F.coalesce(ident, F.lit(0).cast(named.schema["conv_id"].dataType))).join(side(name, ident, none), [f"__{ident}", none])
    return out.select("chosen_id", "rejected_id", "chosen", "rejected")


def assistant_chars(turns: Column, config: ChatConfig) -> Column:
    return F.aggregate(turns, F.lit(0), lambda n, t: n + F.when(t["role"] == config.trained, F.length(t["text"])).otherwise(0))


def stale_pairs(talks: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """The same columns: each conversation against itself with a stale last answer. Without an assistant turn there is no pair."""
    places = F.transform("turns", lambda t, i: F.when(t["role"] == config.trained, i))
    own = talks.withColumn("last", F.array_max(places)).filter("last IS NOT NULL").withColumn("chosen", F.slice("turns", F.lit(1), F.col("last") + 1))
    before = F.filter(F.slice("chosen", F.lit(1), F.col("last")), lambda t: t["role"] == config.trained)
    asked = F.filter(F.slice("chosen", F.lit(1), F.col("last")), lambda t: t["role"] == "user")
    text = F.coalesce(F.try_element_at(before, F.lit(-1))["text"], F.try_element_at(asked, F.lit(-1))["text"], F.lit(""))
    stale = F.concat(F.slice("chosen", F.lit(1), F.col("last")), F.array(F.struct(F.lit(config.trained).alias("role"), text.alias("text"))))
    return own.select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), "chosen", stale.alias("rejected"))


def shared_turns(a: Column, b: Column) -> Column:
    """The number of turns in the longest common prefix."""
    same = F.transform(F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, F.least(F.size(a), F.size(b))), lambda z: z["a"] == z["b"])
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b)))


def heading(role: Column, config: ChatConfig) -> Column:
    before, after = config.head.split("{role}")
    return F.concat(F.lit(before), role, F.lit(after))


def rendered(turns: Column, config: ChatConfig = ChatConfig()) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(heading(t["role"], config), t["text"], F.lit(config.end))), "")


def mask(turns: Column, config: ChatConfig = ChatConfig()) -> Column:
    """[start, end) spans, in characters of the rendered turns, of what is trained on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(heading(t["role"], config))
        stop = begin + F.length(t["text"]) + len(config.end)
        span = F.array(F.struct(begin.alias("start"), stop.alias("end")))
        return F.struct(stop.alias("at"), F.when(t["role"] == config.trained, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def format_preferences(pairs: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """chosen_id, rejected_id, prompt, prompt_turns, chosen and rejected completions with their masks, differs."""
    n = F.col("__dq_n")
    cut = pairs.withColumn("__dq_n", shared_turns(F.col("chosen"), F.col("rejected")))
    cut = cut.withColumn("__dq_head", F.slice("chosen", F.lit(1), n)).withColumn("__dq_a", F.slice("chosen", n + 1, F.greatest(F.size("chosen") - n, F.lit(0)))).withColumn("__dq_b", F.slice("rejected", n + 1, F.greatest(F.size("rejected") - n, F.lit(0))))
    return cut.select(
        "chosen_id", "rejected_id",
        rendered(F.col("__dq_head"), config).alias("prompt"), n.alias("prompt_turns"),
        rendered(F.col("__dq_a"), config).alias("chosen_text"), mask(F.col("__dq_a"), config).alias("chosen_mask"),
        rendered(F.col("__dq_b"), config).alias("rejected_text"), mask(F.col("__dq_b"), config).alias("rejected_mask"),
        ((F.size("__dq_a") > 0) | (F.size("__dq_b") > 0)).alias("differs"),
    )


def preferences(turns: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """Formatted pairs of both sources, told apart by `source`: prompt or stale."""
    talks = conversations(turns)
    by_prompt = format_preferences(pairs_by_prompt(talks, config), config).withColumn("source", F.lit("prompt"))
    return by_prompt.unionByName(format_preferences(stale_pairs(talks, config), config).withColumn("source", F.lit("stale")))


def digests(formatted: DataFrame) -> DataFrame:
    """Texts as SHA-256, masks as start:end joined by commas."""
    def spans(c: str) -> Column:
        return F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["start"], m["end"])), ",")

    return formatted.select(
        "source", "chosen_id", "rejected_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2("chosen_text", 256).alias("chosen_sha256"), spans("chosen_mask").alias("chosen_mask"),
        F.sha2("rejected_text", 256).alias("rejected_sha256"), spans("rejected_mask").alias("rejected_mask"), "differs",
    )
