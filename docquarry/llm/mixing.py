"""Mixing sources to target weights, with DataFrame functions only.

Each source's words, document after document, form a stream that is packed into blocks of fixed length. The mix has a
number of slots that its output shards share; every shard draws how many of its slots each source gets (a multinomial
draw, slot by slot). Shards are drawn in rounds, each over three quarters of the slots that are left: a round's chances are what
the sources still lack of their targets, so the rounds before it are made good and the totals differ from the targets
by the sampling error of the last round alone. The draws decide how many slots a source has. A source's slots are
mapped to its blocks through a pseudorandom permutation of the block indices, and blocks are joined by index: slot q
takes block perm(q mod N). A source that has drawn two slots for each block gets no more, so no block is taken more
than twice (the slots cut in this way stay empty).

Defined cases: a null text has size 0; a null source is a source of its own and sorts last; rows repeated in the input
are separate documents; a document of size 0 has taken 0; an empty table gives an empty result. Only doc_id, text and
source are read, so other columns may have any names (names that begin with __dq_ are this module's own).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import SPACE_CLASS, materialize, named_rows

#: Primes above any number of blocks, so a * x mod N is a permutation for every N below them.
PRIMES = (2305843009213693951, 2305843009213693921, 2305843009213693907, 2305843009213693723)
WORD = f"[^{SPACE_CLASS}]+"
#: Digits of block indices in products: with indices below 2**42 (4e12 blocks a source), products stay below 2**63.
HALF = 1 << 21


@dataclass(frozen=True)
class MixConfig:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    #: Words of a block.
    block_words: int = 16
    #: Slots of an output shard, and rounds of draws.
    shard_slots: int = 1 << 20
    rounds: int = 5
    #: Cells of the table that a slot's draw finds its source in.
    cells: int = 4096
    #: Slots that a task makes.
    task_slots: int = 500_000
    #: Documents of a source are dealt into buckets of about so many, and buckets into groups, for the running sums.
    bucket_docs: int = 1000
    group_buckets: int = 1000
    seed: str = "mix"


def hashed(*parts: Column | str) -> Column:
    """60 pseudorandom bits of the parts, the same in every engine that has md5."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, source, size: words of each text; and what else is to be kept."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *keep)


def source_plan(sizes: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """One row per source: its size, target, block length, number of blocks and slots (in proportion to the target). The windows without a key see one row per source."""
    everything = Window.partitionBy()
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    weight = F.element_at(F.array(*map(F.lit, config.weights)), (F.pmod(F.col("rank"), F.lit(len(config.weights))) + 1).cast("int"))
    plan = stats.withColumn("rank", F.row_number().over(by_rank) - 1).withColumn("weight", weight.cast("long"))
    plan = plan.withColumn("ceiling", F.col("source_size") * config.cap).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    plan = (
        plan.withColumn("at", F.row_number().over(by_ratio))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(config.share))
        .withColumn("full", F.sum("ceiling").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("full", F.lit(0))) / F.col("open"))
        .withColumn("first", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(everything))
        .withColumn("target", F.when(F.col("at") < F.col("first.at"), F.col("ceiling").cast("double")).otherwise(F.col("weight") * F.col("first.level")))
        .withColumn("block", F.lit(config.block_words).cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
        .withColumn("slots", F.when(F.col("source_size") > 0, F.least(F.col("blocks") * config.cap, F.floor(F.col("blocks") * F.col("target") / F.col("source_size") + 0.5))).otherwise(0).cast("long"))
        .withColumn("buckets", F.ceil(F.col("source_docs") / config.bucket_docs).cast("long"))
    )
    return plan.select("source", "rank", "source_size", "target", "block", "blocks", "slots", "buckets")


def placed(sizes: DataFrame, plan: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Each document's place in its source's stream of words: `start`. Running sums go bucket by bucket and group by group, so no task sees a whole source."""
    keep = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    dealt = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).select(sizes["*"], *[plan[c] for c in plan.columns if c != "source"])
    dealt = dealt.withColumn("bucket", F.pmod(hashed(F.col("doc_id"), F.col("size")), F.col("buckets")))
    inside = Window.partitionBy("rank", "bucket").orderBy("doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.unboundedPreceding, -1
    held = materialize(dealt.groupBy("rank", "bucket").agg(F.sum("size").alias("held")).withColumn("set", F.floor(F.col("bucket") / config.group_buckets)))
    sets = held.groupBy("rank", "set").agg(F.sum("held").alias("of_set")).select("rank", "set", F.coalesce(F.sum("of_set").over(Window.partitionBy("rank").orderBy("set").rowsBetween(*up)), F.lit(0)).alias("base"))
    before = held.withColumn("own", F.coalesce(F.sum("held").over(Window.partitionBy("rank", "set").orderBy("bucket").rowsBetween(*up)), F.lit(0)))
    before = before.join(sets, ["rank", "set"]).select("rank", "bucket", (F.col("base") + F.col("own")).alias("before"))
    runs = dealt.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return runs.join(before, ["rank", "bucket"]).withColumn("start", F.col("before") + F.col("run")).drop("before", "run", "bucket", "buckets")


def drawn(plan: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """How many slots of each shard go to each source, and the number of the source's first: round, shard, rank, first, taken_slots."""
    spark = plan.sparkSession
    order = Window.orderBy("rank")  # a row for each source
    total, out = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0], None
    for k in range(config.rounds):
        low, high = total - (total >> 2 * k), total if k == config.rounds - 1 else total - (total >> 2 * k + 2)
        if low == high:
            continue
        got = F.lit(0).cast("long") if out is None else F.coalesce("so_far", F.lit(0))
        state = plan if out is None else plan.join(out.groupBy("rank").agg(F.sum("taken_slots").alias("so_far")), "rank", "left")
        state = state.select("rank", "blocks", got.alias("got"), F.greatest(F.col("slots") - got, F.lit(0)).alias("lack"))
        lacks = state.withColumn("upto", F.sum("lack").over(order))
        lacking, sources = state.agg(F.sum("lack"), F.count("*")).first()
        width = -(-lacking // (config.cells + 4 * sources))
        cell = (
            lacks.filter("lack > 0")
            .withColumn("from", F.col("upto") - F.col("lack"))
            .withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("upto") - 1) / width))))
            .select("rank", "from", "upto", "cell")
        )
        slots = spark.range(low, high, 1, -(-(high - low) // config.task_slots)).select(
            F.floor((F.col("id") - low) / config.shard_slots).alias("shard"), F.pmod(hashed(config.seed, F.col("id")), F.lit(lacking)).alias("at")
        )
        met = slots.withColumn("cell", F.floor(F.col("at") / width)).join(cell, "cell").filter("at >= `from` AND at < upto")
        counts = met.groupBy("shard", "rank").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        now = (
            counts.join(lacks, "rank")
            .withColumn("first", F.col("got") + before)
            .withColumn("taken_slots", F.least("n", F.col("blocks") * config.cap - F.col("first")))
            .filter("taken_slots > 0")
            .select(F.lit(k).alias("round"), "shard", "rank", "first", "taken_slots")
        )
        now = materialize(now)
        out = now if out is None else out.unionByName(now)
    return spark.createDataFrame([], "round int, shard long, rank int, first long, taken_slots long") if out is None else out


def mixed_slots(plan: DataFrame, draws: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix: round, shard, rank, slot (the source's own number) and the block that the slot takes."""
    wide = "decimal(38,0)"
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(hashed(config.seed, F.col("rank")), F.lit(len(PRIMES))) + 1).cast("int"))
    rules = plan.filter("blocks > 0").select("rank", "blocks", F.pmod(prime, F.col("blocks")).alias("factor"), F.pmod(hashed(config.seed + "+", F.col("rank")), F.col("blocks")).alias("shift"))
    rules = rules.withColumn("far", (F.col("factor").cast(wide) * F.lit(HALF).cast("decimal(8,0)") % F.col("blocks").cast(wide)).cast("long"))
    step = 4096
    parts = draws.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken_slots") - 1, F.lit(step).cast("long"))))
    parts = parts.select("round", "shard", "rank", (F.col("first") + F.col("at")).alias("first"), F.least(F.lit(step), F.col("taken_slots") - F.col("at")).alias("n"))
    total = draws.agg(F.coalesce(F.sum("taken_slots"), F.lit(0))).first()[0]
    parts = parts.repartition(max(1, -(-total // config.task_slots)), "rank", "first")
    slots = parts.join(rules, "rank").withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
    turn = F.pmod(F.col("slot"), F.col("blocks"))
    image = F.pmod(F.col("far") * F.floor(turn / HALF), F.col("blocks")) + F.pmod(F.col("factor") * F.pmod(turn, F.lit(HALF)), F.col("blocks")) + F.col("shift")
    return slots.select("round", "shard", "rank", "slot", F.pmod(image, F.col("blocks")).alias("index"))


def taken_ranges(places: DataFrame, plan: DataFrame, keys: list[str], config: MixConfig = MixConfig()) -> DataFrame:
    """Of each document, named by `keys`, the ranges of its words that a block holds and how often the mix takes them."""
    times = mixed_slots(plan, drawn(plan, config), config).groupBy("rank", "index").agg(F.count("*").alias("times"))
    spans = places.filter("size > 0").select("rank", "start", "size", "block", *keys, F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block")))).alias("index"))
    return spans.join(times, ["rank", "index"]).select(
        "rank", *keys, "times",
        (F.greatest("start", F.col("index") * F.col("block")) - F.col("start")).alias("lo"),
        (F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * F.col("block")) - F.col("start")).alias("hi"),
    )


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: what the mix takes of each document."""
    sizes = materialize(sized(docs))
    plan = materialize(source_plan(sizes, config))
    # A document without words begins where another does: it must not meet that one's row.
    places = materialize(placed(sizes, plan, config).withColumn("key", F.when(F.col("size") > 0, F.col("start"))))
    taken = taken_ranges(places, plan, ["key"], config).groupBy("rank", "key").agg(F.sum(F.col("times") * (F.col("hi") - F.col("lo"))).alias("taken"))
    out = places.join(taken, ["rank", "key"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mix_documents(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mixed documents, with the columns of `docs`: a row with the words the mix takes once or more, and another with those it takes twice.

    The words keep the white space behind them. A document of which nothing is taken has no row; n_chars follows the
    text. Among rows of one doc_id and size, the stream has those of the smaller text hash first.
    """
    keys = ["__dq_file", "__dq_row"]
    named = named_rows(docs)
    sizes = materialize(sized(named, F.xxhash64("text").alias("__dq_text"), *map(F.col, keys)))
    plan = materialize(source_plan(sizes, config))
    places = materialize(placed(sizes, plan, config))
    ranges = taken_ranges(places, plan, keys, config)
    chosen = ranges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "times"))).alias("__dq_ranges"))  # of one document
    both = named.join(chosen, keys)
    both = both.withColumn("__dq_words", F.regexp_extract_all("text", F.lit(f"{WORD}[{SPACE_CLASS}]*"), F.lit(0)))
    both = both.withColumn("__dq_pass", F.explode(F.array(*[F.lit(k) for k in range(1, config.cap + 1)])))
    both = both.withColumn("__dq_ranges", F.filter("__dq_ranges", lambda r: r["times"] >= F.col("__dq_pass"))).filter(F.size("__dq_ranges") > 0)
    text = F.array_join(F.flatten(F.transform("__dq_ranges", lambda r: F.slice("__dq_words", (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")))), "")
    both = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return both.select(*docs.columns)
