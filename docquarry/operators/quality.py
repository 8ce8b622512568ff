"""Quality of documents: metrics over their blocks, eight dimension scores, issues, and the admission policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T

#: Thresholds of the rules and of the policy.
CORRUPT_REJECT, CORRUPT_HOLD = 0.30, 0.05
DUPLICATE_HIGH, LOCATOR_HIGH, EMPTY_PAGES_HIGH, OCR_LOW, OCR_HIGH = 0.5, 0.30, 0.5, 0.5, 0.5
DENSITY_HOLD, DENSITY_WARN = 0.20, 0.40
SPARSE_BYTES, SPARSE_PER_MIB = 1 << 20, 100
REJECT_PARSE, REJECT_TEXT, HOLD_ANY, WARN_ANY = 0.05, 0.20, 0.5, 0.8
DIMENSIONS = ("parse", "text", "density", "duplication", "structure", "traceability", "context", "readiness")


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def metrics(blocks: DataFrame, document: list[str], order: str, text: str, page: str | None = None) -> DataFrame:
    """A row for each document: counts over its blocks, and the ratios that the rules need."""
    own = F.coalesce(F.col(text), F.lit(""))
    first = Window.partitionBy(*document, "__key").orderBy(order)
    keyed = blocks.withColumn("__key", T.dedupe_key(own))
    keyed = keyed.withColumn("__again", (F.col("__key") != "") & (F.row_number().over(first) > 1))
    counts = [
        F.count("*").alias("blocks"),
        F.count_if(F.col("__key") != "").alias("valid_blocks"),
        F.count_if("__again").alias("duplicate_blocks"),
        F.sum(F.length(own)).alias("chars"),
        F.sum(F.regexp_count(own, F.lit(r"\S"))).cast("long").alias("solid"),
        F.sum(F.regexp_count(own, F.lit(T.CORRUPT))).cast("long").alias("corrupt"),
        F.sum(F.regexp_count(own, F.lit(T.WORD))).cast("long").alias("worded"),
    ]
    if page:
        counts += [F.count_distinct(page).alias("pages"), F.count_distinct(F.when(F.col("__key") != "", F.col(page))).alias("full_pages")]
    out = keyed.groupBy(*document).agg(*counts)
    return out.withColumns(
        {
            "parse_ratio": ratio(F.col("valid_blocks"), F.col("blocks")),
            "corrupt_ratio": ratio(F.col("corrupt"), F.col("solid")),
            "duplicate_ratio": ratio(F.col("duplicate_blocks"), F.col("valid_blocks")),
            "density": ratio(F.col("worded"), F.col("solid")),
        }
    )


def heading_jumps(blocks: DataFrame, document: list[str], order: str, level: str) -> DataFrame:
    """headings and jumps (a level more than one below the heading before) of each document."""
    heads = blocks.filter(F.col(level).isNotNull())
    before = F.lag(level).over(Window.partitionBy(*document).orderBy(order))
    return heads.withColumn("__before", before).groupBy(*document).agg(F.count("*").alias("headings"), F.count_if(F.col(level) > F.col("__before") + 1).alias("jumps"))


def sparse(chars: Column, blocks: Column, size: Column) -> Column:
    """Whether a large file gave hardly any text; the blocks' text is joined by line breaks."""
    return (size >= SPARSE_BYTES) & ((chars + F.greatest(blocks - 1, F.lit(0))) / (size / SPARSE_BYTES) < SPARSE_PER_MIB)


def dimensions(m: DataFrame, structure: Column | None = None, traceability: Column | None = None, context: Column | None = None) -> DataFrame:
    """The scores of a document's metrics, each 0 to 1. What isn't known counts as 1; readiness is at most the mean of the others."""
    one = F.lit(1.0)
    scored = m.withColumns(
        {
            "parse": clamp(F.col("parse_ratio")),
            "text": clamp(1 - F.col("corrupt_ratio") / CORRUPT_HOLD),
            "density_score": clamp(F.col("density") / DENSITY_WARN),
            "duplication": clamp(1 - F.col("duplicate_ratio")),
            "structure": one if structure is None else structure,
            "traceability": one if traceability is None else traceability,
            "context": one if context is None else context,
        }
    )
    seven = ["parse", "text", "density_score", "duplication", "structure", "traceability", "context"]
    mean = sum((F.col(c) for c in seven[1:]), F.col(seven[0])) / 7
    scored = scored.withColumn("readiness", F.least(mean, F.when(F.col("valid_blocks") > 0, 1.0).otherwise(0.0)))
    return scored.withColumn("overall", sum((F.col(c) for c in [*seven[1:], "readiness"]), F.col(seven[0])) / 8)


def severity_flags() -> dict[str, Column]:
    """What the rules find, by severity."""
    return {
        "critical": (F.col("valid_blocks") == 0) | (F.col("corrupt_ratio") >= CORRUPT_REJECT),
        "high": (F.col("corrupt_ratio").between(CORRUPT_HOLD, CORRUPT_REJECT) & (F.col("corrupt_ratio") < CORRUPT_REJECT)) | (F.col("duplicate_ratio") >= DUPLICATE_HIGH) | (F.col("density") < DENSITY_HOLD),
        "warning": (F.col("corrupt") > 0) | (F.col("duplicate_blocks") > 0) | (F.col("density") < DENSITY_WARN),
    }


def decide(scored: DataFrame) -> DataFrame:
    """decision: rejected, quarantined, warning or passed, by the first rule that holds."""
    eight = [F.col(c) for c in ("parse", "text", "density_score", "duplication", "structure", "traceability", "context", "readiness")]
    worst = F.least(*eight)
    flags = severity_flags()
    out = scored.withColumns(flags)
    return out.withColumn(
        "decision",
        F.when(F.col("critical") | (F.col("parse") < REJECT_PARSE) | (F.col("text") < REJECT_TEXT), "rejected")
        .when(F.col("high") | (worst < HOLD_ANY), "quarantined")
        .when(F.col("warning") | (worst < WARN_ANY), "warning")
        .otherwise("passed"),
    )


def issues(scored: DataFrame, document: list[str]) -> DataFrame:
    """A row for each issue of a document: code, severity, value."""
    found = F.array(
        F.when(F.col("valid_blocks") == 0, F.struct(F.lit("NO_VALID_TEXT").alias("code"), F.lit("critical").alias("severity"), F.lit(0.0).alias("value"))),
        F.when(F.col("corrupt") > 0, F.struct(F.lit("TEXT_CORRUPTION").alias("code"), F.when(F.col("corrupt_ratio") >= CORRUPT_REJECT, "critical").when(F.col("corrupt_ratio") >= CORRUPT_HOLD, "high").otherwise("warning").alias("severity"), F.col("corrupt_ratio").alias("value"))),
        F.when(F.col("duplicate_blocks") > 0, F.struct(F.lit("DUPLICATE_BLOCKS").alias("code"), F.when(F.col("duplicate_ratio") >= DUPLICATE_HIGH, "high").otherwise("warning").alias("severity"), F.col("duplicate_ratio").alias("value"))),
        F.when(F.col("density") < DENSITY_WARN, F.struct(F.lit("LOW_INFORMATION_DENSITY").alias("code"), F.when(F.col("density") < DENSITY_HOLD, "high").otherwise("warning").alias("severity"), F.col("density").alias("value"))),
    )
    return scored.select(*document, F.explode(F.array_compact(found)).alias("issue")).select(*document, "issue.*")


def long_form(scored: DataFrame, document: list[str]) -> DataFrame:
    """A row for each document and dimension."""
    names = ["parse", "text", "density_score", "duplication", "structure", "traceability", "context", "readiness"]
    return scored.unpivot(document, names, "dimension", "score")


def page_scores(blocks: DataFrame, document: list[str], page: str, text: str) -> DataFrame:
    """pages, empty_pages and whether too many are empty (half of them or more)."""
    full = F.max(F.when(T.collapse(F.coalesce(F.col(text), F.lit(""))) != "", 1).otherwise(0))
    pages = blocks.groupBy(*document, page).agg(full.alias("__full"))
    out = pages.groupBy(*document).agg(F.count("*").alias("pages"), F.count_if(F.col("__full") == 0).alias("empty_pages"))
    return out.withColumn("empty_high", F.col("empty_pages") / F.col("pages") >= EMPTY_PAGES_HIGH)


def ocr_scores(blocks: DataFrame, document: list[str], confidence: str) -> DataFrame:
    """measured blocks, how many are below the least confidence, and how severe that is. Blocks without a confidence don't count."""
    out = blocks.groupBy(*document).agg(F.count(confidence).alias("measured"), F.count_if(F.col(confidence) < OCR_LOW).alias("low"))
    share = F.col("low") / F.greatest(F.col("measured"), F.lit(1))
    return out.withColumn("severity", F.when((F.col("low") > 0) & (share >= OCR_HIGH), "high").when(F.col("low") > 0, "warning"))


def traceability(blocks: DataFrame, document: list[str], located: str) -> DataFrame:
    """The share of blocks with a locator as score, and how severe what is missing is."""
    out = blocks.groupBy(*document).agg(F.count("*").alias("blocks"), F.count_if(~F.col(located)).alias("missing"))
    share = F.col("missing") / F.greatest(F.col("blocks"), F.lit(1))
    return out.withColumn("score", F.round(1 - share, 6)).withColumn("severity", F.when(share >= LOCATOR_HIGH, "high").when(share > 0, "warning"))


def context_score(title: Column, contextual: Column, valid: Column) -> Column:
    """Half from the title, half from the share of blocks under a heading."""
    return F.when(valid == 0, 0.0).otherwise((F.when(title != "", 1.0).otherwise(0.5) + contextual / F.greatest(valid, F.lit(1))) / 2)


def merge_dimensions(scores: DataFrame, document: list[str]) -> DataFrame:
    """Of several evaluators' scores (dimension, score), the least of each dimension; dimensions without one count as 1. Readiness is the mean of the other seven at most."""
    names = F.array(*map(F.lit, DIMENSIONS))
    every = scores.select(*document).distinct().select("*", F.explode(names).alias("dimension"))
    least = scores.groupBy(*document, "dimension").agg(F.min("score").alias("score"))
    merged = every.join(least, [*document, "dimension"], "left").withColumn("score", F.coalesce("score", F.lit(1.0)))
    others = F.avg(F.when(F.col("dimension") != "readiness", F.col("score"))).over(Window.partitionBy(*document))
    return merged.withColumn("score", F.when(F.col("dimension") == "readiness", F.least("score", others)).otherwise(F.col("score")))
