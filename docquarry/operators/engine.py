"""The quality engine: all rules of a document as rows of one issue table, scores with what the rules cap, and one decision over both.

A rule is a measure of a document, tiers of it (the first that holds is the issue, with its severity), the dimension that it
belongs to, and what it caps that dimension's score at. Measures are columns of one row a document; rules, issues
and the decision are columns and rows as well, so the engine is three aggregates over the blocks and no code a document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import blocks as B
from docquarry.operators import quality as Q

#: Kinds of blocks that hold others, the severities in order, and the dimensions with their first scores.
CONTAINERS = ("document", "section", "page", "slide", "sheet")
CRITICAL, HIGH, WARNING = "critical", "high", "warning"


@dataclass(frozen=True)
class Tier:
    """The code and severity of an issue, and when it holds."""

    code: str
    severity: str
    holds: Column


@dataclass(frozen=True)
class Rule:
    """A measure and its tiers; `cap` bounds the dimension's score where a tier of severity `caps` (or any) holds."""

    dimension: str
    value: Column
    tiers: tuple[Tier, ...]
    cap: Column | None = None
    caps: str | None = None

    def issue(self) -> Column:
        found = F.lit(None)
        for t in reversed(self.tiers):
            found = F.when(t.holds, F.struct(F.lit(t.code).alias("code"), F.lit(self.dimension).alias("dimension"), F.lit(t.severity).alias("severity"), self.value.cast("double").alias("value"))).otherwise(found)
        return found


def share(part: str, whole: str = "content") -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rising(dimension: str, value: Column, hold: float, hold_code: str, warn_code: str, cap: Column | None = None) -> Rule:
    """High from `hold` on, a warning above none."""
    return Rule(dimension, value, (Tier(hold_code, HIGH, value >= hold), Tier(warn_code, WARNING, value > 0)), cap, HIGH)


def rules() -> tuple[Rule, ...]:
    """Every rule, over the columns of `measures`."""
    per_mib = F.col("chars") / (F.col("file_size") / Q.SPARSE_BYTES)
    corrupt, density = share("corrupt", "solid"), share("worded", "solid")
    empty = F.when(F.col("pages") > 0, F.col("empty_pages") / F.col("pages")).otherwise(0.0)
    unsure = share("unsure")
    scarce = (F.col("valid") > 0) & (F.col("file_size") >= Q.SPARSE_BYTES) & (per_mib < Q.SPARSE_PER_MIB)
    return (
        Rule("structure", F.col("repeated_ids"), (Tier("DUPLICATE_BLOCK_IDS", CRITICAL, F.col("repeated_ids") > 0),), F.lit(0.0)),
        Rule("structure", F.col("roots"), (Tier("CANONICAL_ROOT_INVALID", CRITICAL, F.col("roots") != 1),), F.lit(0.0)),
        Rule("structure", share("orphans", "blocks"), (Tier("ORPHAN_BLOCKS", HIGH, F.col("orphans") > 0),), 1 - share("orphans", "blocks")),
        Rule("structure", F.col("cycles"), (Tier("BLOCK_PARENT_CYCLE", CRITICAL, F.col("cycles") > 0),), F.lit(0.0)),
        Rule("structure", F.col("jumps"), (Tier("HEADING_LEVEL_JUMP", WARNING, F.col("jumps") > 0),), Q.clamp(1 - share("jumps"))),
        Rule("parse", F.lit(0.0), (Tier("NO_VALID_TEXT", CRITICAL, F.col("valid") == 0),)),
        Rule("parse", per_mib, (Tier("SUSPICIOUSLY_SPARSE_EXTRACTION", HIGH, F.coalesce(scarce, F.lit(False))),), per_mib / Q.SPARSE_PER_MIB),
        Rule("parse", empty, (Tier("HIGH_EMPTY_PAGE_RATIO", HIGH, empty >= Q.EMPTY_PAGES_HIGH),), 1 - empty),
        Rule("text", corrupt, (Tier("UNRECOVERABLE_TEXT_CORRUPTION", CRITICAL, corrupt >= Q.CORRUPT_REJECT), Tier("HIGH_TEXT_CORRUPTION", HIGH, corrupt >= Q.CORRUPT_HOLD), Tier("TEXT_CORRUPTION_DETECTED", WARNING, corrupt > 0))),
        rising("text", unsure, Q.OCR_HIGH, "OCR_CONFIDENCE_LOW", "OCR_CONFIDENCE_WARNING", 1 - unsure),
        rising("duplication", share("again"), Q.DUPLICATE_HIGH, "HIGH_DUPLICATION", "DUPLICATION_DETECTED"),
        rising("traceability", share("unplaced"), Q.LOCATOR_HIGH, "SOURCE_TRACEABILITY_LOW", "SOURCE_LOCATOR_GAPS"),
        Rule("density", density, (Tier("INFORMATION_DENSITY_LOW", HIGH, (F.col("valid") > 0) & (density < Q.DENSITY_HOLD)), Tier("INFORMATION_DENSITY_WARNING", WARNING, (F.col("valid") > 0) & (density < Q.DENSITY_WARN)))),
    )


def base_scores() -> dict[str, Column]:
    """The scores before caps; structure begins at 1, as what isn't judged does."""
    return {
        "parse": share("valid"),
        "text": Q.clamp(1 - share("corrupt", "solid") / Q.CORRUPT_HOLD),
        "density": F.least(F.lit(1.0), share("worded", "solid") / Q.DENSITY_WARN),
        "duplication": 1 - share("again"),
        "structure": F.lit(1.0),
        "traceability": 1 - share("unplaced"),
        "context": Q.context_score(F.trim(F.coalesce("title", F.lit(""))), F.col("under"), F.col("valid")),
    }


def measures(blocks: DataFrame, documents: DataFrame, document: str) -> DataFrame:
    """What the rules need, a row a document.

    blocks: document, block_order, block_id, parent_id, kind, text, page, level (of headings), heading_path, confidence,
    located, again (a duplicate or near duplicate). documents: document, title, file_size. The root is the block of kind
    `document` without a parent.
    """
    content = ~F.col("kind").isin(*CONTAINERS)
    text = F.coalesce("text", F.lit(""))
    valid = content & (T.collapse(text) != "")
    root = (F.col("kind") == "document") & F.col("parent_id").isNull()

    def total(of: Column) -> Column:
        return F.sum(F.when(valid, of)).cast("long")

    own = blocks.groupBy(document).agg(
        F.count("*").alias("blocks"), F.count_if(content).alias("content"), F.count_if(valid).alias("valid"), (F.count("*") - F.count_distinct("block_id")).alias("repeated_ids"), F.count_if(root).alias("roots"),
        (total(F.length(text)) + F.greatest(F.count_if(valid) - 1, F.lit(0))).alias("chars"), total(F.regexp_count(text, F.lit(r"\S"))).alias("solid"), total(F.regexp_count(text, F.lit(T.CORRUPT))).alias("corrupt"), total(F.regexp_count(text, F.lit(T.WORD))).alias("worded"),
        F.count_if(content & F.coalesce("again", F.lit(False))).alias("again"), F.count_if(content & ~F.coalesce("located", F.lit(False))).alias("unplaced"), F.count_if(content & (F.col("confidence") < Q.OCR_LOW)).alias("unsure"),
        F.count_distinct("page").alias("pages"), (F.count_distinct("page") - F.count_distinct(F.when(valid, F.col("page")))).alias("empty_pages"),
        F.count_if(valid & ((F.size("heading_path") > 0) | (F.col("kind") == "heading"))).alias("under"),
    )
    leveled = blocks.withColumn("level", F.when(F.col("kind") == "heading", F.coalesce("level", F.lit(1))))
    jumps = Q.heading_jumps(leveled, [document], "block_order", "level").select(document, "jumps")
    known = blocks.select(document, F.col("block_id").alias("parent_id")).distinct()
    lost = blocks.filter(~root).join(known, [document, "parent_id"], "left_anti").groupBy(document).agg(F.count("*").alias("orphans"))
    keyed = blocks.dropDuplicates([document, "block_id"]).select(document, F.struct(document, "block_id").alias("i"), F.when(F.col("parent_id").isNotNull(), F.struct(F.col(document), F.col("parent_id").alias("block_id"))).alias("u"))
    cycles = B.cycle_nodes(keyed, "i", "u").groupBy(F.col(f"i.{document}").alias(document)).agg(F.count("*").alias("cycles"))
    joined = documents.select(document, "title", "file_size").join(own, document, "left")
    for part in (jumps, lost, cycles):
        joined = joined.join(part, document, "left")
    counts = [c for c in joined.columns if c not in (document, "title", "file_size")]
    return joined.fillna(0, counts)


def evaluate(blocks: DataFrame, documents: DataFrame, document: str) -> tuple[DataFrame, DataFrame]:
    """The issue table (document, code, dimension, severity, value), and of each document its scores, overall and decision."""
    every = rules()
    scores = {}
    for name, first in base_scores().items():
        bounds = [first]
        for r in every:
            if r.dimension == name and r.cap is not None:
                tiers = [t for t in r.tiers if r.caps in (None, t.severity)]
                fired = tiers[0].holds
                for t in tiers[1:]:
                    fired = fired | t.holds
                bounds.append(F.when(fired, r.cap).otherwise(1.0))
        scores[name] = Q.clamp(F.least(*bounds) if len(bounds) > 1 else bounds[0])
    measured = measures(blocks, documents, document)
    issues = measured.select(document, F.explode(F.array_compact(F.array(*[r.issue() for r in every]))).alias("x")).select(document, "x.*")
    scored = measured.select(document, *[c.alias(n) for n, c in scores.items()])
    mean = sum((F.col(n) for n in list(scores)[1:]), F.col(next(iter(scores)))) / len(scores)
    scored = scored.withColumn("readiness", mean)
    return issues, decided(scored.withColumn("overall", (mean * len(scores) + F.col("readiness")) / (len(scores) + 1)), issues, document)


def decided(scored: DataFrame, issues: DataFrame, document: str) -> DataFrame:
    """With the decision: by severities of the issues and by the least score, whichever is worse."""
    worst = {s: F.bool_or(F.col("severity") == s).alias(s) for s in (CRITICAL, HIGH, WARNING)}
    told = issues.groupBy(document).agg(*worst.values(), F.count("*").alias("issues"))
    joined = scored.join(told, document, "left").fillna(False, list(worst)).fillna(0, ["issues"])
    least = F.least("parse", "text", "density", "duplication", "structure", "traceability", "context", "readiness")
    decision = (
        F.when(F.col(CRITICAL) | (F.col("parse") < Q.REJECT_PARSE) | (F.col("text") < Q.REJECT_TEXT), "rejected")
        .when(F.col(HIGH) | (least < Q.HOLD_ANY), "quarantined")
        .when(F.col(WARNING) | (least < Q.WARN_ANY), "warning")
        .otherwise("passed")
    )
    return joined.withColumn("decision", decision).drop(*worst)
