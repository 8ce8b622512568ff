"""Retrieval metrics, their means, and comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T

#: How much a metric may fall.
TOLERANCE = {"hit_at_10": 0.0, "recall_at_10": 0.02, "mrr": 0.02, "ndcg_at_10": 0.02}


def ranked_metrics(ranked: DataFrame, relevant: DataFrame, query: str, ident: str, digits: int = 6) -> DataFrame:
    """hit, recall and precision at 5 and 10, mrr, ndcg_at_10 of each query with relevant items.

    ranked: query, ident, rank (from 1; an item that comes twice counts at its best rank); relevant: query, ident.
    Precision divides by the cutoff; the ideal list has all relevant items, ten at most.
    """
    first = ranked.groupBy(query, ident).agg(F.min("rank").alias("rank"))
    unique = first.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("rank", ident)))
    wanted = relevant.select(query, ident).distinct()
    total = wanted.groupBy(query).agg(F.count("*").alias("relevant"))
    return metrics_of_hits(wanted.join(unique, [query, ident]), total, query, digits)


def metrics_of_hits(found: DataFrame, total: DataFrame, query: str, digits: int = 6) -> DataFrame:
    """The metrics from the relevant items that were found (query, rank) and the number of relevant ones (query, relevant)."""
    hits = found.groupBy(query).agg(
        F.count_if(F.col("rank") <= 5).alias("at5"), F.count_if(F.col("rank") <= 10).alias("at10"), F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = total.join(hits, query, "left").fillna(0, ["at5", "at10", "dcg"])
    return out.select(
        query,
        (F.col("at5") > 0).cast("double").alias("hit_at_5"), (F.col("at10") > 0).cast("double").alias("hit_at_10"),
        F.round(F.col("at5") / F.col("relevant"), digits).alias("recall_at_5"), F.round(F.col("at10") / F.col("relevant"), digits).alias("recall_at_10"),
        F.round(F.col("at5") / 5, digits).alias("precision_at_5"), F.round(F.col("at10") / 10, digits).alias("precision_at_10"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), digits).alias("mrr"), F.round(F.col("dcg") / ideal, digits).alias("ndcg_at_10"),
    )


def mean_metrics(metrics: DataFrame, query: str, digits: int = 6) -> DataFrame:
    """metric, value, samples: the means of what is there; nulls don't count."""
    names = sorted(c for c in metrics.columns if c != query)
    return metrics.unpivot([query], names, "metric", "value").groupBy("metric").agg(F.round(F.avg("value"), digits).alias("value"), F.count("value").alias("samples"))


def compare(current: DataFrame, baseline: DataFrame, tolerance: dict[str, float] = TOLERANCE, digits: int = 6) -> DataFrame:
    """metric, baseline, current, delta, allowed_drop, passed for metrics that both have (metric, value)."""
    allowed = F.lit(0.0)
    for name, drop in tolerance.items():
        allowed = F.when(F.col("metric") == name, drop).otherwise(allowed)
    both = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric")
    both = both.filter("current IS NOT NULL AND baseline IS NOT NULL").withColumn("delta", F.round(F.col("current") - F.col("baseline"), digits)).withColumn("allowed_drop", allowed)
    return both.withColumn("passed", F.col("delta") >= -F.col("allowed_drop"))


def set_scores(found: DataFrame, expected: DataFrame, group: list[str], key: list[str], digits: int = 6) -> DataFrame:
    """precision, recall and f1 of a set of keys against the expected one, of each group."""
    f, e = found.select(*group, *key).distinct().withColumn("f", F.lit(1)), expected.select(*group, *key).distinct().withColumn("e", F.lit(1))
    both = f.join(e, [*group, *key], "full").groupBy(*group).agg(F.count("f").alias("found"), F.count("e").alias("expected"), F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("hits"))
    p, r = F.when(F.col("found") > 0, F.col("hits") / F.col("found")).otherwise(0.0), F.when(F.col("expected") > 0, F.col("hits") / F.col("expected")).otherwise(0.0)
    return both.select(*group, F.round(p, digits).alias("precision"), F.round(r, digits).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), digits).alias("f1"))


def answer_contains(answer: Column | str, expected: Column | str) -> Column:
    """Whether the answer has the expected one in it, letters, digits and underscores alone compared: 0 for an expectation without any. Null: nothing is expected."""
    def plain(c: Column | str) -> Column:
        return F.lower(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_]+", ""))  # noqa: F541

    return F.when(plain(expected) != "", F.contains(plain(answer), plain(expected)).cast("double")).when(plain(expected) == "", 0.0)


def refusal_accuracy(answerable: Column, refused: Column) -> Column:
    return F.when(answerable.isNull() | refused.isNull(), None).when(~answerable == refused, 1.0).otherwise(0.0)


def locator_accuracy(expected: Column | str, actual: Column | str, keys: list[str]) -> Column:
    """The share of expected locators that an actual one agrees with, on all keys that the expected one has; one without any key agrees with none. Null: none is expected."""
    def agrees(e: Column, a: Column) -> Column:
        out = F.coalesce(*[e[k].cast("string") for k in keys]).isNotNull()
        for k in keys:
            out = out & (e[k].isNull() | e[k].eqNullSafe(a[k]))
        return out

    matched = F.size(F.filter(expected, lambda e: F.exists(actual, lambda a: agrees(e, a))))
    return F.when(F.size(expected) > 0, matched / F.size(expected))


def select_samples(samples: DataFrame, ids: list[str] | None, tags: list[str] | None) -> DataFrame:
    """The samples with one of the ids and one of the tags, where these are given. An id that isn't there is an error."""
    out = samples
    if ids is not None:
        lost = set(ids) - {r["id"] for r in samples.filter(F.col("id").isin(ids)).select("id").distinct().collect()}
        if lost:
            raise ValueError(f"EVALUATION_SAMPLE_NOT_FOUND: {', '.join(sorted(lost))}")
        out = out.filter(F.col("id").isin(ids))
    return out.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else out


def run_rollup(results: DataFrame) -> DataFrame:
    """samples, failures (an error, or nothing found among ten) and cost of a run's results (error, hit_at_10, cost_usd)."""
    failed = F.col("error").isNotNull() | (F.col("hit_at_10") == 0)
    return results.agg(F.count("*").alias("samples"), F.count_if(failed).alias("failures"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"))


def terms_overlap(a: Column | str, b: Column | str) -> Column:
    return T.jaccard(F.array_distinct(T.terms(a)), F.array_distinct(T.terms(b)))
