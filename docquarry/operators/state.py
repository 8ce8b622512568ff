"""Runs, versions and jobs: latest rows, idempotent runs, guarded transitions, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages in order, and states.
STAGES = ("upload", "parse", "clean", "quality", "chunk", "gate", "embed", "index")
ACTIVE = ("pending", "running")
STALE_SECONDS, GRAPH_STALE_SECONDS = 300, 900


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970, of timestamps with a zone or (taken as the session's) without."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def run_key(*parts: Column) -> Column:
    """What makes a run the same as another: input hash, implementation, versions, configuration."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def pending_runs(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Runs that no finished run has made already."""
    return wanted.join(done.filter("status = 'succeeded'").select(key).distinct(), key, "left_anti")


def next_stage(stage: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in zip(STAGES, STAGES[1:], strict=False):
        out = F.when(stage == a, b).otherwise(out)
    return out


def apply_decision(decision: Column) -> tuple[Column, Column]:
    """A quality decision as the states of job and version."""
    job = F.when(decision.isin("passed", "warning"), "running").when(decision == "quarantined", "waiting_review").otherwise("failed")
    version = F.when(decision.isin("passed", "warning"), "processing").when(decision == "quarantined", "quarantined").otherwise("rejected")
    return job, version


def review(assessments: DataFrame, actions: DataFrame) -> DataFrame:
    """Quarantined assessments with their first review action: released, rejected or evaluated again; a second action on the same one is refused (`refused`)."""
    first = actions.withColumn("__n", F.row_number().over(Window.partitionBy("assessment_id").orderBy("at", "action_id")))
    counts = first.groupBy("assessment_id").agg(F.max(F.when(F.col("__n") == 1, F.col("action"))).alias("action"), F.count_if(F.col("__n") > 1).alias("refused"))
    state = F.when(F.col("decision") != "quarantined", F.col("decision")).when(F.col("action") == "release", "released").when(F.col("action") == "reject", "rejected").when(F.col("action") == "re_evaluate", "pending").otherwise(F.col("decision"))
    return assessments.join(counts, "assessment_id", "left").withColumn("state", state).fillna(0, ["refused"])


def retryable(jobs: DataFrame, key: str) -> DataFrame:
    """Failed jobs of documents that have no active one."""
    busy = jobs.filter(F.col("status").isin(*ACTIVE)).select(key).distinct()
    return jobs.filter("status = 'failed'").join(busy, key, "left_anti")


def stale(jobs: DataFrame, now: Column, status: str = "status", updated: str = "updated_at", seconds: int = STALE_SECONDS) -> DataFrame:
    """Active jobs that haven't been updated for so long."""
    return jobs.filter(F.col(status).isin(*ACTIVE) & (micros(updated) <= micros(now) - seconds * 1_000_000))


def backoff(attempt: Column, base: float, most: float, jitter: Column) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt) * (0.5 + jitter))


def sliding(rows: DataFrame, key: list[str], ts: str, amount: str, seconds: int = 60) -> DataFrame:
    """calls and total within the seconds up to each row, its own moment included."""
    w = Window.partitionBy(*key).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("calls", F.count("*").over(w)).withColumn("total", F.sum(amount).over(w))


def sessions(rows: DataFrame, key: list[str], ts: str, order: str, gap: int = STALE_SECONDS) -> DataFrame:
    """session: rows of a key are in one session while the gap to the next is at most so many seconds."""
    w = Window.partitionBy(*key).orderBy(ts, order)
    fresh = F.coalesce(micros(ts) - micros(F.lag(ts).over(w)) > gap * 1_000_000, F.lit(True))
    return rows.withColumn("__fresh", fresh.cast("long")).withColumn("session", F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def check_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def soft_delete(documents: DataFrame, confirmations: DataFrame) -> DataFrame:
    """What may be purged: deleted before, and confirmed by the document's own name."""
    return documents.filter("deleted").join(confirmations, "document_id").filter(F.col("confirmation") == F.col("display_name"))
