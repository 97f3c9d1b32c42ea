"""Working queues over jobs, their events and failure receipts. Nullable columns are compared so that a null never drops a row by itself.

jobs: id, status, scoring_status, score_error, pass_reason, fit_category, context_batched, jd_batch, batch_job, fit_batch, staged, aim_score, experience_score
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statuses of jobs that are being scored, people's events, and what a failed score says.
ACTIVE = ("pending_af", "inbox")
PEOPLE = ("user_promote", "user_reject", "user_lifecycle")
RESCORE = "user_rescore"
UNSCORABLE = ("JD recovery rejected:", "Aim Fit could not score this job:", "Experience Fit could not score this job:")
UNRECOVERABLE = ("JD recovery failed. Manual review required.", "Failed to fetch JD after 3 attempts. Needs manual review.", "Error calling Jina. Manual review required.")
PROMOTED = "Promoted by user:"


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def suppressed(receipts: DataFrame) -> DataFrame:
    """(id): jobs with a failure receipt (job_id, suppression_active, cleared_at) that still holds."""
    return receipts.where(F.col("suppression_active") & F.col("cleared_at").isNull()).select(F.col("job_id").alias("id")).distinct()


def flagged(jobs: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Adds whether the other side has a job's id."""
    return jobs.join(other.select("id").distinct().withColumn(name, F.lit(True)), "id", "left").withColumn(name, yes(F.col(name)))


def action_needed(jobs: DataFrame, receipts: DataFrame, more_reasons: Sequence[str] = ()) -> DataFrame:
    """Active jobs whose text couldn't be recovered or scored, or that a failure receipt holds back."""
    error = reduce(or_, [yes(F.col("score_error").startswith(p)) for p in UNSCORABLE])
    failed = yes(F.col("scoring_status") == "failed") & (error | yes(F.col("pass_reason").isin(*UNRECOVERABLE, *more_reasons)))
    held = flagged(jobs, suppressed(receipts), "__held")
    return held.where(F.col("status").isin(*ACTIVE) & (failed | F.col("__held"))).drop("__held")


def manual_stage(jobs: DataFrame, events: DataFrame, stage: str) -> DataFrame:
    """Pending jobs that a manual stage (`aim`, `experience`) may take: those that no person has decided on, or that one asked to score again. events: (job_id, event_type)."""
    by = lambda *types: events.where(F.col("event_type").isin(*types)).select(F.col("job_id").alias("id"))
    held = flagged(flagged(jobs.where("status = 'pending_af'"), by(*PEOPLE), "__decided"), by(RESCORE), "__again")
    fresh = ~F.col("__decided")
    if stage == "aim":
        promoted = F.lower("pass_reason").startswith(PROMOTED.lower())
        fresh = fresh & ~F.col("fit_category").eqNullSafe("promoted") & (F.col("pass_reason").isNull() | ~promoted)
    return held.where(fresh | F.col("__again")).drop("__decided", "__again")


def log_tab(name: str, jobs: DataFrame, events: DataFrame, receipts: DataFrame, leased: DataFrame) -> DataFrame:
    """The jobs of a tab. leased: (id) of jobs in a leased batch item."""
    none = lambda *cols: reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols])
    if name == "needs_jd":
        return jobs.where(F.col("status").isin(*ACTIVE) & (yes(F.col("scoring_status") == "needs_jd") | F.col("jd_batch").isNotNull()))
    if name == "context":
        return jobs.where((F.col("status") == "passed") & ~yes(F.col("context_batched")) & F.col("pass_reason").isNotNull() & ~F.contains(F.lower("pass_reason"), F.lit("expired")))
    if name == "local_scoring":
        return jobs.where(F.col("status").isin(*ACTIVE) & (F.col("scoring_status") == "queued") & none("jd_batch"))
    if name == "action_needed":
        return action_needed(jobs, receipts)
    if name == "aim_fit":
        ready = manual_stage(jobs, events, "aim").where((F.col("scoring_status") == "scored") & none("jd_batch", "batch_job", "fit_batch", "aim_score") & ~yes(F.col("staged")))
        return ready.join(suppressed(receipts), "id", "left_anti")
    if name == "experience_fit":
        ready = manual_stage(jobs, events, "experience").where((F.col("scoring_status") == "scored") & ~yes(F.col("staged")) & F.col("aim_score").isNotNull() & none("experience_score"))
        return ready.join(leased.select("id"), "id", "left_anti")
    return jobs.where("status = 'pending_af'")


def active_failures(receipts: DataFrame, jobs: DataFrame, most: int = 100) -> DataFrame:
    """The newest failures that still hold, with their jobs' title and company. receipts: id, job_id, code, failed_at, suppression_active, cleared_at."""
    held = receipts.where(F.col("suppression_active") & F.col("cleared_at").isNull()).orderBy(F.col("failed_at").desc(), F.col("id").desc()).limit(most)
    named = jobs.select(F.col("id").alias("job_id"), "title", "company")
    return held.join(named, "job_id", "left").select("id", "job_id", "title", "company", "code", "failed_at").orderBy(F.col("failed_at").desc(), F.col("id").desc())


def backlog_flow(jobs: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """One row: jobs waiting now, and how many came in, were scored and were put back within a day. events: event_type, at."""
    day = F.col("at") >= now - F.make_dt_interval(days=F.lit(1))
    flow = events.agg(*[F.count_if(day & F.col("event_type").isin(*types)).alias(name) for name, types in (("came", ("ingested",)), ("scored", ("aim_scored", "experience_scored")), ("put_back", ("score_replay_queued", RESCORE)))])
    return jobs.agg(F.count_if((F.col("status") == "pending_af") & ~yes(F.col("staged"))).alias("waiting")).crossJoin(flow)  # one row each


def readiness(spark: SparkSession, tables: Sequence[str], columns: dict[str, Sequence[str]] | None = None) -> dict[str, bool]:
    """Whether each table exists with the columns that are needed of it."""
    found = {}
    for t in tables:
        there = spark.catalog.tableExists(t)
        found[t] = there and set((columns or {}).get(t, ())) <= set(spark.table(t).columns)
    return found
