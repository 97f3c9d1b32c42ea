"""Circuits, budgets, schedules and expiry, as windows over event ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.identity import jitter_millis

#: Failures that open a circuit at once, and for how long circuits stay open.
HARD = ("keys_exhausted", "rate_limited", "credentials", "endpoint_unavailable", "response_schema", "budget_exhausted")
HARD_MINUTES, FIRST_MINUTES, MOST_MINUTES, STRIKES = 360, 15, 120, 3


def circuit_states(outcomes: DataFrame, provider: str = "provider", at: str = "at", failure: str = "failure") -> DataFrame:
    """Adds failures_in_row, state and open_until after each outcome (failure: its kind, null for a success), by provider in time.

    A success at a failure's own time doesn't undo it: at equal times failures come last.
    """
    order = Window.partitionBy(provider).orderBy(at, F.col(failure).isNotNull(), failure)
    run = outcomes.withColumn("__run", F.sum(F.when(F.col(failure).isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(provider, "__run").orderBy(at, F.col(failure).isNotNull(), failure).rowsBetween(Window.unboundedPreceding, 0)
    run = run.withColumn("failures_in_row", F.sum(F.when(F.col(failure).isNotNull(), 1).otherwise(0)).over(inside))
    n = F.col("failures_in_row")
    minutes = F.when(F.col(failure).isNull(), None).when(F.col(failure).isin(*HARD), HARD_MINUTES).when(n >= STRIKES, F.least(F.lit(MOST_MINUTES), FIRST_MINUTES * F.pow(F.lit(2), F.least(n - STRIKES, F.lit(10)))))
    run = run.withColumn("__m", minutes.cast("int")).withColumn("state", F.when(F.col("__m").isNotNull(), "open").otherwise("closed"))
    return run.withColumn("open_until", F.when(F.col("__m").isNotNull(), F.col(at) + F.make_dt_interval(mins=F.col("__m")))).drop("__run", "__m")


def budget_use(calls: DataFrame, limits: DataFrame, provider: str = "provider", at: str = "at") -> DataFrame:
    """Adds used_today, used_this_month and blocked to each call, the call itself included. limits (provider, daily, monthly; null: none)."""
    # Hours' sums are added up first, so that a window over single calls spans an hour at most.
    hour = F.date_trunc("hour", at)
    sums = calls.groupBy(F.col(provider).alias("__p"), hour.alias("__h")).agg(F.count("*").alias("__n"))
    before = lambda unit: F.coalesce(F.sum("__n").over(Window.partitionBy("__p", unit).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__p", "__h", before(F.to_date("__h")).alias("__day"), before(F.date_trunc("month", "__h")).alias("__month"))
    inside = F.count("*").over(Window.partitionBy(provider, "__hour").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    used = calls.withColumn("__hour", hour).withColumn("__in", inside)
    used = used.join(sums, F.col(provider).eqNullSafe(F.col("__p")) & (F.col("__hour") == F.col("__h"))).withColumn("used_today", F.col("__day") + F.col("__in")).withColumn("used_this_month", F.col("__month") + F.col("__in"))
    over = F.coalesce(F.col("used_today") > F.col("daily"), F.lit(False)) | F.coalesce(F.col("used_this_month") > F.col("monthly"), F.lit(False))
    return used.join(limits, provider, "left").withColumn("blocked", over).drop("__p", "__h", "__hour", "__in", "__day", "__month", "daily", "monthly")


def next_run(key: Column, status: Column, finished: Column, cadence_minutes: Column, retry_at: Column, continue_minutes: Column, retry_minutes: int = 30, jitter_minutes: int = 30) -> Column:
    """When a task runs next, counted from when it really finished."""
    plus = lambda t, m: t + F.make_dt_interval(mins=m.cast("int"))
    retry = plus(finished, F.lit(retry_minutes))
    held = F.when(retry_at > finished, retry_at).otherwise(retry)
    jitter = F.make_dt_interval(secs=(jitter_millis(key, jitter_minutes * 60_000) / 1000).cast("decimal(18,6)"))
    goes_on = continue_minutes.isNotNull() & status.isin("succeeded", "disabled", "partial")
    return F.when(goes_on, plus(finished, F.greatest(F.lit(0), continue_minutes))).when(status.isin("succeeded", "disabled"), plus(finished, F.greatest(F.lit(0), cadence_minutes))).when(status.isin("blocked_budget", "blocked_circuit"), held + jitter).otherwise(retry)


def board_backoff(fails: Column, today: Column) -> Column:
    """struct<fails, status, next_check> after one more failure: 1, 7, then 30 days; the third failure bars the board."""
    n = fails + 1
    days = F.when(n == 1, 1).when(n == 2, 7).otherwise(30)
    return F.struct(n.alias("fails"), F.when(n >= 3, "blacklisted").otherwise("parked").alias("status"), F.date_add(today, days).alias("next_check"))


def inbox_entry(jobs: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds entered_at: the last time that an event put the job (id) into the inbox, else its creation. entries (id, at)."""
    last = entries.groupBy("id").agg(F.max("at").alias("__at"))
    return jobs.join(last, "id", "left").withColumn("entered_at", F.coalesce("__at", "created_at")).drop("__at")


def expired(jobs: DataFrame, now: Column, days: int = 15) -> DataFrame:
    """Inbox jobs that entered more than so many days ago and aren't being worked on."""
    return jobs.where((F.col("status") == "inbox") & ~F.coalesce("staged", F.lit(False)) & (F.col("entered_at") < now - F.make_dt_interval(days=F.lit(days))))


def abandoned(runs: DataFrame, now: Column, hours: int = 2) -> DataFrame:
    """Runs that never finished and began too long ago."""
    return runs.where(F.col("finished_at").isNull() & (F.col("started_at") < now - F.make_dt_interval(hours=F.lit(hours))))


def invalidate(ledger: DataFrame, stale_ids: DataFrame, key: str, at: Column, reason: str) -> DataFrame:
    """Marks the still valid rows of the given keys as stale."""
    hit = ledger.join(stale_ids.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    mark = F.col("__k").isNotNull() & F.col("stale_at").isNull()
    return hit.withColumns({"stale_at": F.when(mark, at).otherwise(F.col("stale_at")), "stale_reason": F.when(mark, F.lit(reason)).otherwise(F.col("stale_reason"))}).drop("__k")


def current_scores(events: DataFrame, extractions: DataFrame, aim_hash: str, experience_hash: str) -> tuple[DataFrame, DataFrame]:
    """(aim, experience): the newest score of each job and family if it is still valid; an experience score also needs the current aim score it came from.

    events (id, job_id, family, created_at, stale_at, input_hash, extraction_id, source_event_id, passed); extractions (id, stale_at).
    """
    newest = events.withColumn("__rn", F.row_number().over(Window.partitionBy("job_id", "family").orderBy(F.col("created_at").desc(), F.col("id").desc()))).where("__rn = 1 and stale_at is null").drop("__rn")
    valid = extractions.where("stale_at is null").select(F.col("id").alias("extraction_id"))
    aim = newest.where((F.col("family") == "aim_fit") & (F.col("input_hash") == aim_hash)).join(valid, "extraction_id", "left_semi")
    parent = aim.where("passed").select(F.col("job_id"), F.col("id").alias("source_event_id"))
    experience = newest.where((F.col("family") == "experience_fit") & (F.col("input_hash") == experience_hash)).join(parent, ["job_id", "source_event_id"], "left_semi")
    return aim, experience
