"""Which score of a posting counts, and what follows from a person's decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.segments import concept_key

#: Statuses that a person's decision protects, and bands of a score.
PROTECTED = ("applied", "interviewing", "bookmarked", "cooldown", "inbox")
TIERS = ((90, "priority"), (75, "high"), (50, "moderate"), (0, "low"))


def staged_authority(events: DataFrame) -> DataFrame:
    """A row a job with scores: mode, aim_state, experience_state, aim_id, experience_id, reason.

    events (id, job_id, family: aim_fit, experience_fit or legacy; created_at, stale_at, stale_reason, passed, source_event_id). The newest of each
    family counts, whatever its staleness; an experience score is current if it came from the current, passed aim score.
    """
    w = Window.partitionBy("job_id", "family").orderBy(F.col("created_at").desc(), F.col("id").desc())
    newest = events.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    of = lambda f: F.max(F.when(F.col("family") == f, F.struct("id", "stale_at", "stale_reason", "passed", "source_event_id"))).alias(f)
    jobs = newest.groupBy("job_id").agg(of("aim_fit"), of("experience_fit"), of("legacy"))
    aim, exp, old = F.col("aim_fit"), F.col("experience_fit"), F.col("legacy")
    staged = aim.isNotNull()
    aim_now = staged & aim["stale_at"].isNull()
    exp_now = exp.isNotNull() & exp["stale_at"].isNull() & aim_now & F.coalesce(aim["passed"], F.lit(False)) & F.coalesce(exp["source_event_id"] == aim["id"], F.lit(False))
    state = lambda there, now: F.when(~there, "unscored").when(now, "current").otherwise("stale_replay_needed")
    aim_state = F.when(staged, state(staged, aim_now)).otherwise(state(old.isNotNull(), old["stale_at"].isNull()))
    reason = (
        F.when(staged & ~aim_now, F.coalesce(aim["stale_reason"], F.lit("The newest Aim result was invalidated and must be replayed.")))
        .when(staged & exp.isNotNull() & ~exp_now, F.coalesce(exp["stale_reason"], F.lit("The newest Experience result is stale or does not bind the current Aim artifact.")))
        .when(~staged & old["stale_at"].isNotNull(), F.coalesce(old["stale_reason"], F.lit("The newest score was invalidated and must be replayed.")))
    )
    return jobs.select("job_id", F.when(staged, "staged").when(old.isNotNull(), "legacy").otherwise("unscored").alias("mode"), aim_state.alias("aim_state"), F.when(staged, state(exp.isNotNull(), exp_now)).otherwise("unscored").alias("experience_state"), F.when(aim_now, aim["id"]).alias("aim_id"), F.when(exp_now, exp["id"]).alias("experience_id"), reason.alias("reason"))


def status_after_cooldown(aim_state: Column, aim_passed: Column, experience_state: Column, experience_score: Column, least: int = 70) -> Column:
    """Where a posting goes when its cooldown ends: to the inbox with good current scores, else back for scoring, else out."""
    return F.when((experience_state == "current") & (experience_score >= least), "inbox").when((aim_state == "current") & ~aim_passed, "archived").when((experience_state == "current") & (experience_score < least), "archived").otherwise("pending_af")


def lifecycle_event(prior: Column, requested: Column, final: Column) -> Column:
    """struct<event_type, entered_inbox, protected> of a person's status change; null where there is none."""
    made = lambda kind, entered, held: F.struct(F.lit(kind).alias("event_type"), F.lit(entered).alias("entered_inbox"), F.lit(held).alias("protected"))
    return (
        F.when(requested.isNull() | prior.eqNullSafe(final), None)
        .when((requested == "inbox") & (final == "inbox"), made("user_promote", True, True))
        .when(requested.isin("passed", "dismissed") & (final == requested), made("user_reject", False, True))
        .when(final.isin(*PROTECTED), made("user_lifecycle", False, True))
        .when(final == "pending_af", made("user_rescore", False, False))
    )


def opportunity_tier(score: Column) -> Column:
    return F.coalesce(F.when(score.isNull(), "unscored"), *[F.when(score >= floor, name) for floor, name in TIERS])


def recovery_action(closed: Column, quality: Column, attempts: Column, most: int = 3) -> Column:
    """struct<action, attempts, terminal> for a fetched description: dismissed if closed, queued if scorable, else tried again up to `most` times."""
    again = F.greatest(F.lit(0), attempts) + 1
    action = F.when(closed, "dismiss_closed").when(quality["scorable"], "queue_local").otherwise("retry_extraction")
    retry = action == "retry_extraction"
    return F.struct(action.alias("action"), F.when(retry, again).otherwise(attempts).alias("attempts"), (retry & (again >= most)).alias("terminal"))


def evidence_gaps(rows: DataFrame) -> DataFrame:
    """(concept, n_required, n_preferred, first_at, last_at, jobs): what evidence couldn't settle, by concept.

    rows (job_id, created_at, criteria array<struct<criterion_id, classification, category, meaning>>, outcomes array<struct<criterion_id, outcome>>).
    """
    each = rows.select("job_id", "created_at", F.explode("criteria").alias("c"), F.map_from_entries(F.transform("outcomes", lambda o: F.struct(o["criterion_id"], o["outcome"]))).alias("o"))
    each = each.where(F.try_element_at("o", F.col("c.criterion_id")) == "cannot_evaluate").where(~F.col("c.category").isin("administrative", "subjective_boilerplate", "role_defining_credential") & (F.trim("c.meaning") != ""))
    return each.groupBy(concept_key(F.col("c.meaning")).alias("concept")).agg(F.count_if(F.col("c.classification") == "required").alias("n_required"), F.count_if(F.col("c.classification") == "preferred").alias("n_preferred"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count_distinct("job_id").alias("jobs"))


def usage(events: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts, outcomes, tokens, cost and rounded mean latency. events: keys, succeeded boolean, tokens, cost, latency_ms."""
    return events.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if("succeeded").alias("succeeded"), F.count_if(~F.col("succeeded")).alias("failed"), F.sum("tokens").alias("tokens"), F.sum(F.col("cost").cast("decimal(18,6)")).cast("double").alias("cost"), F.floor(F.avg("latency_ms") + 0.5).cast("long").alias("mean_latency_ms"))


def membership_mismatches(export: DataFrame, result: DataFrame) -> DataFrame:
    """Places where a result's members aren't the export's: (ordinal, expected, got). Both: (ordinal, job_id, input_hash)."""
    side = lambda df, p: df.select(F.col("ordinal").alias(f"{p}o"), F.struct("job_id", "input_hash").alias(p))
    both = side(export, "a").join(side(result, "b"), F.col("ao") == F.col("bo"), "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.coalesce("ao", "bo").alias("ordinal"), F.col("a.job_id").alias("expected"), F.col("b.job_id").alias("got"))
