"""Which scores were made by earlier rules, and which decisions are worth another look."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.queues import PEOPLE, yes
from millrace.operators.ranking import first_per_key

#: Titles whose dismissal is worth another look, and scores that are.
WANTED = r"(?i)\b(?:account executive|account director|account manager|customer success|client success|channel|partner(?:ship)?s?|territory|regional sales|district sales|sales manager|field sales|business development|client partner|commercial)\b"
NEAR_AIM, NEAR_EXPERIENCE = 65, 70


def latest(events: DataFrame) -> DataFrame:
    """The newest event (job_id, id, created_at, ...) of each job."""
    return first_per_key(events, ["job_id"], [F.col("created_at").desc(), F.col("id").desc()])


def stale_scores(jobs: DataFrame, events: DataFrame, version: str) -> DataFrame:
    """(id): jobs (id, staged, pass_reason) whose newest score is stale, missing or of another prompt version; a stale newest score hides older ones. Staged and promoted ones stay out."""
    usable = latest(events).where("stale_at is null").select(F.col("job_id").alias("id"), F.col("prompt_version").alias("__v"))
    promoted = yes(F.lower("pass_reason").contains("promoted by user"))
    return jobs.where(~yes(F.col("staged")) & ~promoted).join(usable, "id", "left").where(~F.col("__v").eqNullSafe(version)).select("id")


def worth_another_look(jobs: DataFrame, events: DataFrame, version: str, since: Column, most: int) -> DataFrame:
    """At most so many recently dismissed jobs (id, title, aim_score, experience_score, local_passes) in their order: wanted titles first, then by scores, then by id."""
    fresh = latest(events).where(F.col("stale_at").isNull() & ~F.col("passed") & (F.col("prompt_version") != version) & (F.col("created_at") >= since))
    held = jobs.where("local_passes").join(fresh.select(F.col("job_id").alias("id")), "id", "left_semi").withColumn("wanted", F.col("title").rlike(WANTED))
    near = F.col("wanted") | (F.coalesce("aim_score", F.lit(0)) >= NEAR_AIM) | (F.coalesce("experience_score", F.lit(0)) >= NEAR_EXPERIENCE)
    order = [F.col("wanted").desc(), F.coalesce("experience_score", F.lit(0)).desc(), F.coalesce("aim_score", F.lit(0)).desc(), F.col("id")]
    return held.where(yes(near)).orderBy(*order).limit(max(0, most)).select("id", "wanted")


def drifted_events(events: DataFrame, current: Mapping[str, str]) -> DataFrame:
    """(id, job_id, family): valid scores whose inputs' hash (input_hash) isn't the family's current one."""
    now = F.coalesce(*[F.when(F.col("family") == k, F.lit(v)) for k, v in current.items()])
    return events.where(F.col("stale_at").isNull() & F.col("family").isin(*current) & ~F.col("input_hash").eqNullSafe(now)).select("id", "job_id", "family")


def drifted_rows(rows: DataFrame, current: Mapping[str, str]) -> DataFrame:
    """Valid rows of which any of the named columns differs from its current value."""
    differs = F.lit(False)
    for column, value in current.items():
        differs = differs | ~F.col(column).eqNullSafe(value)
    return rows.where(F.col("stale_at").isNull() & differs)


def replay_plan(jobs: DataFrame, events: DataFrame, people: DataFrame, current: Mapping[str, str], first_family: str = "aim_fit") -> DataFrame:
    """(job_id, families, action) of jobs with drifted scores: requeue_all or requeue_rest (the first family is still good) if no person decided and the status is still what the newest score made it; else action_needed.

    jobs (id, status, staged); events (id, job_id, family, created_at, stale_at, input_hash, projection); people (job_id, event_type).
    """
    drifted = drifted_events(events, current).groupBy("job_id").agg(F.sort_array(F.collect_set("family")).alias("families"))
    newest = latest(events.where("stale_at is null")).select("job_id", "projection")
    decided = people.where(F.col("event_type").isin(*PEOPLE)).select("job_id").distinct().withColumn("__decided", F.lit(True))
    row = drifted.join(jobs.select(F.col("id").alias("job_id"), "status", "staged"), "job_id").join(newest, "job_id", "left").join(decided, "job_id", "left")
    free = ~yes(F.col("staged")) & F.col("__decided").isNull() & yes(F.col("status") == F.col("projection"))
    return row.select("job_id", "families", F.when(~free, "action_needed").when(F.array_contains("families", first_family), "requeue_all").otherwise("requeue_rest").alias("action"))


def replayed(jobs: DataFrame, plan: DataFrame, most: int | None = None) -> DataFrame:
    """jobs with the plan's requeues carried out; none of them if there are more than `most`."""
    todo = plan.where(F.col("action").startswith("requeue"))
    if most is not None and todo.limit(most + 1).count() > most:
        return jobs
    hit = jobs.join(todo.select(F.col("job_id").alias("id"), "action"), "id", "left")
    again, whole = F.col("action").isNotNull(), F.col("action") == "requeue_all"
    sets = {"status": (again, "pending_af"), "experience_status": (again, "queued"), "experience_score": (again, None), "experience_rationale": (again, None), "aim_score": (whole, None), "travel_score": (whole, None), "compensation": (whole, None)}
    cols = [F.when(yes(sets[c][0]), F.lit(sets[c][1])).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c in sets else F.col(c) for c in jobs.columns]
    return hit.select(*cols)


def superseded(batches: DataFrame, current: Mapping[str, str]) -> DataFrame:
    """(id): exported batches (id, stage, status, input_hash) of earlier inputs."""
    now = F.coalesce(*[F.when(F.col("stage") == k, F.lit(v)) for k, v in current.items()])
    return batches.where((F.col("status") == "exported") & ~F.col("input_hash").eqNullSafe(now)).select("id")


def gated_status(aim_score: Column, experience_score: Column, protected: Column, least_aim: int = 60, least_experience: int = 70) -> Column:
    """struct<status, advances> that an imported score gives a job: an aim score of 60 or more goes on to experience, an experience score of 70 or more to the inbox; what a person decided stays (null)."""
    advances = F.coalesce(F.when(experience_score.isNotNull(), experience_score >= least_experience).otherwise(aim_score >= least_aim), F.lit(False))
    status = F.when(yes(protected), None).when(experience_score.isNotNull(), F.when(experience_score >= least_experience, "inbox").otherwise("dismissed")).when(aim_score.isNotNull(), F.when(aim_score >= least_aim, "pending_af").otherwise("dismissed"))
    return F.struct(status.alias("status"), advances.alias("advances"))
