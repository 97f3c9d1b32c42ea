"""Repairs and rules applied after the fact: each is a plan, (id, column, expected, to, reason), that is applied where the column still holds what was expected."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import classifiers, facts, paths, places, text
from millrace.operators.queues import PEOPLE

#: Statuses in which a company's other postings wait, and for how long.
IN_PLAY = ("applied", "interviewing")
COOLDOWN_DAYS = 21
#: Names that are no company's, and what pages say around a description.
NO_COMPANY = r"(?i)^(?:unknown|n/?a|none|null|company|confidential|-+|\d+|[a-z0-9-]+\.(?:wd\d+|myworkdayjobs)(?:\.com)?)$"
CHROME = r"(?im)^\s*(?:skip to (?:main )?content|sign in|log in|post a job|search jobs|cookie policy|all rights reserved.*|menu)\s*$"


def plan(rows: DataFrame, column: str, to: Column, reason: Column | str, key: str = "id") -> DataFrame:
    """Rows whose column would change."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    made = rows.select(F.col(key).alias("id"), F.lit(column).alias("column"), F.col(column).cast("string").alias("expected"), to.cast("string").alias("to"), why.alias("reason"))
    return made.where(F.col("to").isNotNull() & ~F.col("to").eqNullSafe(F.col("expected")))


def apply(rows: DataFrame, plans: DataFrame, key: str = "id") -> DataFrame:
    """rows with every planned change whose column still holds the expected value; adds applied, the columns changed."""
    by = plans.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("expected", "to")))).alias("__plan")).withColumnRenamed("id", "__id")
    held = rows.join(by, F.col(key) == F.col("__id"), "left")
    hit = {c: F.coalesce(F.map_contains_key("__plan", F.lit(c)) & F.col(c).cast("string").eqNullSafe(F.col("__plan")[c]["expected"]), F.lit(False)) for c in rows.columns}
    applied = F.array_compact(F.array(*[F.when(h, F.lit(c)) for c, h in hit.items()]))
    return held.select(*[F.when(hit[c], F.col("__plan")[c]["to"].cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in rows.columns], applied.alias("applied"))


def undecided(jobs: DataFrame, events: DataFrame, leased: DataFrame) -> DataFrame:
    """Jobs that no person's event (job_id, event_type) and no lease (id) holds."""
    people = events.where(F.col("event_type").isin(*PEOPLE)).select(F.col("job_id").alias("id"))
    return jobs.join(people, "id", "left_anti").join(leased.select("id"), "id", "left_anti")


def floor_plan(jobs: DataFrame, events: DataFrame, leased: DataFrame, least: int, column: str = "aim_score") -> DataFrame:
    """Dismisses waiting jobs below a score."""
    return plan(undecided(jobs, events, leased).where((F.col("status") == "pending_af") & (F.col(column) < least)), "status", F.lit("dismissed"), F.format_string(f"{column} %d is below {least}", F.col(column)))


def geography_plan(jobs: DataFrame, events: DataFrame, leased: DataFrame, status: str = "inbox", region: places.Region = places.HOME) -> DataFrame:
    """Dismisses jobs of sources that state their own metadata whose title or location is out of reach."""
    held = undecided(jobs, events, leased).where((F.col("status") == status) & places.states_metadata(F.col("source")))
    v = places.gated(F.col("title"), F.col("company"), F.col("location"), F.lit(False), paths.path_place(F.col("url")), region)
    return plan(held.withColumn("__v", v).where(~F.col("__v.passes")), "status", F.lit("dismissed"), F.col("__v.reason"))


def triage_plan(jobs: DataFrame, events: DataFrame, leased: DataFrame, status: str = "pending_af", region: places.Region = places.HOME) -> DataFrame:
    """As geography_plan, for any source and by location and title alone."""
    v = places.triage(F.col("title"), F.col("location"), region)
    return plan(undecided(jobs, events, leased).where(F.col("status") == status).withColumn("__v", v).where(~F.col("__v.pass")), "status", F.lit("dismissed"), F.concat(F.lit("Locally triaged out: "), F.col("__v.reason")))


def recovery_plan(jobs: DataFrame) -> DataFrame:
    """What today's rules make of jobs whose description failed: closed ones go, good ones are queued, others are fetched again."""
    failed = jobs.where(F.col("scoring_status") == "failed").withColumn("__a", classifiers.recovery_plan(F.col("description"), classifiers.is_structured_source(F.col("source"))))
    gone = plan(failed.where("__a = 'dismiss_closed'"), "status", F.lit("dismissed"), "The posting is closed")
    back = plan(failed.where("__a <> 'dismiss_closed'"), "scoring_status", F.when(F.col("__a") == "queue_local", "queued").otherwise("needs_jd"), F.col("__a"))
    return gone.unionByName(back)


def facts_plan(jobs: DataFrame) -> DataFrame:
    """Fills pay, travel and places that are missing and that the description or address states."""
    place = paths.with_count(paths.path_place(F.col("url")), F.col("location"))
    return (
        plan(jobs.where("compensation is null"), "compensation", facts.posted_base_pay(F.col("description")), "stated in the description")
        .unionByName(plan(jobs.where("travel is null"), "travel", facts.posted_travel(F.col("description")), "stated in the description"))
        .unionByName(plan(jobs.where(paths.counts_places(F.col("location"))), "location", place, "named by the address"))
    )


def markup_plan(jobs: DataFrame) -> DataFrame:
    """Cleans descriptions in which markup or pages' navigation is left."""
    left = jobs.where(F.col("description").rlike(r"(?i)&lt;/?(?:p|div|ul|li|br|span|strong|h[1-6])\b|</?(?:p|div|ul|li|br|span|strong|h[1-6])\b|" + CHROME.replace("(?im)", "(?m)")))
    bare = F.regexp_replace(F.regexp_replace(text.clean_html(F.col("description")), CHROME, ""), r"\n{3,}", "\n\n")
    bare = F.regexp_replace(bare, r"^\s+|\s+\z", "")
    return plan(left, "description", F.nullif(bare, F.lit("")), "markup or navigation in the description")


def company_plan(jobs: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Names companies that are none or hosts, by a slug's known name or from the slug (company_slug)."""
    known = F.coalesce(*[F.when(F.col("company_slug") == k, F.lit(v)) for k, v in (names or {}).items()], text.title_case(F.col("company_slug")))
    bad = F.coalesce(F.trim("company").rlike(NO_COMPANY), F.lit(True))
    return plan(jobs.where(bad & (F.coalesce("company_slug", F.lit("")) != "")), "company", F.nullif(known, F.lit("")), "no company's name")


def status_change(jobs: DataFrame, request: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, events) after people's changes (id, status). An application puts the company's other inbox jobs into cooldown; an inbox job of a company in play goes there too."""
    asked = jobs.join(request.select("id", F.col("status").alias("__to")), "id", "left")
    stem = text.company_stem(F.col("company"))
    asked = asked.withColumn("__company", stem)
    in_play = asked.where(F.coalesce("__to", "status").isin(*IN_PLAY) & (F.col("__company") != "")).groupBy("__company").agg(F.min("id").alias("__first"), F.max("id").alias("__last"))
    row = asked.join(in_play, "__company", "left")
    other = F.col("__first").isNotNull() & ((F.col("__first") != F.col("id")) | (F.col("__last") != F.col("id")))
    wish = F.coalesce("__to", "status")
    held = F.coalesce((wish == "inbox") & other, F.lit(False))
    final = F.when(held, "cooldown").otherwise(wish)
    row = row.withColumn("__final", final)
    changed = ~F.col("__final").eqNullSafe(F.col("status"))
    events = row.where(changed | F.col("__to").isNotNull()).select("id", F.when(F.col("__to").isNotNull(), "user_lifecycle").otherwise("company_cooldown").alias("event_type"), F.col("status").alias("prior"), F.col("__to").alias("requested"), F.col("__final").alias("final"), now.alias("at"))
    until = F.when(changed & (F.col("__final") == "cooldown"), now + F.make_dt_interval(days=F.lit(COOLDOWN_DAYS))).otherwise(F.col("cooldown_until") if "cooldown_until" in jobs.columns else F.lit(None).cast("timestamp"))
    kept = [F.col("__final").alias("status") if c == "status" else F.col(c) for c in jobs.columns if c != "cooldown_until"]
    return row.select(*kept, until.alias("cooldown_until")), events


def tailoring(jobs: DataFrame, platform: Column) -> DataFrame:
    """Staged jobs as they are handed on for tailoring, with their hiring platform."""
    return jobs.where("staged").select("id", "title", "company", "url", "description", platform.alias("platform"))
