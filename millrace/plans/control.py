"""Windows, circuits, budgets and keys over the events ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import classifiers, identity
from millrace.functions.rates import coverage
from millrace.functions.times import age_hours, catch_up_window, local_day, next_utc_day, next_utc_month
from millrace.operators import control
from millrace.plans.registry import query
from millrace.plans.statistics import NOW, events, now


@query(f"""SELECT user_id, max(ts) AS watermark, least(greatest(max(ts) - INTERVAL 2 HOURS, TIMESTAMP '{NOW}' - INTERVAL 7 DAYS), TIMESTAMP '{NOW}') AS window_start, max(ts) < TIMESTAMP '{NOW}' - INTERVAL 24 HOURS AS is_catch_up FROM events GROUP BY 1""")
def catch_up_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("watermark"))
    return rows.select("user_id", "watermark", catch_up_window(F.col("watermark"), now()).alias("w")).select("user_id", "watermark", "w.window_start", "w.is_catch_up")


@query("""SELECT user_id, CASE WHEN first_day IS NULL OR DATE '2024-01-10' < first_day THEN 'untracked' WHEN DATE '2024-01-10' = first_day THEN 'partial' ELSE 'tracked' END AS coverage, date_trunc('day', last_ts) + INTERVAL 1 DAY AS next_day, date_trunc('month', last_ts) + INTERVAL 1 MONTH AS next_month, round((epoch_ms(TIMESTAMP '2024-01-31 12:00:00') - epoch_ms(last_ts)) / 3600000.0, 1) AS age_hours
FROM (SELECT user_id, min(CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago' AS DATE)) AS first_day, max(ts) AS last_ts FROM events GROUP BY 1)""")
def tracking_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.min(local_day(F.col("ts"))).alias("first_day"), F.max("ts").alias("last_ts"))
    last = F.col("last_ts")
    return rows.select("user_id", coverage(F.lit("2024-01-10").cast("date"), F.col("first_day")).alias("coverage"), next_utc_day(last).cast("timestamp_ntz").alias("next_day"), next_utc_month(last).cast("timestamp_ntz").alias("next_month"), age_hours(last, now()).alias("age_hours"))


@query("""WITH o AS (SELECT event_id, user_id AS provider, ts AS stamp, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 7 = 0 THEN 'rate_limited' ELSE 'timeout' END END AS failure FROM events),
r AS (SELECT *, sum(CASE WHEN failure IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY provider ORDER BY stamp, failure IS NOT NULL, failure ROWS UNBOUNDED PRECEDING) AS run FROM o),
n AS (SELECT *, CAST(sum(CASE WHEN failure IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY provider, run ORDER BY stamp, failure IS NOT NULL, failure ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures_in_row FROM r),
m AS (SELECT *, CASE WHEN failure IS NULL THEN NULL WHEN failure = 'rate_limited' THEN 360 WHEN failures_in_row >= 3 THEN least(120, 15 * pow(2, failures_in_row - 3)) END AS minutes FROM n)
SELECT event_id, provider, failures_in_row, CASE WHEN minutes IS NOT NULL THEN 'open' ELSE 'closed' END AS state, stamp + to_minutes(CAST(minutes AS INTEGER)) AS open_until FROM m""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    failure = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 7 == 0, "rate_limited").otherwise("timeout"))
    rows = events(spark, sf_dir).select("event_id", F.col("user_id").alias("provider"), F.col("ts").alias("at"), failure.alias("failure"))
    return control.circuit_states(rows).select("event_id", "provider", "failures_in_row", "state", "open_until")


@query("""WITH c AS (SELECT event_id, event_type AS provider, ts AS stamp FROM events),
u AS (SELECT *, count(*) OVER (PARTITION BY provider, CAST(stamp AS DATE) ORDER BY stamp, event_id ROWS UNBOUNDED PRECEDING) AS used_today, count(*) OVER (PARTITION BY provider, date_trunc('month', stamp) ORDER BY stamp, event_id ROWS UNBOUNDED PRECEDING) AS used_this_month FROM c)
SELECT provider, CAST(stamp AS DATE) AS day, max(used_today) AS used, count(*) FILTER (used_today > 20 OR (provider = 'view' AND used_this_month > 300)) AS blocked FROM u GROUP BY 1, 2""")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls beyond a day's or month's budget, by provider and day."""
    limits = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(t).alias("provider"), F.lit(20).alias("daily"), F.lit(300 if t == "view" else None).cast("int").alias("monthly")) for t in ("click", "error", "purchase", "signup", "view")])).alias("l")).select("l.*")
    used = control.budget_use(events(spark, sf_dir).select(F.col("event_type").alias("provider"), F.col("ts").alias("at")), limits)
    return used.groupBy("provider", F.to_date("at").alias("day")).agg(F.max("used_today").alias("used"), F.count_if("blocked").alias("blocked"))


@query("""SELECT event_id, 'pipeline:v1:' || sha256(concat_ws(chr(31), event_type, CAST(user_id AS VARCHAR), '', CAST(event_id AS VARCHAR))) AS event_key, CAST(('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 12)) AS BIGINT) % 1800001 AS jitter FROM events""")
def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = identity.event_key(F.col("event_type"), F.col("user_id"), F.lit(None), F.col("event_id"))
    return events(spark, sf_dir).select("event_id", key.alias("event_key"), identity.jitter_millis(F.col("event_id").cast("string"), 1_800_000).alias("jitter"))


@query("""SELECT event_id, CASE WHEN seen = 0 AND errors = 0 THEN 'idle' WHEN errors = 0 THEN 'success' WHEN seen = 0 THEN 'failed' WHEN errors / (seen + requests) > 0.5 THEN 'failed' WHEN errors / (seen + requests) > 0.1 THEN 'partial' ELSE 'success' END AS status FROM (SELECT event_id, event_id % 13 AS seen, event_id % 3 AS requests, CAST(event_id % 3 + event_id % 2 AS DOUBLE) AS errors FROM events)""")
def run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf_dir).select("event_id", classifiers.run_status(e % 13, e % 3, e % 2).alias("status"))


MESSAGES = ["HTTP 429 from host", "invalid api key", "HTTP 404", "Unexpected token <", "blocked by daily budget", "request timed out", "boom", "keys are cooling down"]
KINDS = ["rate_limited", "credentials", "endpoint_unavailable", "response_schema", "budget_exhausted", "timeout", "provider_error", "keys_exhausted"]


@query(f"SELECT list_extract({KINDS}, CAST(event_id % 8 AS INT) + 1) AS kind, count(*) AS n FROM events GROUP BY 1")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % 8 + 1).cast("int"))
    return events(spark, sf_dir).groupBy(classifiers.provider_failure(message).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT event_id, event_id % 11 = 0 AS orch, event_id % 7 = 0 AS retired, event_type AS status, ts AS next_run, event_id % 4 = 0 AS leased, ts + INTERVAL 1 DAY AS lease_until, event_id % 5 = 0 AS open, ts + INTERVAL 2 DAYS AS open_until, event_id % 6 AS used FROM events)
SELECT category, count(*) AS n FROM (SELECT CASE WHEN orch THEN 'orchestration' WHEN retired THEN 'retired' WHEN status = 'click' AND (NOT leased OR lease_until <= TIMESTAMP '{NOW}') THEN 'staleLease' WHEN status = 'click' THEN 'running' WHEN open AND open_until > TIMESTAMP '{NOW}' THEN 'circuitCooldown' WHEN used >= 5 THEN 'budgetBlocked' WHEN status = 'error' AND next_run > TIMESTAMP '{NOW}' THEN 'failedAwaitingRetry' WHEN next_run <= TIMESTAMP '{NOW}' AND (NOT leased OR lease_until <= TIMESTAMP '{NOW}') THEN 'runnableNow' ELSE 'scheduled' END AS category FROM t) GROUP BY 1""")
def task_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps each task from running; the tasks are made from events."""
    e = F.col("event_id")
    circuit = F.struct(F.when(e % 5 == 0, "open").otherwise("closed").alias("state"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("open_until"), F.lit(5).alias("daily_limit"), F.lit(None).cast("int").alias("monthly_limit"), (e % 6).alias("daily_used"), F.lit(0).alias("monthly_used"), F.lit(NOW[:10]).alias("budget_day"), F.lit(NOW[:7]).alias("budget_month"))
    status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("pending")
    lease = F.when(e % 4 == 0, "token")
    kind, life = F.when(e % 11 == 0, "orchestration").otherwise("search"), F.when(e % 7 == 0, "retired").otherwise("active")
    category = classifiers.task_availability(now(), kind, life, status, F.col("ts"), lease, F.col("ts") + F.expr("INTERVAL 1 DAY"), circuit)
    return events(spark, sf_dir).groupBy(category.alias("category")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id AS id, user_id AS job_id, CASE WHEN event_type IN ('view', 'click') THEN 'aim_fit' ELSE 'experience_fit' END AS family, ts AS created_at, event_id % 6 = 0 AS stale, CASE WHEN event_id % 5 = 0 THEN 'old' ELSE 'now' END AS h, event_id % 10 AS x, event_id % 4 <> 0 AS passed FROM events),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, family ORDER BY created_at DESC, id DESC) AS rn FROM e) WHERE rn = 1 AND NOT stale),
a AS (SELECT * FROM n WHERE family = 'aim_fit' AND h = 'now' AND x <> 3)
SELECT job_id, family, id, passed FROM a UNION ALL SELECT job_id, family, id, passed FROM n WHERE family = 'experience_fit' AND h = 'now' AND job_id IN (SELECT job_id FROM a WHERE passed)""")
def current_score_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current scores of both families; an experience score counts with a passed current aim score behind it (here: any of the job)."""
    e = F.col("event_id")
    family = F.when(F.col("event_type").isin("view", "click"), "aim_fit").otherwise("experience_fit")
    ledger = events(spark, sf_dir).select(e.alias("id"), F.col("user_id").alias("job_id"), family.alias("family"), F.col("ts").alias("created_at"), F.when(e % 6 == 0, F.col("ts")).alias("stale_at"), F.when(e % 5 == 0, "old").otherwise("now").alias("input_hash"), (e % 10).alias("extraction_id"), F.lit(0).cast("long").alias("source_event_id"), (e % 4 != 0).alias("passed"))
    extractions = spark.range(10).select("id", F.when(F.col("id") == 3, F.lit(NOW).cast("timestamp_ntz")).alias("stale_at"))
    aim, _ = control.current_scores(ledger, extractions, "now", "now")
    parents = aim.where("passed").select("job_id", F.col("id").alias("p"))
    linked = ledger.join(parents, "job_id", "left").withColumn("source_event_id", F.when(F.col("family") == "experience_fit", F.col("p")).otherwise(F.col("source_event_id"))).drop("p")
    aim, experience = control.current_scores(linked, extractions, "now", "now")
    return aim.select("job_id", "family", "id", "passed").unionByName(experience.select("job_id", "family", "id", "passed"))


@query(f"""WITH j AS (SELECT o_orderkey AS id, o_custkey, o_orderdate AS created_at FROM orders), e AS (SELECT user_id AS id, max(ts) AS at FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT j.id, coalesce(e.at, created_at) AS entered_at, coalesce(e.at, created_at) < TIMESTAMP '{NOW}' - INTERVAL 15 DAYS AS expired FROM j LEFT JOIN e ON j.id = e.id""")
def inbox_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When postings entered the inbox, and which have been there for too long."""
    from millrace.tables import table

    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.lit("inbox").alias("status"), F.lit(False).alias("staged"))
    entered = control.inbox_entry(jobs, events(spark, sf_dir).where("event_type = 'signup'").select(F.col("user_id").alias("id"), F.col("ts").alias("at")))
    gone = control.expired(entered, now()).select("id", F.lit(True).alias("expired"))
    return entered.join(gone, "id", "left").select("id", "entered_at", F.coalesce("expired", F.lit(False)).alias("expired"))
