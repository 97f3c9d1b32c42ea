"""Operational statistics over the events ledger: calendar days, funnels, sources, cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.rates import decimal_average, precise_rate, reconciles, safe_rate, stage_metric, throughput
from millrace.functions.times import day_spine, local_day, within
from millrace.operators.predicates import json_flag
from millrace.operators.ranking import first_eligible_per_key, first_per_key
from millrace.plans.registry import query
from millrace.tables import table

NOW = "2024-01-31 12:00:00"
TYPES = ("click", "error", "purchase", "signup", "view")
#: SQL for the Chicago calendar day of events.ts, and for the test of k = n in props.
DAY = "CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago' AS DATE)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"""
WITH spine AS (SELECT CAST(unnest(generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
e AS (SELECT {DAY} AS day, {", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in TYPES)}, count(*) FILTER (json_extract_string(props, '$.k') = '1') AS n_flagged, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1)
SELECT spine.day, {", ".join(f"coalesce(n_{t}, 0) AS n_{t}" for t in TYPES)}, coalesce(n_flagged, 0) AS n_flagged, coalesce(total, 0) AS total FROM spine LEFT JOIN e ON spine.day = e.day""")
def daily_event_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty days on a calendar spine; days without events count 0."""
    counts = [F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in TYPES]
    daily = events(spark, sf_dir).select(local_day(F.col("ts")).alias("day"), "event_type", "value", "props")
    daily = daily.groupBy("day").agg(*counts, F.count_if(F.get_json_object("props", "$.k") == "1").alias("n_flagged"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    spine = day_spine(spark, F.lit("2024-01-31").cast("date"), 30)
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*(f"n_{t}" for t in TYPES), "n_flagged"]]
    return spine.join(daily, "day", "left").select("day", *filled, F.coalesce("total", F.lit(0.0)).alias("total")).orderBy(F.col("day").desc())


@query("""
WITH r AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS runs, count(*) FILTER (o_orderstatus = 'P') AS unreconciled, bool_and(o_orderstatus <> 'P') AS all_reconciled, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS seen FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-03-02' GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-03-01', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT s.day, coalesce(runs, 0) AS runs, coalesce(unreconciled, 0) AS unreconciled, coalesce(all_reconciled, true) AS all_reconciled, coalesce(seen, 0) AS seen FROM s LEFT JOIN r ON s.day = r.day""")
def daily_run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of runs by day since tracking began; a day without runs is reconciled."""
    runs = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1995-03-02'")
    daily = runs.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("runs"), F.count_if(F.col("o_orderstatus") == "P").alias("unreconciled"), F.bool_and(F.col("o_orderstatus") != "P").alias("all_reconciled"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("seen"))
    spine = day_spine(spark, F.lit("1995-03-01").cast("date"), 60)
    return spine.join(daily, "day", "left").select("day", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("unreconciled", F.lit(0)).alias("unreconciled"), F.coalesce("all_reconciled", F.lit(True)).alias("all_reconciled"), F.coalesce("seen", F.lit(0.0)).alias("seen"))


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def latest_event_unless_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user, ranked before staleness: a newest error hides older events."""
    newest = first_per_key(events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    return newest.where("event_type <> 'error'")


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'error') WHERE rn = 1")
def latest_eligible_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user that is no error: filtered before ranking."""
    return first_eligible_per_key(events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts"), F.col("event_type") != "error", ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


@query("""SELECT user_id, family, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, family ORDER BY ts DESC, event_id DESC) AS rn FROM (SELECT *, CASE WHEN event_type IN ('purchase', 'signup') THEN 'outcome' WHEN event_type = 'error' THEN 'error' ELSE 'activity' END AS family FROM events)) WHERE rn = 1""")
def latest_event_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(F.col("event_type").isin("purchase", "signup"), "outcome").when(F.col("event_type") == "error", "error").otherwise("activity")
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts", family.alias("family"))
    return first_per_key(rows, ["user_id", "family"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "family", "event_id")


@query("""SELECT event_type, list_aggregate(list_sort(list(DISTINCT user_id % 7)), 'string_agg', ',') AS kinds, CAST(arg_max(event_id, ts) AS BIGINT) AS last_id, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE ts >= TIMESTAMP '2024-01-24 12:00:00' GROUP BY 1""")
def incident_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing seven days by type: distinct kinds in order, the last one's id, first and last times."""
    recent = events(spark, sf_dir).where(within(F.col("ts"), now(), "7 DAYS"))
    kinds = F.array_join(F.array_sort(F.collect_set(F.col("user_id") % 7)), ",")
    return recent.groupBy("event_type").agg(kinds.alias("kinds"), F.max_by("event_id", "ts").alias("last_id"), F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("""SELECT event_type, max(ts) FILTER (value > 0) AS last_productive, count(*) AS runs, count(*) FILTER (json_extract_string(props, '$.k') = '0') AS failed, count(*) FILTER (ts >= TIMESTAMP '2024-01-30 12:00:00') AS recent_runs, CAST(coalesce(sum(CAST(value AS DECIMAL(18,4))) FILTER (ts >= TIMESTAMP '2024-01-30 12:00:00'), 0) AS DOUBLE) AS recent_value FROM events WHERE ts >= TIMESTAMP '2024-01-24 12:00:00' GROUP BY 1""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-day health with conditional counts, and sums of the last day alone."""
    recent = within(F.col("ts"), now(), "1 DAY")
    rows = events(spark, sf_dir).where(within(F.col("ts"), now(), "7 DAYS"))
    return rows.groupBy("event_type").agg(
        F.max(F.when(F.col("value") > 0, F.col("ts"))).alias("last_productive"), F.count("*").alias("runs"), F.count_if(F.get_json_object("props", "$.k") == "0").alias("failed"),
        F.count_if(recent).alias("recent_runs"), F.coalesce(F.sum(F.when(recent, F.col("value").cast("decimal(18,4)"))), F.lit(0)).cast("double").alias("recent_value"),
    )


@query("""SELECT family, version, count(*) AS n, count(*) FILTER (score >= 60) AS passed, CAST(round(avg(CAST(score AS DECIMAL(38,10))), 1) AS DOUBLE) AS mean, min(score) AS lowest, max(score) AS highest, max(stamp) AS last_at
FROM (SELECT 'aim' AS family, user_id % 5 AS version, CAST(event_id % 101 AS BIGINT) AS score, ts AS stamp FROM events WHERE event_type = 'view' UNION ALL SELECT 'experience', user_id % 3, CAST(event_id % 97 AS BIGINT), ts FROM events WHERE event_type = 'click') GROUP BY 1, 2 ORDER BY last_at DESC, family, version LIMIT 8""")
def prompt_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two families of scores put together, by version; the eight last used."""
    e = events(spark, sf_dir)
    one = lambda family, kind, n, m: e.where(F.col("event_type") == kind).select(F.lit(family).alias("family"), (F.col("user_id") % n).alias("version"), (F.col("event_id") % m).alias("score"), F.col("ts").alias("at"))
    both = one("aim", "view", 5, 101).unionByName(one("experience", "click", 3, 97))
    out = both.groupBy("family", "version").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 60).alias("passed"), decimal_average(F.col("score")).alias("mean"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.max("at").alias("last_at"))
    return out.orderBy(F.col("last_at").desc(), "family", "version").limit(8)


@query("""SELECT o_orderpriority AS platform, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'P') AS parked, count(*) FILTER (o_orderstatus = 'F') AS blacklisted, count(*) AS total FROM orders GROUP BY 1""")
def platform_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"O": "active", "P": "parked", "F": "blacklisted"}
    wide = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("platform")).pivot("o_orderstatus", list(names)).count()
    counts = [F.coalesce(k, F.lit(0)).alias(v) for k, v in names.items()]
    return wide.select("platform", *counts).withColumn("total", F.col("active") + F.col("parked") + F.col("blacklisted")).orderBy(F.col("total").desc(), "platform")


@query("""SELECT (SELECT count(*) FROM orders) AS orders_total, (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders WHERE o_orderstatus = 'F') AS done_value, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM events WHERE ts >= (SELECT min(ts) FROM events WHERE event_type = 'signup')) AS tracked_events, (SELECT min(ts) FROM events) AS tracking_since""")
def lifetime_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals from several tables; one bound is itself an aggregate."""
    e, o = events(spark, sf_dir), table(spark, sf_dir, "orders")
    since = e.where("event_type = 'signup'").agg(F.min("ts").alias("since"))
    parts = [
        o.agg(F.count("*").alias("orders_total"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("done_value")),
        e.agg(F.count_distinct("user_id").alias("users"), F.min("ts").alias("tracking_since")),
        e.join(F.broadcast(since), F.col("ts") >= F.col("since")).agg(F.count("*").alias("tracked_events")),
    ]
    one = [p.withColumn("one", F.lit(1)) for p in parts]  # one row each
    return one[0].join(one[1], "one").join(one[2], "one").select("orders_total", "done_value", "users", "tracked_events", "tracking_since")


@query("SELECT event_type, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query(f"""WITH d AS (SELECT {DAY} AS day, count(*) AS seen, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
SELECT day, seen, errors, CAST(sum(seen) OVER w AS BIGINT) AS seen_7, CAST(sum(errors) OVER w AS BIGINT) AS errors_7, CAST(sum(seen) OVER m AS BIGINT) AS seen_30 FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), m AS (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def trailing_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the last 7 and 30 days of the daily table (a row a day, so one window partition is small)."""
    daily = events(spark, sf_dir).groupBy(local_day(F.col("ts")).alias("day")).agg(F.count("*").alias("seen"), F.count_if(F.col("event_type") == "error").alias("errors"))
    w = Window.orderBy("day")
    week, month = w.rowsBetween(-6, 0), w.rowsBetween(-29, 0)
    return daily.select("day", "seen", "errors", F.sum("seen").over(week).alias("seen_7"), F.sum("errors").over(week).alias("errors_7"), F.sum("seen").over(month).alias("seen_30"))


@query("""SELECT user_id, count(*) AS seen, count(*) FILTER (event_type = 'purchase') AS inserted,
CASE WHEN count(*) <= 0 THEN NULL ELSE floor(count(*) FILTER (event_type = 'purchase') * 1000.0 / count(*) + 0.5) / 10 END AS safe,
CASE WHEN count(*) FILTER (event_type = 'view') <= 0 THEN NULL WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 0.0 WHEN count(*) FILTER (event_type = 'purchase') * 100.0 / count(*) FILTER (event_type = 'view') < 0.05 THEN floor(count(*) FILTER (event_type = 'purchase') * 100000.0 / count(*) FILTER (event_type = 'view') + 0.5) / 1000 ELSE floor(count(*) FILTER (event_type = 'purchase') * 1000.0 / count(*) FILTER (event_type = 'view') + 0.5) / 10 END AS precise,
count(*) = count(*) FILTER (event_type = 'purchase') + count(*) FILTER (event_type = 'click') + count(*) FILTER (event_type = 'view') + count(*) FILTER (event_type = 'error') AS reconciles FROM events GROUP BY 1""")
def user_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t: F.count_if(F.col("event_type") == t)
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("seen"), *[of(t).alias(t) for t in TYPES])
    return rows.select("user_id", "seen", F.col("purchase").alias("inserted"), safe_rate(F.col("purchase"), F.col("seen")).cast("double").alias("safe"), precise_rate(F.col("purchase"), F.col("view")).cast("double").alias("precise"), reconciles(F.col("seen"), F.col("purchase"), F.col("click"), F.col("view"), F.col("error")).alias("reconciles"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CASE WHEN sum(CAST(l_linenumber AS BIGINT)) > 0 THEN CAST(round(CAST(sum(CAST(l_quantity AS BIGINT)) AS DECIMAL(30,0)) * 3600000 / sum(CAST(l_linenumber AS BIGINT)), 2) AS DOUBLE) END AS per_hour FROM lineitem GROUP BY 1, 2""")
def guarded_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"), F.sum(F.col("l_linenumber").cast("long")).alias("ms"))
    return rows.select("l_returnflag", "l_linestatus", "n", throughput(F.col("q"), F.col("ms")).alias("per_hour"))


@query("SELECT user_id, event_type, count(*) AS copies FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A violation query: what should be one row and isn't."""
    return events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("copies")).where("copies > 1")


@query("""SELECT user_id, count(*) AS flagged FROM events WHERE props LIKE '{"k": 7}' GROUP BY 1""")
def json_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type-strict test of a JSON field: the number 7, not the text "7"."""
    seven = F.try_variant_get(F.try_parse_json("props"), "$.k", "int") == 7
    return events(spark, sf_dir).where(seven).groupBy("user_id").agg(F.count("*").alias("flagged"))


@query("""SELECT event_type, json_type(props) AS kind, json_type(props, '$.k') AS field_kind, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def json_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    kind = F.when(F.schema_of_variant(v).startswith("OBJECT"), "OBJECT").otherwise(F.schema_of_variant(v))
    field = F.when(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")) == "BIGINT", "UBIGINT").otherwise(F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")))
    return events(spark, sf_dir).select("event_type", kind.alias("kind"), field.alias("field_kind")).groupBy("event_type", "kind", "field_kind").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (event_type = 'error') AS errors, CASE WHEN count(*) FILTER (event_type = 'refund') = 0 THEN NULL ELSE count(*) FILTER (event_type = 'refund') END AS refunds, CASE WHEN count(*) FILTER (event_type = 'refund') = 0 THEN 'not_instrumented' END AS refunds_reason FROM events""")
def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = events(spark, sf_dir).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "refund").alias("r"))
    return counts.select("errors", stage_metric(F.col("r"), F.col("r")).alias("m")).select("errors", F.col("m.value").alias("refunds"), F.col("m.reason").alias("refunds_reason"))


@query("SELECT event_id FROM events WHERE event_id % 3 = 0")
def flagged_true(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose details hold the boolean true; texts that look like it don't count."""
    made = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, '{"enteredInbox": true}').when(F.col("event_id") % 3 == 1, '{"enteredInbox": "true"}').otherwise(F.col("props")).alias("details"))
    return made.where(json_flag("details", "enteredInbox")).select("event_id")
