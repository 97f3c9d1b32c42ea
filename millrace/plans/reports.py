"""Verdicts, usage, audits and reports over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import classifiers, places, segments
from millrace.functions.rates import safe_rate
from millrace.functions.scoring import banded
from millrace.functions.text import tokens
from millrace.functions.times import within
from millrace.operators import authority
from millrace.plans.registry import query
from millrace.plans.statistics import NOW, events, now
from millrace.sources.files import with_hash
from millrace.tables import table


@query(f"""WITH s AS (SELECT user_id AS source, count(*) AS runs, count(*) FILTER (event_type = 'purchase') AS inserted, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS recent_runs, count(*) FILTER (event_type = 'error' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS recent_errors, max(ts) FILTER (event_type = 'purchase') AS productive FROM events GROUP BY 1),
v AS (SELECT source, inserted, errors, CASE WHEN source % 10 = 0 THEN CASE WHEN recent_errors > 0 THEN CASE WHEN recent_errors >= recent_runs THEN 'failing' ELSE 'degraded' END WHEN recent_runs = 0 AND errors > 0 THEN 'degraded' ELSE 'healthy' END WHEN inserted = 0 AND coalesce((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(productive)) / 3600000.0, 1e9) >= 24 THEN 'failing' WHEN floor(errors * 1000.0 / runs + 0.5) / 10 >= 50 THEN 'failing' WHEN errors > inserted / 2 THEN 'degraded' WHEN floor(errors * 1000.0 / runs + 0.5) / 10 >= 10 THEN 'degraded' ELSE 'healthy' END AS verdict FROM s)
SELECT source, verdict, row_number() OVER (ORDER BY CASE verdict WHEN 'failing' THEN 0 WHEN 'degraded' THEN 1 ELSE 2 END, CASE WHEN verdict = 'healthy' THEN inserted ELSE errors END DESC, source) AS place FROM v ORDER BY place LIMIT 100""")
def source_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by health, the worst first; the first hundred with their places."""
    day = within(F.col("ts"), now(), "1 DAY")
    is_ = lambda t: F.col("event_type") == t
    s = events(spark, sf_dir).groupBy(F.col("user_id").alias("source")).agg(F.count("*").alias("runs"), F.count_if(is_("purchase")).alias("inserted"), F.count_if(is_("error")).alias("errors"), F.count_if(day).alias("recent_runs"), F.count_if(day & is_("error")).alias("recent_errors"), F.max(F.when(is_("purchase"), F.col("ts"))).alias("productive"))
    hours = (F.unix_millis(now().cast("timestamp")) - F.unix_millis(F.col("productive").cast("timestamp"))) / 3.6e6
    c = F.col
    s = s.withColumn("verdict", classifiers.source_verdict(c("source") % 10 == 0, c("runs"), c("inserted"), hours, c("recent_runs"), c("recent_errors"), c("recent_errors"), c("errors"), safe_rate(c("errors"), c("runs"))))
    rank = F.when(c("verdict") == "failing", 0).when(c("verdict") == "degraded", 1).otherwise(2)
    from millrace.operators.ranking import with_ordinal

    order = [rank, F.when(c("verdict") == "healthy", c("inserted")).otherwise(c("errors")).desc(), c("source")]
    return with_ordinal(s.orderBy(*order).limit(100), [], order, "place").select("source", "verdict", (F.col("place") + 1).alias("place"))


@query("""SELECT event_type AS model, CAST(ts AS DATE) AS day, count(*) AS attempts, count(*) FILTER (user_id % 9 <> 0) AS succeeded, count(*) FILTER (user_id % 9 = 0) AS failed, CAST(sum(event_id % 1000) AS BIGINT) AS tokens, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS cost, CAST(floor(avg(event_id % 977) + 0.5) AS BIGINT) AS mean_latency_ms FROM events GROUP BY 1, 2""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("event_type").alias("model"), F.to_date("ts").alias("day"), (F.col("user_id") % 9 != 0).alias("succeeded"), (F.col("event_id") % 1000).alias("tokens"), F.col("value").alias("cost"), (F.col("event_id") % 977).alias("latency_ms"))
    return authority.usage(e, ["model", "day"])


@query("""WITH o AS (SELECT o_orderstatus AS decision, CAST(o_orderkey % 101 AS INTEGER) AS score FROM orders) SELECT decision, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'strong' WHEN score >= 55 THEN 'good' WHEN score >= 40 THEN 'mixed' ELSE 'low' END AS band, count(*) AS n, min(score) AS lowest, max(score) AS highest FROM o GROUP BY 1, 2""")
def decision_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("decision"), (F.col("o_orderkey") % 101).cast("int").alias("score"))
    bands = [(85, "excellent"), (70, "strong"), (55, "good"), (40, "mixed"), (0, "low")]
    return banded(o, "score", bands).groupBy("decision", "band").agg(F.count("*").alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


@query("""SELECT (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated_lines, count(*) FILTER (o_totalprice <= 0) AS unpriced, count(*) FILTER (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01') AS stale_open, count(*) FILTER (o_custkey IS NULL) AS ownerless FROM orders""")
def readiness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts of what should not be there."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    again = li.groupBy("l_orderkey", "l_linenumber").count().agg(F.count_if(F.col("count") > 1).alias("repeated_lines")).withColumn("one", F.lit(1))
    rest = o.agg(F.count_if(F.col("o_totalprice") <= 0).alias("unpriced"), F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))).alias("stale_open"), F.count_if(F.col("o_custkey").isNull()).alias("ownerless")).withColumn("one", F.lit(1))
    return again.join(rest, "one").select("repeated_lines", "unpriced", "stale_open", "ownerless")


@query("""WITH e AS (SELECT event_id AS id, user_id AS job_id, CASE WHEN event_type = 'error' OR user_id % 3 = 0 THEN 'legacy' WHEN event_type IN ('view', 'click') THEN 'aim_fit' ELSE 'experience_fit' END AS family, ts AS created_at, event_id % 6 = 0 AS stale, event_id % 4 <> 0 AS passed FROM events),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, family ORDER BY created_at DESC, id DESC) AS rn FROM e) WHERE rn = 1),
j AS (SELECT job_id, max(id) FILTER (family = 'aim_fit') AS aim, bool_or(stale) FILTER (family = 'aim_fit') AS aim_stale, max(id) FILTER (family = 'legacy') AS old, bool_or(stale) FILTER (family = 'legacy') AS old_stale, max(id) FILTER (family = 'experience_fit') AS ex FROM n GROUP BY 1)
SELECT job_id, CASE WHEN aim IS NOT NULL THEN 'staged' WHEN old IS NOT NULL THEN 'legacy' ELSE 'unscored' END AS mode, CASE WHEN aim IS NOT NULL THEN CASE WHEN aim_stale THEN 'stale_replay_needed' ELSE 'current' END WHEN old IS NULL THEN 'unscored' WHEN old_stale THEN 'stale_replay_needed' ELSE 'current' END AS aim_state, CASE WHEN aim IS NULL OR ex IS NULL THEN 'unscored' ELSE 'stale_replay_needed' END AS experience_state FROM j""")
def score_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scores count; none of these experience scores names an aim score, so none is current."""
    e = F.col("event_id")
    family = F.when((F.col("event_type") == "error") | (F.col("user_id") % 3 == 0), "legacy").when(F.col("event_type").isin("view", "click"), "aim_fit").otherwise("experience_fit")
    ledger = events(spark, sf_dir).select(e.alias("id"), F.col("user_id").alias("job_id"), family.alias("family"), F.col("ts").alias("created_at"), F.when(e % 6 == 0, F.col("ts")).alias("stale_at"), F.lit(None).cast("string").alias("stale_reason"), (e % 4 != 0).alias("passed"), F.lit(None).cast("long").alias("source_event_id"))
    return authority.staged_authority(ledger).select("job_id", "mode", "aim_state", "experience_state")


@query("""SELECT o_orderkey, CASE WHEN prior = final THEN NULL WHEN requested = 'inbox' AND final = 'inbox' THEN 'user_promote' WHEN requested IN ('passed', 'dismissed') AND final = requested THEN 'user_reject' WHEN final IN ('applied', 'interviewing', 'bookmarked', 'cooldown', 'inbox') THEN 'user_lifecycle' WHEN final = 'pending_af' THEN 'user_rescore' END AS event_type, CASE WHEN score IS NULL THEN 'unscored' WHEN score >= 90 THEN 'priority' WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'moderate' ELSE 'low' END AS tier
FROM (SELECT o_orderkey, list_extract(['inbox', 'passed', 'applied', 'pending_af'], CAST(o_orderkey % 4 AS INT) + 1) AS prior, list_extract(['inbox', 'passed', 'dismissed', 'applied', 'pending_af'], CAST(o_orderkey % 5 AS INT) + 1) AS requested, list_extract(['inbox', 'passed', 'dismissed', 'applied', 'pending_af'], CAST(o_orderkey % 5 AS INT) + 1) AS final, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 101 END AS score FROM orders)""")
def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    final = pick(["inbox", "passed", "dismissed", "applied", "pending_af"])
    event = authority.lifecycle_event(pick(["inbox", "passed", "applied", "pending_af"]), final, final)
    return table(spark, sf_dir, "orders").select("o_orderkey", event["event_type"].alias("event_type"), authority.opportunity_tier(F.when(k % 7 != 0, k % 101)).alias("tier"))


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, length(line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)""")
def located_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = segments.located_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.select("doc_id", "line_no", "start", F.length("line").cast("long").alias("n"))


@query()
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loss-less partition of every text into blocks."""
    return segments.located_blocks(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "block_id", "start", "end")


@query("""SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]{2,}'))) AS BIGINT) AS n_tokens, CAST(len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9+#.-]{2,}')), lambda x: x NOT IN ('the', 'and', 'und', 'que'))) AS BIGINT) AS n_kept FROM documents""")
def distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda stop: F.size(tokens(F.col("text"), stop)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", t([]).alias("n_tokens"), t(["the", "and", "und", "que"]).alias("n_kept"))


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS input_hash FROM customer""")
def bound_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a hash over their fields in canonical order."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return with_hash(c, ["c_name", "c_custkey", "c_mktsegment"]).select("c_custkey", "input_hash")


#: Locations, a form of each kind and near misses, by whether they are in reach. A slash parts options, so that N/A is two places without a name.
IN_REACH = [
    "Minneapolis, MN", "Remote", "remote - usa", "Remote, U.S. only", "Virtual, anywhere USA", "Remote all US", "US - Remote", "USA remote-first", "United States work from home", "United States", "United States of America", "MN", "Remote - Minnesota",
    "Minnesota, USA", "Minnesota, United States - virtual", "Blaine, MN", "Hudson, WI", "River Falls Wisconsin", "Austin, TX or Edina, MN", "London; St. Paul", "Multiple locations", "n locations", "3 Locations", "Not specified", "Unknown", "Unknown location",
    "ＭＮ", "(Remote)", "[St Paul]", "Work at home", "Home-based", "Remotely based", "Distributed", "flexible", "55401", "Remote—US", "Remote - US or London", "", None, "Winona, MN / Plymouth", "Saint Paul | Dallas, TX", "  Eagan  ",
]
OUT_OF_REACH = [
    "Austin, TX", "London", "Duluth, MN", "Worldwide", "Anywhere on earth", "Bloomington, IN", "DE - Berlin", "NL Nieuwegein", "Remote PL", "IN-Indianapolis", "USA distributed", "US - flexible", "Crystal City, VA", "Remote in Texas", "Rochester", "Madison, WI",
    "Canada (remote)", "2 Locations; London", "Portland (OR)", "TX", "Stillwater, OK", "Remote EMEA", "Hudson", "Ohio", "55901", "Minnesotan", "Unknown place", "Toronto or Paris", "all locations", "N/A",
]
PLACES = [(p, True) for p in IN_REACH] + [(p, False) for p in OUT_OF_REACH]
PLACES_SQL = ", ".join(f"({i}, {str(ok).lower()})" for i, (_, ok) in enumerate(PLACES))


@query(f"SELECT c_custkey, passes FROM customer JOIN (VALUES {PLACES_SQL}) v(i, passes) ON c_custkey % {len(PLACES)} = v.i")
def location_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of locations, one for each customer in turn; the SQL holds the verdicts that are expected."""
    place = F.element_at(F.array(*[F.lit(p).cast("string") for p, _ in PLACES]), (F.col("c_custkey") % len(PLACES) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", places.triage(F.lit("Account Manager"), place)["pass"].alias("passes"))
