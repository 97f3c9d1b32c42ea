"""Postings, their queues, assessments and repairs, over the given tables in the part of jobs, events and answers."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import classifiers, identity, paths, places, text
from millrace.operators import arrivals, assessments, dedup, freshness, invalidation, maintenance, queues, requirements
from millrace.plans.registry import query
from millrace.tables import dealt, table


def nth(values: list, n: Column) -> Column:
    """values[n modulo their number]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def nth_sql(values: list, n: str) -> str:
    shown = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in values)
    return f"list_extract([{shown}], CAST({n} % {len(values)} AS INT) + 1)"


STATUS = ["pending_af", "inbox", "passed", "pending_af", "applied"]
SCORING = ["scored", "failed", "queued", "needs_jd"]
ERROR = [None, "JD recovery rejected: page", "other", "Aim Fit could not score this job: x", None, "Experience Fit could not score this job: y", None]
REASON = [None, "Promoted by user: yes", "too far", "Error calling Jina. Manual review required.", "Expired posting", None]
KINDS = ["view", "user_reject", "user_rescore", "view", "ingested", "view", "view"]


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice"))
    n = F.col("id")
    return o.select(
        "id", nth(STATUS, n).alias("status"), nth(SCORING, n).alias("scoring_status"), nth(ERROR, n).alias("score_error"), nth(REASON, n).alias("pass_reason"), nth(["new", "promoted", None], n).alias("fit_category"),
        (n % 11 == 0).alias("context_batched"), F.when(n % 13 == 0, "b").alias("jd_batch"), F.lit(None).cast("string").alias("batch_job"), F.lit(None).cast("string").alias("fit_batch"), (n % 17 == 0).alias("staged"),
        F.when(n % 3 == 0, n % 100).alias("aim_score"), F.when(n % 6 == 0, n % 90).alias("experience_score"), F.concat(F.lit("job "), n).alias("title"), F.lit("C").alias("company"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as events of jobs."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    return li.select(F.col("l_orderkey").alias("job_id"), nth(KINDS, F.col("l_partkey")).alias("event_type"), F.col("l_shipdate").cast("timestamp").alias("at"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate")
    return li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("job_id"), (F.col("l_suppkey") % 5 == 0).alias("suppression_active"), F.when(F.col("l_suppkey") % 10 == 0, F.col("l_shipdate")).alias("cleared_at"), F.lit("X").alias("code"), F.col("l_shipdate").alias("failed_at"))


JOBS_SQL = f"""j AS (SELECT o_orderkey AS id, {nth_sql(STATUS, 'o_orderkey')} AS status, {nth_sql(SCORING, 'o_orderkey')} AS scoring_status, {nth_sql(ERROR, 'o_orderkey')} AS score_error, {nth_sql(REASON, 'o_orderkey')} AS pass_reason, {nth_sql(['new', 'promoted', None], 'o_orderkey')} AS fit_category,
  o_orderkey % 11 = 0 AS context_batched, o_orderkey % 13 = 0 AS has_batch, o_orderkey % 17 = 0 AS staged, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 END AS aim_score, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 90 END AS experience_score FROM orders),
e AS (SELECT l_orderkey AS job_id, {nth_sql(KINDS, 'l_partkey')} AS event_type, l_shipdate AS stamp FROM lineitem),
r AS (SELECT l_orderkey AS job_id, l_shipdate AS failed_at FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 5 = 0 AND l_suppkey % 10 <> 0)"""
AGAIN_SQL = "j.id IN (SELECT job_id FROM e WHERE event_type = 'user_rescore')"
FRESH_SQL = "j.id NOT IN (SELECT job_id FROM e WHERE event_type = 'user_reject')"


@query(f"""WITH {JOBS_SQL} SELECT id FROM j WHERE status IN ('pending_af', 'inbox') AND (id IN (SELECT job_id FROM r) OR (scoring_status = 'failed' AND
  (coalesce(score_error LIKE 'JD recovery rejected:%' OR score_error LIKE 'Aim Fit could not score this job:%' OR score_error LIKE 'Experience Fit could not score this job:%', false) OR coalesce(pass_reason = 'Error calling Jina. Manual review required.', false))))""")
def action_needed_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.log_tab("action_needed", jobs(spark, sf_dir), job_events(spark, sf_dir), receipts(spark, sf_dir), jobs(spark, sf_dir).limit(0)).select("id")


@query(f"""WITH {JOBS_SQL} SELECT id FROM j WHERE status = 'pending_af' AND (({FRESH_SQL} AND coalesce(fit_category <> 'promoted', true) AND (pass_reason IS NULL OR pass_reason NOT LIKE 'Promoted by user:%')) OR {AGAIN_SQL})
  AND scoring_status = 'scored' AND NOT has_batch AND aim_score IS NULL AND NOT staged AND id NOT IN (SELECT job_id FROM r)""")
def aim_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.log_tab("aim_fit", jobs(spark, sf_dir), job_events(spark, sf_dir), receipts(spark, sf_dir), jobs(spark, sf_dir).limit(0)).select("id")


@query(f"""WITH {JOBS_SQL} SELECT id FROM j WHERE status = 'pending_af' AND ({FRESH_SQL} OR {AGAIN_SQL}) AND scoring_status = 'scored' AND NOT staged AND aim_score IS NOT NULL AND experience_score IS NULL AND id % 7 <> 0""")
def experience_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_jobs = jobs(spark, sf_dir)
    return queues.log_tab("experience_fit", all_jobs, job_events(spark, sf_dir), receipts(spark, sf_dir), all_jobs.where("id % 7 = 0")).select("id")


@query(f"""WITH {JOBS_SQL} SELECT id, tab FROM (
  SELECT id, 'context' AS tab FROM j WHERE status = 'passed' AND NOT context_batched AND pass_reason IS NOT NULL AND NOT contains(lower(pass_reason), 'expired')
  UNION ALL SELECT id, 'needs_jd' FROM j WHERE status IN ('pending_af', 'inbox') AND (scoring_status = 'needs_jd' OR has_batch)
  UNION ALL SELECT id, 'local_scoring' FROM j WHERE status IN ('pending_af', 'inbox') AND scoring_status = 'queued' AND NOT has_batch)""")
def log_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, none = jobs(spark, sf_dir), jobs(spark, sf_dir).limit(0)
    tab = lambda n: queues.log_tab(n, j, none, none, none).select("id", F.lit(n).alias("tab"))
    return tab("context").unionByName(tab("needs_jd")).unionByName(tab("local_scoring"))


@query(f"""WITH {JOBS_SQL} SELECT job_id, 'job ' || job_id AS title, failed_at FROM r ORDER BY failed_at DESC, job_id DESC LIMIT 100""")
def newest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest failures that still hold; the limit is the report's."""
    return queues.active_failures(receipts(spark, sf_dir), jobs(spark, sf_dir)).select("job_id", "title", "failed_at")


@query(f"""WITH {JOBS_SQL}, d AS (SELECT event_type, stamp >= TIMESTAMP '1998-06-01' - INTERVAL 1 DAY AS late FROM e)
SELECT (SELECT count(*) FROM j WHERE status = 'pending_af' AND NOT staged) AS waiting, count(*) FILTER (late AND event_type = 'ingested') AS came, CAST(0 AS BIGINT) AS scored, count(*) FILTER (late AND event_type = 'user_rescore') AS put_back FROM d""")
def backlog_of_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.backlog_flow(jobs(spark, sf_dir), job_events(spark, sf_dir), F.lit(dt.datetime(1998, 6, 1)))


def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scores of jobs. Order and line number repeat; with the part they tell any two events apart that differ in what is read here."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    p = F.col("l_partkey")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_orderkey").alias("job_id"), nth(["aim_fit", "experience_fit"], p).alias("family"), F.col("l_shipdate").alias("created_at"),
        F.when(p % 5 == 0, F.col("l_shipdate")).alias("stale_at"), nth(["h1", "h2", "h3"], p).alias("input_hash"), nth(["v1", "v2"], p).alias("prompt_version"), (p % 4 == 0).alias("passed"), nth(STATUS, p).alias("projection"),
    )


SCORES_SQL = f"""s AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id, l_orderkey AS job_id, {nth_sql(['aim_fit', 'experience_fit'], 'l_partkey')} AS family, l_shipdate AS created_at, l_partkey % 5 = 0 AS stale, {nth_sql(['h1', 'h2', 'h3'], 'l_partkey')} AS input_hash,
  {nth_sql(['v1', 'v2'], 'l_partkey')} AS prompt_version, l_partkey % 4 = 0 AS passed, {nth_sql(STATUS, 'l_partkey')} AS projection FROM lineitem),
l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) = 1)"""


@query(f"""WITH {JOBS_SQL}, {SCORES_SQL} SELECT j.id FROM j LEFT JOIN l ON j.id = l.job_id AND NOT l.stale WHERE NOT j.staged AND coalesce(pass_reason NOT LIKE 'Promoted by user%', true) AND (l.prompt_version IS NULL OR l.prompt_version <> 'v2')""")
def stale_active_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness.stale_scores(jobs(spark, sf_dir), score_events(spark, sf_dir), "v2")


@query(f"""WITH {JOBS_SQL}, {SCORES_SQL}, c AS (SELECT j.id, j.id % 4 = 0 AS wanted, coalesce(experience_score, 0) AS x, coalesce(aim_score, 0) AS a FROM j JOIN l ON j.id = l.job_id WHERE NOT l.stale AND NOT l.passed AND l.prompt_version <> 'v2' AND l.created_at >= TIMESTAMP '1996-01-01' AND j.id % 2 = 0)
SELECT id, wanted FROM c WHERE wanted OR a >= 65 OR x >= 70 ORDER BY wanted DESC, x DESC, a DESC, id LIMIT 50""")
def dismissals_to_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded set of dismissals worth another look; the bound is the report's."""
    held = jobs(spark, sf_dir).select("id", F.when(F.col("id") % 4 == 0, "Account Manager").otherwise("Clerk").alias("title"), "aim_score", "experience_score", (F.col("id") % 2 == 0).alias("local_passes"))
    return freshness.worth_another_look(held, score_events(spark, sf_dir), "v2", F.lit(dt.datetime(1996, 1, 1)), 50)


@query(f"""WITH {JOBS_SQL}, {SCORES_SQL}, d AS (SELECT job_id, bool_or(family = 'aim_fit') AS aim, count(DISTINCT family) AS n_families FROM s WHERE NOT stale AND input_hash <> CASE family WHEN 'aim_fit' THEN 'h1' ELSE 'h2' END GROUP BY 1),
n AS (SELECT * FROM s WHERE NOT stale QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) = 1)
SELECT d.job_id, n_families, CASE WHEN j.staged OR j.id IN (SELECT job_id FROM e WHERE event_type = 'user_reject') OR coalesce(n.projection <> j.status, true) THEN 'action_needed' WHEN aim THEN 'requeue_all' ELSE 'requeue_rest' END AS action FROM d JOIN j ON d.job_id = j.id LEFT JOIN n ON n.job_id = d.job_id""")
def score_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = freshness.replay_plan(jobs(spark, sf_dir), score_events(spark, sf_dir), job_events(spark, sf_dir), {"aim_fit": "h1", "experience_fit": "h2"})
    return plan.select("job_id", F.size("families").cast("long").alias("n_families"), "action")


@query(f"""WITH {JOBS_SQL} SELECT id, CASE WHEN aim_score < 60 AND status = 'pending_af' AND {FRESH_SQL} AND id % 7 <> 0 THEN 'dismissed' ELSE status END AS status, aim_score < 60 AND status = 'pending_af' AND {FRESH_SQL} AND id % 7 <> 0 IS TRUE AS applied FROM (SELECT id, status, coalesce(aim_score, 1000) AS aim_score FROM j) j""")
def queue_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting jobs below a score are dismissed, unless a person decided on them or they are leased."""
    held = jobs(spark, sf_dir)
    plan = maintenance.floor_plan(held, job_events(spark, sf_dir), held.where("id % 7 = 0"), 60)
    return maintenance.apply(held.select("id", "status"), plan).select("id", "status", (F.size("applied") > 0).alias("applied"))


@query("""WITH c AS (SELECT c_custkey AS id, c_nationkey, list_extract(['inbox', 'passed', 'inbox', 'interviewing', 'inbox'], CAST(c_custkey % 5 AS INT) + 1) AS status, CASE WHEN c_custkey % 50 = 1 THEN 'applied' WHEN c_custkey % 50 = 6 THEN 'inbox' END AS asked FROM customer),
w AS (SELECT *, coalesce(asked, status) AS wish FROM c), p AS (SELECT c_nationkey, min(id) AS a, max(id) AS b FROM w WHERE wish IN ('applied', 'interviewing') GROUP BY 1)
SELECT id, CASE WHEN wish = 'inbox' AND a IS NOT NULL AND (a <> id OR b <> id) THEN 'cooldown' ELSE wish END AS status FROM w LEFT JOIN p ON w.c_nationkey = p.c_nationkey""")
def company_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs of a company for each nation: an application puts the company's other inbox jobs into cooldown."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    held = c.select(n.alias("id"), nth(["inbox", "passed", "inbox", "interviewing", "inbox"], n).alias("status"), F.concat(F.lit("Company "), F.col("c_nationkey"), F.lit(", Inc.")).alias("company"))
    asked = c.where(n % 50 == 1).select(n.alias("id"), F.lit("applied").alias("status")).unionByName(c.where(n % 50 == 6).select(n.alias("id"), F.lit("inbox").alias("status")))
    return maintenance.status_change(held, asked, F.lit(dt.datetime(2026, 1, 1)))[0].select("id", "status")


TITLES = ["Account Executive", "Warehouse Manager", "Warehouse Worker", "Registered Nurse", "C++ Lead", "Product Owner", "Verfahrensmechaniker", "Unknown Title", "Team Member, software", "General Counsel, operations", "TS/SCI Analyst", "Head Lifeguard"]
REASONS = [classifiers.PASSED, classifiers.PASSED, "Hourly/Service/Hospitality role rejected", "Healthcare/Clinical role rejected", "Software Engineering role rejected", "Product Management role rejected", classifiers.FOREIGN, "Unknown/placeholder title rejected", classifiers.PASSED, classifiers.PASSED, "Military/Defense non-PM role rejected", "Fitness/Recreation role rejected"]


@query(f"SELECT c_custkey, {nth_sql(REASONS, 'c_custkey')} AS reason FROM customer")
def title_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of twelve titles, one for each customer in turn; the SQL holds the verdicts that are expected."""
    return table(spark, sf_dir, "customer").select("c_custkey", classifiers.prefilter(nth(TITLES, F.col("c_custkey")), F.lit("Acme"), F.lit(False))["reason"].alias("reason"))


PATHS = ["/job/Dallas-TX/x", "/job/Phoenix-Office/x", "/job/PA-Fort-Washington/x", "/job/Virtual---California/x", "/job/USA---New-Jersey/x", "/job/12-Main-St/x", "/job/Plainville/x", "/jobs/x"]
CITIES = ["Dallas, TX", "Phoenix", "Fort Washington, PA", "Virtual, California", None, None, "Plainville", None]


@query(f"SELECT s_suppkey, {nth_sql(CITIES, 's_suppkey')} AS place FROM supplier")
def path_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", paths.path_place(nth(PATHS, F.col("s_suppkey"))).alias("place"))


BASES = ["You must reside in Minnesota", "You must live in Texas", "We like people", "Must be based in London", "This hybrid role is in Denver"]


@query(f"SELECT s_suppkey, {nth_sql(['compatible', 'incompatible', 'unknown', 'incompatible', 'incompatible'], 's_suppkey')} AS work_base FROM supplier")
def work_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", places.work_base(F.array(nth(BASES, F.col("s_suppkey")))).alias("work_base"))


@query("""SELECT p_partkey, sha256('{"kind":"aim_source_identity_v1","sourceJdHash":"' || sha256(p_name) || '","trustedMetadataHash":"' || sha256(p_brand) || '"}') AS source_identity, 'criterion-' || substr(sha256(sha256(p_name) || chr(0) || 'required' || chr(0) || p_size || chr(0) || (p_size + 5)), 1, 32) AS criterion,
'req-' || substr(sha256('preferred' || chr(0) || lower(p_type)), 1, 24) AS requirement FROM part""")
def derived_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda c: F.sha2(F.col(c), 256)
    return table(spark, sf_dir, "part").select(
        "p_partkey", identity.identity("aim_source_identity_v1", sourceJdHash=h("p_name"), trustedMetadataHash=h("p_brand")).alias("source_identity"),
        identity.criterion_id(h("p_name"), F.lit("required"), F.col("p_size"), F.col("p_size") + 5).alias("criterion"), identity.requirement_id(F.concat(F.col("p_type"), F.lit(".")), F.lit("preferred")).alias("requirement"),
    )


def assessed(spark: SparkSession, sf_dir: str, said: Column, question: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as postings that say one thing, which is quoted in answer to one question."""
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select(F.col("o_orderkey").alias("job_id"), said.alias("jd"), question.alias("question"))
    posting = o.select("job_id", "jd", F.lit("Acme").alias("company"), F.lit("Seller").alias("title"), F.lit("Edina, MN").alias("location"))
    answers = o.select("job_id", "question", F.lit("yes").alias("answer"), F.array(F.lit("e")).alias("evidence"))
    span = F.array(F.struct(F.lit(0).alias("start"), F.length("jd").alias("end")))
    return posting, answers, o.select("job_id", F.lit("e").alias("evidence_id"), F.col("jd").alias("quote"), F.lit("original_jd").alias("source"), span.alias("occurrences"))


PAY = assessments.Policy(floor_cents=10_000_000, pay_tiers=[(15_000_000, 20), (10_000_000, 10)])


@query("""WITH o AS (SELECT o_orderkey AS job_id, 50000 + o_orderkey % 1000 * 120 AS low, o_orderkey % 4 AS kind FROM orders)
SELECT job_id, CASE WHEN kind = 3 THEN 'non_comparable' ELSE 'comparable' END AS state, CASE kind WHEN 0 THEN low * 100 WHEN 1 THEN low * 100 WHEN 2 THEN low * 1200 END AS lower_cents, CASE kind WHEN 0 THEN (low + 5000) * 100 WHEN 1 THEN low * 100 WHEN 2 THEN low * 1200 END AS upper_cents,
 CASE WHEN kind = 0 THEN CASE WHEN low + 5000 < 100000 THEN 'below' ELSE 'at_or_above' END ELSE 'fail_open' END AS floor_outcome,
 CAST(CASE WHEN kind = 3 THEN 0 WHEN (CASE kind WHEN 0 THEN low + 5000 WHEN 1 THEN low ELSE low * 12 END) >= 150000 THEN 20 WHEN (CASE kind WHEN 0 THEN low + 5000 WHEN 1 THEN low ELSE low * 12 END) >= 100000 THEN 10 ELSE 0 END AS INTEGER) AS points FROM o""")
def pay_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    low = F.lit(50_000) + n % 1000 * 120
    shown = lambda c: F.format_number(c, 0)
    said = F.when(n % 4 == 0, F.concat(F.lit("Total cash compensation USD "), shown(low), F.lit(" - USD "), shown(low + 5000), F.lit(" per year"))).when(n % 4 == 1, F.concat(F.lit("Base salary USD "), shown(low), F.lit(" annually"))).when(n % 4 == 2, F.concat(F.lit("Base pay of USD "), shown(low), F.lit(" monthly"))).otherwise(F.concat(F.lit("Base salary $"), shown(low), F.lit(" annually")))
    question = F.when(n % 4 == 0, "S2.CP.Q05").otherwise("S2.CP.Q01")
    made = assessments.compensation(*assessed(spark, sf_dir, said, question), PAY)
    return made.select("job_id", "state", "lower_cents", "upper_cents", "floor_outcome", "points")


ROAD = assessments.Policy(lower_tiers=[(1, 24, 2), (25, 49, 6), (50, 100, 10)], upper_tiers=[(1, 24, 1), (25, 49, 4), (50, 100, 8)])


@query("""WITH o AS (SELECT o_orderkey AS job_id, CAST(10 + o_orderkey % 50 AS INTEGER) AS low, o_orderkey % 4 AS kind FROM orders),
b AS (SELECT *, CASE kind WHEN 0 THEN low WHEN 1 THEN low WHEN 2 THEN 0 END AS lower, CASE kind WHEN 0 THEN low + 20 WHEN 1 THEN 100 WHEN 2 THEN low END AS upper FROM o)
SELECT job_id, CASE WHEN kind = 3 THEN 'ambiguous' ELSE 'comparable' END AS state, lower, upper, CAST(CASE WHEN kind = 3 THEN 0 ELSE 3 + greatest(CASE WHEN kind = 2 THEN 0 WHEN lower < 25 THEN 2 WHEN lower < 50 THEN 6 ELSE 10 END, CASE WHEN kind = 1 THEN 0 WHEN upper < 25 THEN 1 WHEN upper < 50 THEN 4 ELSE 8 END) END AS INTEGER) AS points FROM b""")
def travel_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    low = (F.lit(10) + n % 50).cast("string")
    said = F.when(n % 4 == 0, F.concat(low, F.lit("%-"), (F.lit(30) + n % 50).cast("string"), F.lit("% travel"))).when(n % 4 == 1, F.concat(F.lit("travel at least "), low, F.lit("%"))).when(n % 4 == 2, F.concat(F.lit("travel up to "), low, F.lit("%"))).otherwise(F.concat(F.lit("travel around "), low, F.lit("%")))
    made = assessments.travel(*assessed(spark, sf_dir, said, F.lit("S2.TR.Q01")), ROAD)
    return made.select("job_id", "state", "lower", "upper", "points")


CROSSWALK = [(0, "S2.A", "S2.X.Q01"), (1, "S2.B", "S2.X.Q01"), (2, "S2.C", "S2.CML.Q15"), (3, "S2.B", "S2.CML.Q14"), (4, "S2.D", "S2.CML.Q02"), (5, "S2.A", "S2.CML.Q06")]


@query("""WITH q AS (SELECT DISTINCT l_orderkey AS job_id, list_extract(['S2.A', 'S2.B', 'S2.C', 'S1.Q01', 'S2.D'], CAST(l_partkey % 5 AS INT) + 1) AS question FROM lineitem), y AS (SELECT job_id, bool_or(question = 'S2.A') AS a, bool_or(question = 'S2.B') AS b, bool_or(question = 'S2.C') AS c, bool_or(question = 'S2.D') AS d, bool_or(question = 'S1.Q01') AS s FROM q GROUP BY 1)
SELECT job_id, unnest(['S2.X.Q01', 'S2.CML.Q15', 'S2.CML.Q14', 'S2.CML.Q02', 'S2.CML.Q06']) AS question, unnest([a OR b, c, b OR c, d OR (c AND NOT a), a]) AS is_yes FROM y UNION ALL SELECT job_id, 'S1.Q01', true FROM y WHERE s""")
def projected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as answers: facts derived from them by a crosswalk."""
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), nth(["S2.A", "S2.B", "S2.C", "S1.Q01", "S2.D"], F.col("l_partkey")).alias("question")).distinct()
    answers = asked.select("job_id", "question", F.lit("yes").alias("answer"), F.array(F.col("question")).alias("evidence"))
    made = assessments.projected(answers, spark.createDataFrame(CROSSWALK, "pos int, source string, target string"))
    return made.select("job_id", "question", (F.col("answer") == "yes").alias("is_yes"))


SCREEN = assessments.Policy(bands=[("low", "Low", 0, 59), ("high", "High", 60, 100)], aliases={"former": ["Company 3, Inc."], "rival": ["Company 7"]}, kills=["S1.Q01"], agency_words=["insurance agency"])


@query("""SELECT c_custkey AS job_id, CASE WHEN c_nationkey IN (3, 7) THEN 'local_policy_kill' WHEN c_custkey % 4 = 0 THEN 'factual_screen_kill' WHEN c_custkey % 3 = 0 THEN 'no_score' ELSE 'scored_survivor' END AS variant,
CASE WHEN c_nationkey NOT IN (3, 7) AND c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 100 < 60 THEN 'low' ELSE 'high' END END AS band FROM customer""")
def screened_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), "c_nationkey")
    held = c.select("job_id", F.lit("").alias("jd"), F.concat(F.lit("COMPANY "), F.col("c_nationkey"), F.lit(" LLC")).alias("company"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("location"))
    none = F.array().cast("array<string>")
    answers = c.select("job_id", F.lit("S1.Q01").alias("question"), F.when(F.col("job_id") % 4 == 0, "yes").otherwise("no").alias("answer"), none.alias("evidence"))
    evidence = c.limit(0).select("job_id", F.lit("").alias("evidence_id"), F.lit("").alias("quote"), F.lit("").alias("source"), F.array().cast("array<struct<start:int,end:int>>").alias("occurrences"))
    holistic = c.where("job_id % 3 <> 0").select("job_id", (F.col("job_id") % 100).cast("int").alias("score"), F.lit("r").alias("rationale"))
    return assessments.results(held, answers, evidence, holistic, SCREEN).select("job_id", "variant", F.col("band.code").alias("band"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN -1 - c_custkey WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 5 = 0 THEN c_custkey + 10000000 ELSE c_custkey + 20000000 END AS match,
CASE WHEN c_custkey % 7 = 0 THEN 'description' WHEN c_custkey % 3 = 0 THEN 'identity' WHEN c_custkey % 5 = 0 THEN 'description' ELSE 'syndication' END AS why FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0""")
def held_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as incoming postings that all share a first title word and a company's beginning. Held are, for some, the posting of the same id at
    the source, copies with a longer title at no place (one of them older) and elsewhere, one with a shorter title at the same place, and a syndicator's
    copy; for all, a copy that is too old. Of equally new ones the least id is taken."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    k, now = F.col("id"), F.lit(dt.datetime(2026, 1, 1))
    duties = F.repeat(F.concat(F.lit("duty "), k, F.lit(" and more of it ")), 30)

    def post(rows: DataFrame, id_=k, title=F.lit(""), company=F.concat(F.lit("Company "), k % 10), place="Edina, MN", description=duties, source="feed", source_id=k.cast("string"), days=0) -> DataFrame:
        t = F.concat(F.lit("Seller "), k, title)
        made = rows.select(id_.alias("id"), t.alias("title"), company.alias("company"), F.lit(place).alias("location"), description.alias("description"), F.lit(None).cast("string").alias("url"), F.lit(source).alias("source"), source_id.alias("source_id"))
        return made.withColumn("created_at", now - F.make_dt_interval(days=F.lit(days)))

    none = F.lit(None).cast("string")
    kinds = [
        post(c.where("id % 3 = 0"), description=F.lit("short")),
        post(c.where("id % 5 = 0"), k + 10_000_000, F.lit(" west coast"), place="", source="other", source_id=none),
        post(c.where("id % 5 = 0"), k + 40_000_000, F.lit(" west coast"), place="", source="other", source_id=none, days=9),
        post(c.where("id % 5 = 0"), k + 50_000_000, F.lit(" west coast"), place="Austin, TX", source="other", source_id=none),
        post(c.where("id % 7 = 0"), -1 - k, source="third", source_id=none),
        post(c.where("id % 11 = 0"), k + 20_000_000, F.lit(" west"), company=F.lit("Jobgether"), place="Austin, TX", source="fourth", source_id=none),
        post(c, k + 60_000_000, source="late", days=60),
    ]
    held = reduce(DataFrame.unionByName, kinds)
    return dedup.matches_held(post(c, title=F.lit(" west")).drop("created_at"), held, now)


FIELDS = [["title", "url"], ["url", "source", "url"], []]


@query(f"""WITH {JOBS_SQL}, {SCORES_SQL}, c AS (SELECT o_orderkey AS job_id, o_orderkey % 3 = 0 AS extracts, 'job-input-edited:' || CASE o_orderkey % 3 WHEN 0 THEN 'title,url' WHEN 1 THEN 'source,url' ELSE 'forced_rescore' END AS reason FROM orders WHERE o_orderkey % 4 = 0),
n AS (SELECT * FROM s WHERE NOT stale QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) = 1),
b AS (SELECT l_suppkey, min(job_id) AS job_id FROM lineitem JOIN c ON l_orderkey = job_id WHERE l_linenumber % 2 = 0 AND l_suppkey % 3 = 0 GROUP BY 1)
SELECT 'event' AS ledger, s.id, job_id, 'stale' AS action, reason FROM s JOIN c USING (job_id) WHERE NOT stale
UNION ALL SELECT 'artifact', CAST(job_id AS VARCHAR), job_id, 'stale', reason FROM c WHERE job_id % 5 <> 0
UNION ALL SELECT 'extraction', CAST(job_id AS VARCHAR), job_id, 'stale', reason FROM c WHERE job_id % 7 <> 0 AND extracts
UNION ALL SELECT 'batch', CAST(l_suppkey AS VARCHAR), job_id, 'superseded', reason FROM b JOIN c USING (job_id)
UNION ALL SELECT 'job', CAST(j.id AS VARCHAR), j.id, 'requeued', reason FROM c JOIN j ON j.id = c.job_id JOIN n ON n.job_id = c.job_id WHERE NOT j.staged AND n.projection = j.status AND j.id NOT IN (SELECT job_id FROM e WHERE event_type = 'user_reject')""")
def edit_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of every fourth order's job: what becomes stale in five ledgers, and why."""
    held = jobs(spark, sf_dir)
    k = F.col("id")
    changes = held.where("id % 4 = 0").select(k.alias("job_id"), F.element_at(F.array(*[F.array(*map(F.lit, f)).cast("array<string>") for f in FIELDS]), (k % 3 + 1).cast("int")).alias("fields"))
    of_jobs = lambda by: held.select(k, k.alias("job_id"), F.when(k % by == 0, F.lit(dt.datetime(2026, 1, 1))).alias("stale_at"))
    li = table(spark, sf_dir, "lineitem")
    items = li.select(F.col("l_suppkey").alias("batch_id"), F.col("l_orderkey").alias("job_id"), F.when(F.col("l_linenumber") % 2 == 0, "leased").otherwise("done").alias("status"))
    batches = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "exported").otherwise("imported").alias("status"))
    return invalidation.cascade(changes, {"event": score_events(spark, sf_dir), "artifact": of_jobs(5), "extraction": of_jobs(7)}, items, batches, held, job_events(spark, sf_dir))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 10 WHEN 0 THEN 'new' WHEN 5 THEN 'new' WHEN 7 THEN 'new' WHEN 1 THEN 'source_observation' WHEN 6 THEN 'source_observation' WHEN 2 THEN 'stable_identity' WHEN 8 THEN 'stable_identity' WHEN 3 THEN 'enriched_stable_identity' ELSE 'concurrent_identity' END AS kind,
CASE o_orderkey % 10 WHEN 2 THEN o_orderkey - 2 WHEN 3 THEN o_orderkey - 3 WHEN 4 THEN o_orderkey - 4 WHEN 8 THEN o_orderkey - 1 WHEN 9 THEN -o_orderkey END AS match FROM orders""")
def arriving_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as arriving postings, ten of which belong together: one from a feed, one again, copies by other feeds, at once and after enrichment, one that differs
    in its source's spelling, another text, one observed before, two at the address of a copy, and one whose identity an old posting has."""
    k, none, now = F.col("o_orderkey"), F.lit(None).cast("string"), F.lit(dt.datetime(2026, 1, 1))
    o = dealt(table(spark, sf_dir, "orders").select("o_orderkey")).withColumn("b", F.floor(k / 10).cast("string"))
    pick = lambda default, **by: F.element_at(F.array(*[by.get(f"r{i}", default) for i in range(10)]), (k % 10 + 1).cast("int"))
    words = lambda what: F.repeat(F.concat(F.lit(f"{what} "), F.col("b"), F.lit(" and more of it ")), 30)
    lone, text_, address = F.concat(F.lit("short "), k), words("duty"), F.concat(F.lit("https://jobs.example.com/jobs/"), F.col("b"), F.lit("-opening"))
    feed, own = F.lit("feed"), F.concat(F.lit("s"), F.col("b"))
    rows = o.select(
        k.alias("id"), k.alias("turn"), F.lit("Seller").alias("title"), F.concat(F.lit("Company "), F.col("b")).alias("company"), F.lit("Edina, MN").alias("location"), pick(lone, r0=text_, r1=text_, r2=text_, r5=words("task")).alias("description"),
        pick(none, r2=address, r7=address, r8=address).alias("url"), pick(F.concat(F.lit("other"), k % 10), r0=feed, r1=feed, r4=F.lit("FEED"), r6=F.lit("past"), r9=F.lit("old")).alias("source"), pick(F.concat(F.lit("id"), k), r0=own, r1=own, r4=F.upper(own)).alias("source_id"), pick(lone, r0=text_, r1=text_, r2=text_, r3=text_, r5=words("task")).alias("d"),
    )
    final = {"final_title": F.lit("Seller"), "final_company": F.col("company"), "final_description": F.col("d"), "final_url": F.col("url")}
    held = rows.where("id % 10 = 9").select((-F.col("id")).alias("id"), "title", "company", "location", F.lit("gone").alias("description"), "url", "source", "source_id").withColumn("created_at", now - F.make_dt_interval(days=F.lit(99)))
    seen = rows.where("id % 10 = 6").select("source", "source_id")
    return arrivals.resolve(rows.withColumns(final).drop("d"), held, seen, now)


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9+#-]+', ' ', 'g')) AS title, coalesce(nullif(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'all') AS family, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS stem FROM part""")
def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.role_title(F.col("p_name")).alias("title"), text.query_key(F.col("p_type")).alias("family"), text.company_stem(F.col("p_brand")).alias("stem"))


NEEDS = ["Valid driver's license", "Must pass a background check", "RN license", "Design partner certification programs", "Five years as a regional manager", "Lead a team", "P&L ownership", "Own national accounts", "Bachelor degree", "Curiosity"]
SCOPES = ["drivers_license", "administrative_eligibility", "personal_credential", "partner_certification_program", "formal_management_title_tenure", "people_leadership", "financial_authority", "enterprise_account_ownership", "bachelors_degree", "unrestricted"]


@query(f"SELECT c_custkey, {nth_sql(SCOPES, 'c_custkey')} AS scope, CASE WHEN c_custkey % 10 < 2 THEN 'administrative_only' ELSE 'none' END AS administrative FROM customer")
def requirement_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = requirements.requirement_scope(nth(NEEDS, F.col("c_custkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", found["scope"].alias("scope"), found["administrative"].alias("administrative"))


@query("""WITH q AS (SELECT DISTINCT l_orderkey AS job_id, list_extract(['A', 'B', 'C', 'D', 'E'], CAST(l_partkey % 5 AS INT) + 1) AS question FROM lineitem), y AS (SELECT job_id, bool_or(question = 'A') AS a, bool_or(question = 'B') AS b, bool_or(question IN ('C', 'D')) AS c FROM q GROUP BY 1)
SELECT job_id, unnest(['A', 'B', 'C', 'D']) AS question FROM y WHERE a AND NOT (b AND c)""")
def broken_answer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as answers: questions of a rule (A needs B and one of C and D) that the answers break."""
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), nth(["A", "B", "C", "D", "E"], F.col("l_partkey")).alias("question"), F.lit("yes").alias("answer")).distinct()
    return requirements.broken_closures(answers, spark.createDataFrame([("A", [["B"], ["C", "D"]])], "antecedent string, all array<array<string>>"))


@query("""SELECT o_orderkey, CAST(unnest([1, 2, 3]) AS INTEGER) AS number, unnest([CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unsupported' END, 'yes', 'unsupported']) AS answer, unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'quote ' || o_orderkey ELSE '' END, 'a' || chr(10) || 'b', '']) AS evidence FROM orders""")
def numbered_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as replies to three questions: one answered in line, one with its evidence below, one left out."""
    n = F.col("o_orderkey")
    first = F.when(n % 3 == 0, F.concat(F.lit("1. Yes - quote "), n)).when(n % 3 == 1, "1) no").otherwise("| 1 | not found |")
    replies = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(first, F.lit("\n2. yes: a\n b\n")).alias("reply"))
    return requirements.numbered_answers(replies, "o_orderkey", "reply", 3, {"yes": "yes", "no": "no", "not found": "unsupported"}, "unsupported")


@query("""SELECT c_custkey, unnest(['Cold calls of ' || c_custkey, 'Staffing firms']) AS rule, unnest(['selling_motion', 'employer']) AS dimension, unnest([NULL, CASE WHEN c_custkey % 2 = 0 THEN 'too broad' END]) AS conflict FROM customer""")
def preference_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("DO REJECT:\n- Cold calls of "), F.col("c_custkey"), F.lit("\n- Expired posts\nPREFER:\n- Travel\nREJECT: Staffing firms"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", said.alias("t"))
    made = requirements.preference_rules(rows, "c_custkey", "t", [("^Staffing", "too broad")])
    return made.select("c_custkey", "rule", "dimension", F.when(F.col("c_custkey") % 2 == 0, F.col("conflict")).alias("conflict"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'rejected_hard_stop' ELSE 'survivor' END AS decision, CAST(CASE WHEN p_size % 5 <> 0 THEN list_extract([40, 34, 26], CAST(p_partkey % 3 AS INT) + 1) + 12 + 14 + list_extract([15, 0], CAST(p_partkey % 2 AS INT) + 1) END AS INTEGER) AS score FROM part""")
def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    stops = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("inside_sales"))).otherwise(F.array().cast("array<string>"))
    bands = {"coreWork": nth(["exceptional_archetype", "strong_fit", "unclear"], n), "buildingAutonomy": F.lit("unclear"), "productIndustry": F.lit("interesting_technology"), "travel": nth(["international", "none_or_unstated"], n)}
    d = requirements.rubric_decision(stops, bands)
    return table(spark, sf_dir, "part").select("p_partkey", d["decision"].alias("decision"), d["score"].alias("score"))


@query("SELECT l_orderkey AS parent_id, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1")
def nested_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items nested, parted into the rows of two tables; here the children's sums by parent."""
    nested = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct("l_partkey", "l_linenumber")).alias("items"))
    return requirements.with_children(nested, "id", "items")[1].groupBy("parent_id").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))
