"""Assessments, queues, freshness, maintenance and matching on small fixtures."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import classifiers, identity, paths, places, text
from millrace.operators import assessments, dedup, freshness, maintenance, queues
from millrace.tables import let_workers_import
from tests.core.test_functions import many, one

POLICY = assessments.Policy(
    floor_cents=10_000_000, pay_tiers=[(20_000_000, 20), (15_000_000, 10)], lower_tiers=[(1, 24, 2), (25, 49, 6), (50, 100, 10)], upper_tiers=[(1, 24, 1), (25, 49, 4), (50, 100, 8)],
    lexemes={"frequent": 8, "occasional": 3}, other_travel=1, bands=[("low", "Low", 0, 59), ("high", "High", 60, 100)], aliases={"former": ["Acme, Inc."], "rival": ["Zeta LLC"]}, kills=["S1.Q01", "S1.Q03"],
    agency_words=["insurance agency"], local_words=["local office"], weak_agency_words=["carrier"], agency_aliases=["Smith Agency"],
)


@pytest.fixture(autouse=True)
def importable(spark):
    let_workers_import(spark)


def case(spark, quoted, jobs=None):
    """Tables of jobs whose posting is its quotes. quoted: (job, question, quote or None for a plain yes)."""
    texts, answers, evidence = {}, [], []
    for n, (job, question, quote) in enumerate(quoted):
        if quote is not None:
            start = len(texts.get(job, ""))
            texts[job] = texts.get(job, "") + quote + "\n"
            evidence.append((job, f"e{n}", quote, "original_jd", [(start, start + len(quote))]))
        answers.append((job, question, "yes", [f"e{n}"] if quote is not None else []))
    rows = jobs or [(j, texts.get(j, ""), "Acme", "Seller", "Minneapolis, MN") for j in sorted({q[0] for q in quoted})]
    return (
        spark.createDataFrame(rows, "job_id long, jd string, company string, title string, location string"),
        spark.createDataFrame(answers, "job_id long, question string, answer string, evidence array<string>"),
        spark.createDataFrame(evidence or [], "job_id long, evidence_id string, quote string, source string, occurrences array<struct<start int, end int>>"),
    )


def test_compensation(spark):
    tables = case(spark, [
        (1, "S2.CP.Q05", "Total cash compensation USD 90,000 - USD 95,500 per year"),
        (2, "S2.CP.Q01", "Base salary USD 160k annually"),
        (3, "S2.CP.Q01", "Base salary USD 160,000 annually"), (3, "S2.CP.Q04", "OTE USD 120,000 per year"),
        (4, "S2.CP.Q01", "Base salary 100,000 to 120,000 or 140,000 USD yearly"),
        (5, "S2.CP.Q07", "Commission is paid"),
        (6, "S2.CP.Q02", "Pay USD 50 per hour, full-time"), (6, "S2.CP.Q09", "Bonus USD 10,000 annually"), (6, "S2.CP.Q17", "Base and bonus make up the entire cash compensation"),
        (7, "S2.CP.Q05", "Total pay USD 90,000 annually"), (7, "S2.CP.Q11", "uncapped"),
        (8, "S1.Q01", "no pay here"),
        (9, "S2.CP.Q01", "Salary USD 200,000 annually in Minneapolis"), (9, "S2.CP.Q01", "Salary USD 300,000 annually in Denver"), (9, "S2.CP.Q16", "differs by place"),
    ])
    got = {r.job_id: (r.state, r.lower_cents, r.upper_cents, r.total_upper_cents, r.reference_cents, r.proven_cents, r.floor_outcome, r.points, r.reason) for r in assessments.compensation(*tables, POLICY).collect()}
    assert got[1] == ("comparable", 9_000_000, 9_550_000, 9_550_000, 9_550_000, None, "below", 0, "complete_total_cash_below_floor")
    assert got[2] == ("comparable", 16_000_000, 16_000_000, None, 16_000_000, 16_000_000, "fail_open", 10, "comparable")
    assert got[3][0] == "conflicting" and got[3][-2:] == (0, "conflicting_disclosures")
    assert got[4][0] == "non_comparable" and got[5][0] == "non_comparable" and got[8] == ("missing", None, None, None, None, None, "fail_open", 0, "missing")
    assert got[6] == ("comparable", 1_000_000, 10_400_000, 11_400_000, 10_400_000, 10_400_000, "at_or_above", 0, "comparable")
    assert got[7][3] is None and got[7][6] == "fail_open"
    assert got[9] == ("comparable", 20_000_000, 20_000_000, None, 20_000_000, 20_000_000, "fail_open", 20, "comparable")
    jobs, answers, evidence = case(spark, [(1, "S2.CP.Q01", "Base salary USD 160,000 annually")])
    hidden = jobs.withColumn("jd", F.concat("jd", F.lit("Bonus of $ 5,000 as well")))
    assert assessments.compensation(hidden, answers, evidence, POLICY).first().reason == "coverage_ambiguous"
    records = {r.component: r for r in assessments.pay_records(*tables).where("job_id = 6").collect()}
    assert records["fixed_periodic"].year_upper == 50 * 2080 * 100 and records["fixed_periodic"].period == "hourly_fixed"


def test_travel(spark):
    tables = case(spark, [
        (1, "S2.TR.Q01", "25% - 50% travel"), (1, "S2.TR.Q09", None),
        (2, "S2.TR.Q01", "travel up to 20%"), (2, "S2.TR.Q01", "travel at least 30%"),
        (3, "S2.TR.Q02", "no travel"), (4, "S2.TR.Q03", "frequent visits"), (4, "S2.TR.Q12", None),
        (5, "S2.TR.Q01", "travel about 30%"), (6, "S2.TR.Q02", "no travel"), (6, "S2.TR.Q05", None),
        (7, "S1.Q01", "nothing said"), (8, "S2.TR.Q01", "travel 120%"), (9, "S2.TR.Q01", "travel 0%"),
    ])
    got = {r.job_id: (r.state, r.positive, r.lower, r.upper, r.points, r.reason) for r in assessments.travel(*tables, POLICY).collect()}
    assert got[1] == ("comparable", True, 25, 50, 15 + 8 + 1, "travel_scored")
    assert got[2] == ("conflicting", False, None, None, 0, "travel_source_conflict") and got[6][0] == "conflicting"
    assert got[3] == ("missing", False, None, None, 0, "explicit_zero_travel") and got[4] == ("qualitative", True, None, None, 2 + 8 + 3, "travel_scored")
    assert got[5][0] == got[8][0] == "ambiguous" and got[7] == ("missing", False, None, None, 0, "travel_not_supported")
    assert got[9] == ("comparable", False, 0, 0, 0, "explicit_zero_travel")
    jobs, answers, evidence = case(spark, [(1, "S2.TR.Q01", "travel 25%")])
    assert assessments.travel(jobs.withColumn("jd", F.concat("jd", F.lit("and travel up to 80% later"))), answers, evidence, POLICY).first().state == "ambiguous"


def test_results(spark):
    rows = [(1, "", "Acme", "t", None), (2, "", "Other", "t", None), (3, "", "Smith Agency", "t", "Edina, MN"), (4, "", "Other", "t", None), (5, "", "Other", "t", None), (6, "", "ZETA", "t", None)]
    tables = case(spark, [(2, "S1.Q03", None), (3, "S1.Q06", "An insurance agency"), (4, "S1.Q06", "a carrier")], rows)
    holistic = spark.createDataFrame([(4, 75, "good"), (5, 400, "odd"), (3, 90, "x")], "job_id long, score int, rationale string")
    got = {r.job_id: (r.variant, r.codes, r.score, r.band and r.band.code) for r in assessments.results(*tables, holistic, POLICY).collect()}
    assert got == {1: ("local_policy_kill", ["former"], None, None), 2: ("factual_screen_kill", ["S1.Q03"], None, None), 3: ("factual_screen_kill", ["S1.Q06"], None, None), 4: ("scored_survivor", None, 75, "high"), 5: ("no_band", None, None, None), 6: ("local_policy_kill", ["rival"], None, None)}
    assert {r.variant for r in assessments.results(*tables, holistic, POLICY, final=False).where("job_id > 3 and job_id < 6").collect()} == {"continue_to_complete"}
    screen = {r.job_id: r for r in assessments.screened(*tables, POLICY).collect()}
    assert screen[4].agency_state == "not_local_or_not_agency" and screen[2].location_state == "incompatible" and screen[1].agency_state is None


def test_projection(spark):
    answers = spark.createDataFrame([(1, "A", "yes", ["e1", "e2"]), (1, "B", "yes", ["e2", "e3"]), (1, "S1.Q01", "no", []), (1, "C", "no", ["e9"]), (2, "D", "yes", ["d"])], "job_id long, question string, answer string, evidence array<string>")
    cross = spark.createDataFrame([(0, "B", "S2.X.Q01"), (1, "A", "S2.X.Q01"), (2, "C", "S2.X.Q02"), (3, "D", "S2.CML.Q15"), (4, "C", "S2.CML.Q14"), (5, "C", "S2.CML.Q02"), (6, "C", "S2.CML.Q06")], "pos int, source string, target string")
    got = {(r.job_id, r.question): (r.answer, r.evidence) for r in assessments.projected(answers, cross).collect()}
    assert got[1, "S2.X.Q01"] == ("yes", ["e2", "e3", "e1"]) and got[1, "S2.X.Q02"] == ("unsupported", []) and got[1, "S1.Q01"] == ("no", [])
    assert got[2, "S2.CML.Q14"] == got[2, "S2.CML.Q02"] == ("yes", ["d"]) and got[2, "S2.CML.Q06"] == ("unsupported", []) and len(got) == 13


def test_labels(spark):
    v = [F.lit(x) for x in (9_000_000, 9_550_000)]
    null = F.lit(None).cast("string")
    df = spark.range(1)
    pay = df.select(assessments.pay_label(F.lit("comparable"), *v, F.lit("USD"), null).alias("a"), assessments.pay_label(F.lit("missing"), F.lit(None).cast("long"), F.lit(None).cast("long"), null, null).alias("b"), assessments.pay_label(F.lit("conflicting"), F.lit(None).cast("long"), F.lit(None).cast("long"), null, F.lit("conflicting_disclosures")).alias("c")).first()
    assert tuple(pay) == ("$90,000–$95,500/annual", None, "Compensation stated · conflicting disclosures")
    t = lambda lo, hi, a, b: assessments.travel_label(F.lit("comparable"), F.lit(lo), F.lit(hi), F.lit(a), F.lit(b), null)["label"]
    assert tuple(df.select(t(0, 20, False, True).alias("a"), t(30, 100, True, False).alias("b"), t(10, 20, True, True).alias("c"), t(10, 10, True, True).alias("d")).first()) == ("Up to 20%", "At least 30%", "10–20%", "10%")


def test_names_and_identities(spark):
    v = F.col("v1")
    assert many(spark, text.role_title(v), ["Sr. PBM – Key Mgr", "C++ / C# CSM"]) == ["sr partner business manager - key manager", "c++ c# customer success manager"]
    assert many(spark, text.query_key(v), ["Account Mgr!", "", None]) == ["account_manager", "all", "all"]
    assert many(spark, text.employer(v), ["Müller & Söhne, Inc.", None]) == ["müller and söhne", ""] and text.employer_text("Müller & Söhne, Inc.") == "müller and söhne"
    assert many(spark, text.company_stem(v), ["Prompt Health, Inc.", "Inc"]) == ["prompt health", "inc"]
    assert many(spark, text.scoring_text(v), ["a\r\nb\rc", "x\x00"]) == ["a\nb\nc", None]
    df = spark.createDataFrame([("Äpfel",), ("zebra",), ("apfel2",), ("Banana",)], "v1 string")
    assert [r.v1 for r in df.orderBy(text.in_reading_order(v)).collect()] == ["Äpfel", "apfel2", "Banana", "zebra"]
    want = hashlib.sha256(json.dumps({"company": "A/é", "kind": "aim_trusted_metadata_v1", "location": None, "title": "t\"\n"}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert one(spark, [identity.identity("aim_trusted_metadata_v1", company=v, title=F.col("v2"), location=F.lit(None).cast("string"))], "A/é", 't"\n') == want
    with pytest.raises(ValueError):
        identity.identity("aim_packet_plan_v1", other=v)
    h = "a" * 64
    made = one(spark, [identity.criterion_id(v, F.lit("required"), F.lit(3), F.lit(9))], h)
    assert made == "criterion-" + hashlib.sha256(f"{h}\0required\x003\x009".encode()).hexdigest()[:32]
    assert one(spark, [identity.requirement_id(v, F.lit("required"))], " Must   have CRM. ") == "req-" + hashlib.sha256(b"required\0must have crm").hexdigest()[:24]
    assert one(spark, [identity.ordered_occurrences(F.expr("array(struct(5 as s, 6 as e), struct(1 as s, 2 as e), struct(5 as s, 6 as e))"))], "x") == [(1, 2), (5, 6)]


def test_rules_and_languages(spark):
    v = F.col("v1")
    passes = lambda t: classifiers.prefilter(t, F.lit("Acme"), F.lit(False))["reason"]
    cases = {"Warehouse Manager": classifiers.PASSED, "Warehouse Worker": "Hourly/Service/Hospitality role rejected", "C++ Lead": "Software Engineering role rejected", "Registered Nurse": "Healthcare/Clinical role rejected", "(NERD) program": "Veterinary role rejected", "Verfahrensmechaniker": classifiers.FOREIGN, "Unknown Title": "Unknown/placeholder title rejected", "Future sales opportunities": "Placeholder/junk title rejected", "Team Member, software": classifiers.PASSED, "TS/SCI Analyst": "Military/Defense non-PM role rejected", "Account Executive": classifiers.PASSED, "Head Lifeguard": "Fitness/Recreation role rejected"}
    assert dict(zip(cases, many(spark, passes(v), list(cases)))) == cases
    foreign = classifiers.foreign_language(F.lit("You will lead our sales team and work with the best"), title=v)
    assert many(spark, foreign, ["Geschäftsführer", "Account Manager", None]) == [True, False, False]
    finnish = "Etsimme tiimi osaaminen kokemus ja työ on sinä meillä myynti että asiakas"
    assert many(spark, classifiers.foreign_language(v), [finnish, "https://a.de.com/x de com da do dos e uma we are our team and the role will"]) == [True, False]
    assert many(spark, classifiers.is_enrichment_source(v), ["ATS-workday Details", "Details", None]) == [True, False, False]
    assert many(spark, classifiers.gives_snippets_only(v), [" Adzuna ", "indeed"]) == [True, False] and many(spark, classifiers.is_structured_source(v), ["ATS-lever", "x", None]) == [True, False, False]
    assert many(spark, classifiers.teaches_preferences(F.lit("passed"), v, ["Not a fit"]), ["too far", " ", None, "not a fit", "Expired posting"]) == [True, False, False, False, False]
    d = lambda s: classifiers.recovery_decision(s, F.lit(2), F.lit(False))
    assert many(spark, d(v), ["This job is no longer available.", "short"]) == [("closed", None, False, None), ("retry", 3, True, "fewer than 650 usable characters")]
    assert many(spark, classifiers.recovery_plan(v, F.lit(False)), ["Position has been filled.", "", "please enable javascript", "short"]) == ["dismiss_closed", "retry_extraction", "dismiss_closed", "retry_extraction"]
    assert many(spark, classifiers.failure_cause(v, F.lit(False)), [None, "sign in to apply", "short"]) == ["no description ever fetched", f"dead page ({classifiers.PAGE_SHELL})", "fewer than 650 usable characters"]


def test_places(spark):
    v = F.col("v1")
    assert many(spark, places.triage(F.lit("AE"), v)["pass"], ["Blaine, MN", "Rochester, MN", "Hudson, WI", "Crystal City, VA", "Crystal, MN", "PL-Warsaw", "IN-Indianapolis", "Remote - US", "Remote; Germany", "Wyoming"]) == [True, False, True, False, True, False, False, True, False, False]
    w = lambda c: places.work_base(F.array(c))
    assert many(spark, w(v), ["You must reside in Minnesota", "You must live in Texas", "We like people", "Must be based in London", "This hybrid role is in Denver", "must be located anywhere; fully remote role across the United States"]) == ["compatible", "incompatible", "unknown", "incompatible", "incompatible", "compatible"]
    assert many(spark, places.is_elsewhere_only(v), ["Austin, TX or Remote", "Remote", "MN"]) == [True, False, False]
    g = lambda c: places.gated(F.lit("Account Manager"), F.lit("Acme"), c, F.lit(False), F.lit("Dallas, TX"))
    assert [(r.passes, r.reason) for r in many(spark, g(v), ["3 Locations", "London", None])] == [(True, ""), (False, "Locally triaged out: Location outside the searched geographies (London)"), (True, "")]
    assert many(spark, places.states_metadata(v), ["ats-lever", "CareerForce", "adzuna"]) == [True, True, False]


def test_paths(spark):
    v = F.col("v1")
    cases = {"/job/Dallas-TX/x": "Dallas, TX", "/job/Phoenix-Office/x": "Phoenix", "/job/PA-Fort-Washington/x": "Fort Washington, PA", "/job/Youngstown-Ohio": "Youngstown, Ohio", "/job/Virtual---California/x": "Virtual, California", "/job/USA---New-Jersey/x": None, "/job/12-Main-St/x": None, "/job/Champaign---Hazelwood/x": None, "/job/Plainville/x": "Plainville", "/jobs/x": None, "/job/St%2E-Paul-MN/x": "St. Paul, MN", "/job/Bad%zz/x": None, "/job/Grand-Forks-North-Dakota/x": "Grand Forks, North Dakota", "": None}
    assert dict(zip(cases, many(spark, paths.path_place(v), list(cases)))) == cases
    assert many(spark, paths.with_count(v, F.lit("3 Locations")), ["Dallas, TX", "Plainville"]) == ["Dallas, TX; 3 Locations", None]
    df = spark.createDataFrame([("A–b", ["zed", "Alpha", "ALPHA", "2 Locations", "n/a", "a-B"])], "p string, o array<string>")
    assert df.select(paths.sites(F.col("p"), F.col("o"))).first()[0] == "A-b; Alpha; zed"


JOB = "id string, status string, scoring_status string, score_error string, pass_reason string, fit_category string, context_batched boolean, jd_batch string, batch_job string, fit_batch string, staged boolean, aim_score int, experience_score int, title string, company string"


def job(i, status="pending_af", scoring="scored", error=None, reason=None, category=None, aim=None, exp=None, jd=None, staged=False):
    return (i, status, scoring, error, reason, category, False, jd, None, None, staged, aim, exp, "t" + i, "C")


def test_queues(spark):
    jobs = spark.createDataFrame([job("a"), job("b", reason="Promoted by user: x"), job("c", category="promoted"), job("d"), job("e"), job("f", scoring="failed", error="JD recovery rejected: no"), job("g", scoring="failed", error="other"), job("h", aim=80), job("i", status="passed", reason="too far"), job("j", status="passed", reason="Expired"), job("k", status="inbox", scoring="queued"), job("l", scoring="needs_jd"), job("m", aim=80), job("n")], JOB)
    events = spark.createDataFrame([("d", "user_reject"), ("e", "user_reject"), ("e", "user_rescore")], "job_id string, event_type string")
    now = dt.datetime(2026, 1, 2)
    receipts = spark.createDataFrame([("1", "n", True, None, "X", now), ("2", "a", True, now, "X", now), ("3", "a", False, None, "X", now)], "id string, job_id string, suppression_active boolean, cleared_at timestamp, code string, failed_at timestamp")
    leased = spark.createDataFrame([("m",)], "id string")
    tab = lambda n: sorted(r.id for r in queues.log_tab(n, jobs, events, receipts, leased).collect())
    assert tab("aim_fit") == ["a", "e"] and tab("experience_fit") == ["h"] and tab("action_needed") == ["f", "n"]
    assert tab("context") == ["i"] and tab("local_scoring") == ["k"] and tab("needs_jd") == ["l"] and len(tab("other")) == 11
    assert [(r.id, r.title) for r in queues.active_failures(receipts, jobs).collect()] == [("1", "tn")]
    flow = spark.createDataFrame([("ingested", now), ("aim_scored", now), ("ingested", dt.datetime(2025, 1, 1))], "event_type string, at timestamp")
    assert tuple(queues.backlog_flow(jobs, flow, F.lit(now)).first()) == (11, 1, 1, 0)
    jobs.createOrReplaceTempView("jobs_there")
    assert queues.readiness(spark, ["jobs_there", "nothing_there"], {"jobs_there": ["id"]}) == {"jobs_there": True, "nothing_there": False}


def test_freshness(spark):
    day = lambda d: dt.datetime(2026, 1, d)
    events = spark.createDataFrame([("1", "a", "aim_fit", day(1), None, "h1", "v1", False, "dismissed"), ("2", "b", "aim_fit", day(1), None, "h2", "v2", False, "inbox"), ("3", "b", "aim_fit", day(2), day(3), "h2", "v2", False, "inbox"), ("4", "c", "experience_fit", day(1), None, "old", "v1", True, "inbox"), ("5", "d", "aim_fit", day(1), None, "h1", "v1", False, "inbox")], "id string, job_id string, family string, created_at timestamp, stale_at timestamp, input_hash string, prompt_version string, passed boolean, projection string")
    jobs = spark.createDataFrame([("a", "dismissed", False, None, "Account Manager", 10, None, True, "queued"), ("b", "inbox", False, None, "x", 10, None, True, "queued"), ("c", "inbox", False, None, "x", 66, None, True, "done"), ("d", "inbox", False, "Promoted by user: y", "Clerk", 70, 1, True, "done")], "id string, status string, staged boolean, pass_reason string, title string, aim_score int, experience_score int, local_passes boolean, experience_status string")
    assert sorted(r.id for r in freshness.stale_scores(jobs, events, "v2").collect()) == ["a", "b", "c"]
    assert [r.id for r in freshness.worth_another_look(jobs, events, "v2", F.lit(day(1)), 5).collect()] == ["a", "d"]
    people = spark.createDataFrame([("d", "user_reject")], "job_id string, event_type string")
    plan = freshness.replay_plan(jobs, events, people, {"aim_fit": "h2", "experience_fit": "new"})
    assert {r.job_id: r.action for r in plan.collect()} == {"a": "requeue_all", "c": "requeue_rest", "d": "action_needed"}
    done = {r.id: r for r in freshness.replayed(jobs, plan).collect()}
    assert done["a"].status == "pending_af" and done["a"].aim_score is None and done["c"].aim_score == 66 and done["c"].experience_status == "queued" and done["d"].status == "inbox"
    assert {r.id: r.status for r in freshness.replayed(jobs, plan, most=1).collect()} == {"a": "dismissed", "b": "inbox", "c": "inbox", "d": "inbox"}
    assert sorted(r.id for r in freshness.drifted_rows(events, {"prompt_version": "v1", "input_hash": "h1"}).collect()) == ["2", "4"]
    batches = spark.createDataFrame([("1", "aim", "exported", "h"), ("2", "aim", "exported", "x"), ("3", "aim", "done", "x")], "id string, stage string, status string, input_hash string")
    assert [r.id for r in freshness.superseded(batches, {"aim": "h"}).collect()] == ["2"]
    g = lambda a, e, p: tuple(spark.range(1).select(freshness.gated_status(F.lit(a).cast("int"), F.lit(e).cast("int"), F.lit(p)).alias("g")).first().g)
    assert [g(60, None, False), g(59, None, False), g(80, 70, False), g(80, 69, False), g(80, 90, True)] == [("pending_af", True), ("dismissed", False), ("inbox", True), ("dismissed", False), (None, True)]


def test_maintenance(spark):
    rows = [("1", "pending_af", 40, "Account Manager", "Acme", "Edina, MN", None, "ats-workday", "/job/x", None, None, "scored", "acme"), ("2", "inbox", 90, "Account Manager", "3m.wd1", "2 Locations", "&lt;p&gt;Base pay range $100,000 - $120,000.&lt;/p&gt;\nSign in", "ats-workday", "/job/Dallas-TX/x", None, None, "scored", "3m-co"), ("3", "inbox", 90, "Account Manager", "Beta", "London", "Position has been filled.", "ats-lever", "/x", None, None, "failed", None)]
    jobs = spark.createDataFrame(rows, "id string, status string, aim_score int, title string, company string, location string, description string, source string, url string, compensation string, travel string, scoring_status string, company_slug string")
    none = spark.createDataFrame([], "job_id string, event_type string")
    leased = spark.createDataFrame([], "id string")
    ids = lambda p: [(r.id, r.column, r.to) for r in p.orderBy("id", "column").collect()]
    assert ids(maintenance.floor_plan(jobs, none, leased, 60)) == [("1", "status", "dismissed")]
    assert ids(maintenance.geography_plan(jobs, none, leased)) == [("3", "status", "dismissed")] and ids(maintenance.triage_plan(jobs, none, leased, "inbox")) == [("3", "status", "dismissed")]
    assert ids(maintenance.floor_plan(jobs, spark.createDataFrame([("1", "user_reject")], none.schema), leased, 60)) == []
    assert ids(maintenance.recovery_plan(jobs)) == [("3", "status", "dismissed")]
    assert ids(maintenance.facts_plan(jobs)) == [("2", "compensation", "$100,000–$120,000 base"), ("2", "location", "Dallas, TX; 2 Locations")]
    assert ids(maintenance.company_plan(jobs)) == [("2", "company", "3m Co")] and ids(maintenance.company_plan(jobs, {"3m-co": "3M"})) == [("2", "company", "3M")]
    fixed = maintenance.markup_plan(jobs)
    assert ids(fixed) == [("2", "description", "Base pay range $100,000 - $120,000.")]
    done = {r.id: r for r in maintenance.apply(jobs, fixed.unionByName(maintenance.company_plan(jobs))).collect()}
    assert sorted(done["2"].applied) == ["company", "description"] and done["2"].company == "3m Co" and done["1"].applied == []
    late = maintenance.apply(jobs.withColumn("company", F.lit("Named since")), maintenance.company_plan(jobs)).where("id = '2'").first()
    assert late.company == "Named since" and late.applied == []


def test_status_changes_cool_down_a_company(spark):
    jobs = spark.createDataFrame([("1", "inbox", "Acme Inc"), ("2", "inbox", "ACME"), ("3", "inbox", "Other"), ("4", "passed", "Third"), ("5", "interviewing", "Third LLC")], "id string, status string, company string")
    asked = spark.createDataFrame([("1", "applied"), ("4", "inbox")], "id string, status string")
    now = F.lit(dt.datetime(2026, 1, 1))
    after, events = maintenance.status_change(jobs, asked, now)
    got = {r.id: (r.status, r.cooldown_until) for r in after.collect()}
    until = dt.datetime(2026, 1, 22)
    assert got == {"1": ("applied", None), "2": ("cooldown", until), "3": ("inbox", None), "4": ("cooldown", until), "5": ("interviewing", None)}
    assert sorted((r.id, r.event_type, r.prior, r.final) for r in events.collect()) == [("1", "user_lifecycle", "inbox", "applied"), ("2", "company_cooldown", "inbox", "cooldown"), ("4", "user_lifecycle", "passed", "cooldown")]


def test_matching_held_postings(spark):
    long = " ".join(f"duty{i} and more words" for i in range(30))
    now, old = dt.datetime(2026, 3, 1), dt.datetime(2025, 1, 1)
    schema = "id string, title string, company string, location string, description string, url string, source string, source_id string, created_at timestamp"
    held = spark.createDataFrame([("h1", "Account Manager", "Acme Inc", "Edina, MN", long, None, "a", "1", now), ("h2", "Account Manager", "Acme", "Edina, MN", long + " other", None, "b", "7", now), ("h3", "Account Manager", "Acme", "Edina, MN", long, None, "a", "9", old), ("h4", "Territory Lead", "Real Co", "Austin", long + " unique", None, "c", "3", now)], schema)
    new = spark.createDataFrame([("n1", "Account Manager - Remote", "ACME", "unknown", long, None, "z", "5", now), ("n2", "Other title", "Nobody", "x", "short", None, "b", "7", now), ("n3", "Account Manager", "Acme", "Edina, MN", "short", None, "q", "4", now), ("n4", "Territory Lead", "Jobgether", "Austin", long + " unique", None, "j", "1", now), ("n5", "Seller", "Acme", "Edina, MN", long, None, "a", "2", now)], schema)
    got = {r.id: (r.match, r.why) for r in dedup.matches_held(new, held, F.lit(now)).collect()}
    assert got == {"n1": ("h1", "description"), "n2": ("h2", "identity"), "n4": ("h4", "syndication")}


def test_postings_are_dealt_and_quotes_are_read_once(spark):
    jobs, answers, evidence = case(spark, [(j, "S2.CP.Q01", "Base salary USD 160,000 annually") for j in range(9)] + [(j, "S2.TR.Q01", "travel up to 20%") for j in range(9)])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    pay, road = (f(jobs.coalesce(1), answers, evidence, POLICY) for f in (assessments.compensation, assessments.travel))
    assert plan(pay).count("regexp_extract_all(") == 1 and plan(pay).count("RepartitionByExpression") == 1
    assert plan(road).count("Join ") <= 3 and plan(road).count("RepartitionByExpression") == 1
    assert {r.points for r in pay.collect()} == {10} and {r.upper for r in road.collect()} == {20}
