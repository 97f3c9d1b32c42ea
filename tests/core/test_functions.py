"""Pinned examples of the text, identity, fact, scoring and control functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import classifiers, facts, identity, places, scoring, text, urls
from millrace.functions.rates import coverage, precise_rate, reconciles, safe_rate
from millrace.functions.times import catch_up_window, epoch_instant, local_day
from millrace.operators import control, dedup, predicates, ranking, setops
from millrace.sources import feeds
from millrace.tables import let_workers_import

NOW = "2026-08-01 18:00:00"


@pytest.fixture(autouse=True)
def importable(spark):
    let_workers_import(spark)


def one(spark, columns, *values):
    """What column expressions make of one row v1, v2, ..."""
    df = spark.createDataFrame([values], ", ".join(f"v{i + 1} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long'}" for i, v in enumerate(values)))
    got = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return got[0] if len(columns) == 1 else tuple(got)


def many(spark, expression, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v1 string")
    return [r.c for r in df.select("i", expression.alias("c")).orderBy("i").collect()]


def test_names(spark):
    v = F.col("v1")
    assert many(spark, text.words(v), ["Résumé & Co.", None, "  ﬁne--Print "]) == ["resume and co", "", "fine print"]
    assert many(spark, text.company(v), ["Acme, Inc.", "Acme Inc", "Acme Corporation", "3m.wd1", "3M", "Incline"]) == ["acme", "acme", "acme", "3m", "3m", "incline"]
    titles = ["Account Manager - Remote", "Account Manager (St. Paul)", "Account Manager, Austin, TX", "Account Manager | Twin Cities", "Sales - Enterprise", "Manager - Key Accounts - Hybrid"]
    assert many(spark, text.title(v), titles) == ["account manager", "account manager", "account manager austin tx", "account manager", "sales enterprise", "manager key accounts"]
    places = ["https://x.y", None, "United States of America", "Saint Paul, Minnesota", "Work from home", "N/A", "Worldwide"]
    assert many(spark, text.location(v), places) == ["unknown", "unknown", "us", "st paul mn", "remote", "unknown", "remote"]
    assert many(spark, text.query_family(v), ["Key  Accounts!", "", None]) == ["key_accounts", "all", "all"]
    assert many(spark, text.title_case(v), ["acme-corp_of IT"]) == ["Acme Corp Of IT"]
    assert many(spark, text.or_default(v, "Unknown"), [" ", None, " x "]) == ["Unknown", "Unknown", "x"]


def test_markup(spark):
    cases = {
        "<div><p>Role summary.</p><ul><li>Duty one</li></ul></div>": "Role summary.\n• Duty one",
        "&lt;p&gt;Escaped &amp;amp; kept&lt;/p&gt;": "Escaped & kept",
        "<10% travel required": "<10% travel required",
        "a<script>x</script>b<br>c": "ab\nc",
        "": "",
    }
    assert many(spark, text.clean_html(F.col("v1")), list(cases)) == list(cases.values())
    assert all(text.visible_text(x) == x for x in cases.values())


def test_addresses(spark):
    v = F.col("v1")
    cases = {"HTTPS://Example.COM:443/Jobs/12/?utm_source=a&b=2&a=1#x": "https://example.com/Jobs/12?a=1&b=2", "http://e.com:8080/": "http://e.com:8080/", "not a url": "not a url", "https://e.com": "https://e.com/"}
    assert many(spark, urls.normalize_url(v), list(cases)) == list(cases.values())
    assert many(spark, urls.host_matches(urls.host(v), "lever.co"), ["https://jobs.lever.co/x", "https://lever.co", "https://notlever.co", "bad url"]) == [True, True, False, False]
    platforms = {"https://acme.wd5.myworkdayjobs.com/x": "Workday", "https://x.com/?gh_jid=1": "Greenhouse", "https://jobs.lever.co/a": "Lever", "https://x.com": "Unknown", None: "Unknown"}
    assert many(spark, urls.platform(v, F.lit("feed"), F.lit(None).cast("string")), list(platforms)) == list(platforms.values())
    assert one(spark, [urls.platform(F.lit(None).cast("string"), F.col("v1"), F.lit(None).cast("string"))], "ats-greenhouse") == "Greenhouse"
    assert one(spark, [urls.platform(F.lit("https://jobs.lever.co/a"), F.lit(""), F.col("v1"))], "Taleo") == "Taleo"


def test_requisitions():
    assert urls.requisition("https://acme.wd5.myworkdayjobs.com/en-US/Site/job/Remote/Title_R-1234") == ("workday:acme", "requisition:r-1234")
    assert urls.requisition("https://wd5.myworkdaysite.com/recruiting/acme/Site/job/Remote/Title_R-1234") == ("workday:acme", "requisition:r-1234")
    assert urls.requisition("https://x.com/a?gh_jid=77") == ("x.com", "77")
    assert urls.requisition("https://x.com/jobs/abc") == ("x.com", "abc")
    assert urls.requisition("https://x.com/about") is None and urls.requisition(None) is None


def test_identity(spark):
    a, b = F.lit("Account Manager - Remote"), F.lit("account manager")
    same = one(spark, [identity.fingerprint(a, F.lit("Acme, Inc."), F.lit("MN")) == identity.fingerprint(b, F.lit("ACME"), F.lit("Minnesota")), F.length(identity.fingerprint(a, b, version=3))], "")
    assert same == (True, 35)
    assert one(spark, [identity.stable_hash(F.lit("a"), F.lit(None), F.lit("b")) == F.sha2(F.lit("a\x1f\x1fb"), 256)], "")
    assert identity.canonical_text({"z": 1, "arr": [3, True, None], "a": "é"}) == '{"a":"é","arr":[3,true,null],"z":1}'
    assert 0 <= one(spark, [identity.jitter_millis(F.lit("task"), 1000)], "") <= 1000


def test_pay(spark):
    cases = {
        "For more information on our total rewards offerings, visit.\nBase Pay Range -$79,800 - $99,800": "$79,800–$99,800 base",
        "The annual salary range for this role is $74000 to $98000 USD.": "$74,000–$98,000 base",
        "Base compensation range: $141,000 USD – $211,500 USD.": "$141,000–$211,500 base",
        "The salary range is $80,000 to $120,000 OTE": None,
        "Salary range, including commission, is $125,000 - $150,000.": None,
        "Base pay range: $4,000 - $5,000 per month": None,
        "Base pay range: $2,400 - $3,100 biweekly.": None,
        "Salary range of $1,500 to $1,900 a week.": None,
        "Base pay range is $30 - $35 per hour.": None,
        "Annual base salary range: $9,000 - $12,000": "$9,000–$12,000 base",
        "Base salary range $9,000 - $12,000": None,
        "base salary $50,000 - $60,000. Base salary $70,000 - $80,000": None,
        "base salary $50,000 - $60,000. Again base salary $50,000 to $60,000": "$50,000–$60,000 base",
        "Base salary $16,900.00 - $253,600.00": None,
        "Base salary $90,000 - $60,000": None,
        "Base salary $50,000.50 - $60,000.5 a year": "$50,000.50–$60,000.5 base",
        "": None,
    }
    assert dict(zip(cases, many(spark, facts.posted_base_pay(F.col("v1")), list(cases)))) == cases
    assert many(spark, facts.posted_base_pay(F.col("v1")), [None]) == [None]


def test_travel(spark):
    cases = {
        "Up to 25% travel required.": "up to 25%", "Travel requirement: 25%": "25%", "Ability to travel approximately 30% of the time.": "approximately 30%", "as much  as 40% travel": "up to 40%", "approx 40% travel": "approximately 40%",
        "Travel 25-50% of the time.": "25–50%", "This position involves 40% – 60% travel.": "40–60%", "Travel 20% - 20% annually.": "20%",
        "No travel. Some travel reimbursement of 50%.": "none stated", "Travel is not required.": "none stated", "Minimal travel expected.": "minimal", "Some travel may be required.": None,
        "Travel 10%. Elsewhere travel is 30%.": None, "Occasional travel. Travel about 10 %.": "about 10%", "Travel 150% of the time.": None, "Travel 60-40% of the time. No extras": None, "Minimal travel of 250%": None,
        "We reimburse 100% of travel expenses.": None, "401k with 50% match; travel to conferences encouraged.": None, "This role requires up to 40% travel. We reimburse 100% of travel expenses.": "up to 40%", "Field work": None, "": None,
    }
    assert dict(zip(cases, many(spark, facts.posted_travel(F.col("v1")), list(cases)))) == cases
    assert one(spark, [facts.matches(F.col("v1"), "a+")], "aabcaXa") == [(0, "aa"), (4, "a"), (6, "a")]


def test_structured_pay_and_intervals(spark):
    ranges = F.from_json("v1", "array<struct<currency string, frequency string, range_start double, range_end double>>")
    good = '[{"currency":"USD","frequency":"YEAR","range_start":50000,"range_end":60000},{"currency":"EUR","frequency":"YEAR","range_start":1,"range_end":2}]'
    assert one(spark, [facts.structured_base_pay(ranges)], good) == "$50,000–$60,000 base"
    clauses = F.from_json("v1", "array<struct<lower int, upper int>>")
    out = many(spark, facts.travel_interval(clauses), ['[{"lower":10,"upper":50},{"upper":30}]', '[{"lower":60},{"upper":30}]', "[]"])
    assert [tuple(x) for x in out] == [(10, 30, "stated"), (None, None, "conflicting"), (None, None, "unstated")]


def test_criteria(spark):
    criteria = F.from_json("v1", "array<struct<classification string, outcome string, neutral boolean>>")
    make = lambda *xs: "[" + ",".join(f'{{"classification":"{c}","outcome":"{o}","neutral":{n}}}' for c, o, n in xs) + "]"
    r = "required"
    got = many(spark, scoring.criterion_score(criteria), [make((r, "direct", "false"), (r, "direct", "false")), make((r, "direct", "false"), (r, "partial", "false")), make((r, "direct", "false"), (r, "does_not_meet", "false")), "[]", make((r, "direct", "false"), ("preferred", "partial", "false"), (r, "partial", "true"))])
    assert [(x.uncapped, x.score, x.cap) for x in got] == [(100, 100, None), (75, 75, 79), (50, 50, 59), (100, 100, None), (90, 90, None)]
    outcomes = F.split("v1", ",")
    assert many(spark, scoring.compound_outcome(F.lit("any"), outcomes), ["partial,does_not_meet", "cannot_evaluate"]) == ["partial", "cannot_evaluate"]
    assert many(spark, scoring.compound_outcome(F.lit("all"), outcomes), ["direct,partial", "direct,does_not_meet", "direct"]) == ["partial", "does_not_meet", "direct"]
    assert many(spark, scoring.preferred_points(outcomes), ["direct,partial,does_not_meet", "direct"]) == [10, 20]


def test_rates(spark):
    v1, v2 = F.col("v1"), F.col("v2")
    assert [one(spark, [safe_rate(v1, v2)], a, b) for a, b in ((19, 100), (1, 3), (0, 0))] == [19, 33.3, None]
    assert [one(spark, [precise_rate(v1, v2)], a, b) for a, b in ((0, 5), (1, 10_000), (1, 3), (1, 0))] == [0, 0.01, 33.3, None]
    assert one(spark, [reconciles(*[F.lit(x) for x in (10, 2, 5, 2, 1)])], "") and not one(spark, [reconciles(*[F.lit(x) for x in (10, 2, 5, 2, 0)])], "")
    assert many(spark, coverage(F.col("v1"), F.lit("2026-01-02")), ["2026-01-01", "2026-01-02", "2026-01-03"]) == ["untracked", "partial", "tracked"]


def test_times(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, [local_day(ts("2024-01-01 00:09:58")), local_day(ts("2024-07-01 04:59:00"))], "") == (dt.date(2023, 12, 31), dt.date(2024, 6, 30))
    a = one(spark, [catch_up_window(ts("2026-08-01 12:00:00"), ts(NOW))], "")
    b = one(spark, [catch_up_window(ts("2026-06-23 18:00:00"), ts(NOW))], "")
    assert (a.window_start, a.is_catch_up) == (dt.datetime(2026, 8, 1, 10), False) and (b.window_start, b.is_catch_up) == (dt.datetime(2026, 7, 25, 18), True)
    assert one(spark, [epoch_instant(F.lit(1786928825.0)) == epoch_instant(F.lit(1786928825000.0))], "")


def test_classifiers(spark):
    v = F.col("v1")
    assert many(spark, classifiers.provider_failure(v), ["HTTP 429", "all configured API keys were rate-limited or rejected", "x"]) == ["rate_limited", "keys_exhausted", "provider_error"]
    assert many(spark, classifiers.first_rule(v), ["Demo Engineer", "UX Designer, product manager", "Designer", "Democracy lead", None]) == ["Test/demo role rejected", "Product Management role rejected", "Design/Creative role rejected", None, None]
    long_fr = "Nous sommes une équipe et vous serez avec nous pour le poste dans la région"
    assert many(spark, classifiers.foreign_language(v), [long_fr, "We are a team and you will work with us", "Привет мир это работа", ""]) == [True, False, True, False]
    cond = "Applications may be reviewed until the position is filled."
    assert many(spark, classifiers.says_closed(v), ["This position has been filled.", cond, None]) == [True, False, False]
    body = "In this role you have duties and requirements. " * 20
    quality = many(spark, classifiers.description_quality(v, F.lit(False)), ["", "short", body, body[:700] + "...", "plain words only " * 50])
    assert [q.scorable for q in quality] == [False, False, True, False, False]
    status = lambda a, b, c: one(spark, [classifiers.run_status(F.col("v1"), F.col("v2"), F.col("v3"))], a, b, c)
    assert [status(*x) for x in ((0, 0, 0), (5, 0, 0), (0, 1, 0), (1, 5, 0), (10, 2, 0), (100, 1, 0))] == ["idle", "success", "failed", "failed", "partial", "success"]


def test_predicates(spark):
    df = spark.createDataFrame([(1, "Alpha Co", None), (2, "beta", "alpha thing"), (3, None, "x")], "id long, a string, b string")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(predicates.matches_all("ALPHA", ["a", "b"])) == [1, 2] and ids(predicates.matches_all("alpha co", ["a", "b"])) == [1] and ids(predicates.matches_all("a", ["a"])) == []
    assert ids(predicates.not_containing("b", "ALPHA")) == [1, 3]
    j = spark.createDataFrame([(1, '{"k": true}'), (2, '{"k": "true"}'), (3, None), (4, "{bad"), (5, '{"x": true}')], "id long, d string")
    assert [r.id for r in j.where(predicates.json_flag("d", "k")).collect()] == [1]


def test_ranking_and_sets(spark):
    rows = spark.createDataFrame([(1, "a", 3, True), (2, "a", 2, False), (3, "b", 1, False)], "id long, k string, at long, stale boolean")
    order = [F.col("at").desc(), F.col("id").desc()]
    assert [r.id for r in ranking.first_per_key(rows, ["k"], order).where("not stale").collect()] == [3]
    assert sorted(r.id for r in ranking.first_eligible_per_key(rows, ~F.col("stale"), ["k"], order).collect()) == [2, 3]
    held = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    plan = spark.createDataFrame([(1, "x", "z"), (2, "old", "z")], "k long, expected string, to string")
    got = {(r.k, r.v, r.applied) for r in setops.compare_and_set(held, plan, "k", "expected", "v", "to").collect()}
    assert got == {(1, "z", True), (2, "y", False)}
    assert sorted(tuple(r) for r in setops.insert_ignore(held, spark.createDataFrame([(2, "n"), (3, "n"), (3, "n")], "k long, v string"), ["k"]).collect()) == [(1, "x"), (2, "y"), (3, "n")]


def test_circuits(spark):
    t = lambda m: dt.datetime(2026, 1, 1, 0, m)
    rows = [("p", t(0), "timeout"), ("p", t(1), "timeout"), ("p", t(2), "timeout"), ("p", t(3), "timeout"), ("p", t(4), None), ("p", t(5), "credentials"), ("p", t(5), None)]
    out = control.circuit_states(spark.createDataFrame(rows, "provider string, at timestamp, failure string")).orderBy("at", F.col("failure").isNotNull()).collect()
    assert [(r.failures_in_row, r.state) for r in out] == [(1, "closed"), (2, "closed"), (3, "open"), (4, "open"), (0, "closed"), (0, "closed"), (1, "open")]
    assert [r.open_until and (r.open_until - r["at"]).seconds // 60 for r in out] == [None, None, 15, 30, None, None, 360]


def test_duplicates(spark):
    body = "long words of a posting that go on " * 20
    rows = [(1, 1, "Rep", "Acme Inc", "MN", body, "https://a.com/jobs/77", "s1", "10"), (2, 2, "Rep - Remote", "Acme", "", body, None, "s2", "x"), (3, 3, "Rep", "Acme", "MN", "other", "https://a.com/jobs/77?utm_source=z", "s3", None), (4, 4, "Rep", "Acme", "MN", body + "more", None, "s1", "11"), (5, 5, "Rep", "Jobgether", "MN", body, None, "s5", None), (6, 6, "Rep", "Other", "MN", "x", None, "s1", "10")]
    table = spark.createDataFrame(rows, "id long, arrived long, title string, company string, location string, description string, url string, source string, source_id string")
    assert sorted((r.id, r.duplicate_of, r.why) for r in dedup.duplicate_links(table).collect()) == [(2, 1, "description"), (3, 1, "identity"), (5, 1, "syndication"), (6, 1, "identity")]


def test_suppression(spark):
    decided = spark.createDataFrame([("d1", "f1", "passed", "Acme", "Rep", "MN", None, 1), ("d2", "f1", "applied", "Acme", "Rep", "MN", None, 2), ("d3", "f2", "passed", "Acme", "Rep", "2 Locations", None, 3), ("d4", "f3", "dismissed", "Acme", "Rep", "MN", " Already Applied ", 4)], "id string, fingerprint string, status string, company string, title string, location string, pass_reason string, n long")
    open_ = spark.createDataFrame([("c1", "f1", "inbox"), ("c2", "f2", "inbox"), ("c3", None, "inbox"), ("c4", "f1", "archived"), ("c5", "f3", "pending_af"), ("d2", "f1", "inbox")], "id string, fingerprint string, status string")
    got = sorted(tuple(r) for r in dedup.suppression_plan(open_, decided, [F.col("n")]).collect())
    assert got == [("c1", "d2", "Duplicate of a job already applied: Rep at Acme — MN"), ("c5", "d4", "Duplicate of a job already applied: Rep at Acme — MN")]


def test_feeds(spark):
    now = F.lit(NOW).cast("timestamp")
    make = lambda feed, *records: [r.asDict() for r in feeds.normalised(spark.createDataFrame([(x,) for x in records], "value string"), feed, now).collect()]
    h = make("himalayas", '{"title":" Rep ","guid":"g1","companyName":"Acme","pubDate":1786928825,"locationRestrictions":["US",{"name":"Canada"},{"alpha2":"MX"}],"applicationLink":"u"}', '{"title":"no id"}')
    assert len(h) == 1 and (h[0]["title"], h[0]["location"], h[0]["posted_at"].year) == ("Rep", "US, Canada, MX", 2026)
    r = make("remoteok", '{"legal":"x","position":"p","id":1}', '{"position":"Rep","id":7,"location":"Austin, ","date":"2026-01-02T03:04:05Z"}')
    assert [(x["source_id"], x["location"], x["company"]) for x in r] == [("7", "Austin", "Unknown Company")]
    g = make("glassdoor", '{"jobview":{"header":{"employer":{"name":"Acme"},"jobViewUrl":"/x","ageInDays":2},"job":{"jobTitleText":"Rep","listingId":5}}}')
    assert (g[0]["url"], g[0]["posted_at"]) == ("https://www.glassdoor.com/x", dt.datetime(2026, 7, 30, 18))
    w = make("weworkremotely", '{"title":"Acme: Rep: West","link":"l","region":"Anywhere"}')
    assert (w[0]["company"], w[0]["title"], w[0]["location"]) == ("Acme", "Rep: West", "Anywhere")
    boards = spark.createDataFrame([("lever", "acme-corp", '[{"text":"Rep","id":"1","hostedUrl":"h","categories":{"location":"MN"}}]'), ("workday", "acme.wd5::Site", '{"jobPostings":[{"title":"Rep","externalPath":"/job/x_R1","locationsText":"2 Locations"}]}'), ("greenhouse", "g", '{"name":"Gee","jobs":[{"title":"T","id":9,"absolute_url":"a","location":{"name":"Here"}}]}'), ("workable", "w", '{"results":[{"title":"T","id":3,"shortcode":"SC","location":{"city":"C","region":"R"}}]}')], "platform string, slug string, body string")
    got = {x["source"]: (x["company"], x["location"], x["url"], x["source_id"]) for x in (r.asDict() for r in feeds.normalised_boards(boards, now).collect())}
    assert got == {"ATS-lever": ("Acme Corp", "MN", "h", "1"), "ATS-workday": ("acme", "2 Locations", "https://acme.wd5.myworkdayjobs.com/en-US/Site/job/x_R1", "/job/x_R1"), "ATS-greenhouse": ("Gee", "Here", "a", "9"), "ATS-workable": ("w", "C, R", "https://apply.workable.com/w/j/SC", "3")}


def test_work_base_sentences(spark):
    v = F.col("v1")
    sentences = {
        places.needs_territory: ["You must live in the assigned territory.", "need to reside within the territories", "located within the sales territory is required"],
        places.excludes_remote: ["This role is not remote", "Not a remote job", "non-remote", "Remote work is not offered", "There is no remote work", "Remote-only candidates won't do", "On-site only", "office based only"],
        places.needs_presence: ["A hybrid position", "The job will be hybrid", "On-site attendance", "You are expected to report daily in our office", "Three days a week at the office", "working from our nice office"],
        places.needs_residency: ["Applicants are required to currently be based here", "You must reside near", "Only open to candidates who live close", "A remote role restricted to some", "You must be within commuting distance"],
    }
    for f, said in sentences.items():
        others = ["It cannot be remote.", "Territories are large", "Remote roles exist", "Hybrid cars", "A week in May", "must relocate", ""]
        assert many(spark, f(v), [*said, *others]) == [True] * len(said) + [False] * len(others), f.__name__
    assert many(spark, places.needs_presence(v, metadata=True), ["Hybrid cars", "Remote"]) == [True, False]


def test_whole_patterns_of_pages(spark):
    v = F.col("v1")
    gone = ["404 Not Found", "status: 404", "404 - page", "Page you were looking for does not exist", "Call 1-888-404-2494", "room 404"]
    assert many(spark, v.rlike(classifiers.GONE), gone) == [True] * 4 + [False] * 2
    closed = ["Job no longer posted", "posting is no longer accepting applications", "Applications are no longer being accepted", "applications are no longer accepted for this job", "the requisition is canceled", "When applications end and the posting is closed", "If so. The job is closed", "Until it is filled; position is filled"]
    assert many(spark, classifiers.says_closed(v), closed) == [True] * 5 + [False, True, True]
    duties = ["Position overview", "what you’ll work on", "your role today includes it", "grow our regional accounts", "own a car", "your rolex will"]
    assert many(spark, classifiers.matches_any(v, classifiers.DUTIES), duties) == [True] * 4 + [False] * 2
    needs = ["what we're looking for", "what you need", "a licence", "diploma", "equivalent experience", "kneeding", "we need it"]
    assert many(spark, classifiers.matches_any(v, classifiers.QUALIFICATIONS), needs) == [True, True, True, True, True, False, True]


def plan_of(spark, c):
    df = spark.createDataFrame([], "t string")
    return df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()


def test_tokens_of_a_text_are_found_once(spark):
    foreign = plan_of(spark, classifiers.foreign_language(F.col("t")))
    assert foreign.count("regexp_extract_all(") == 1 and foreign.count("https?") == 1


def test_stated_facts_flatten_a_text_once(spark):
    df = spark.createDataFrame([("Base pay range $60,000 - $95,000. Travel up to 20% of the time.",)], "t string")
    for made, said in ((facts.posted_base_pay, "$60,000–$95,000 base"), (facts.posted_travel, "up to 20%")):
        assert plan_of(spark, made(F.col("t"))).count("coalesce(t#") == 1 and df.select(made(F.col("t"))).first()[0] == said
