"""Listings, board discovery, failure series and selections for replay and recovery."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import discovery
from millrace.sources import feeds, listings
from millrace.tables import let_workers_import

NOW = dt.datetime(2026, 8, 1, 18)


@pytest.fixture(autouse=True)
def importable(spark):
    let_workers_import(spark)


def rows(spark, feed, *records):
    table = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    return [r.asDict() for r in feeds.normalised(table, feed, F.lit(NOW)).collect()]


def test_listings(spark):
    muse = rows(spark, "themuse", {"name": "Rep", "id": 7, "locations": [{"name": "Austin, TX"}], "company": {"name": "Acme"}, "contents": "c"}, {"name": "Rep", "id": 8, "locations": [{"name": "Berlin"}]}, {"name": "Rep", "id": 9, "locations": []})
    assert [(r["source_id"], r["location"], r["company"], r["url"]) for r in muse] == [("7", "Austin, TX", "Acme", "7")]
    remotive = rows(spark, "remotive", {"title": "T", "id": 1, "company_name": "C"}, {"title": "T", "id": 2, "candidate_required_location": "Brazil"}, {"title": "T", "id": 3, "candidate_required_location": "Worldwide", "publication_date": "2026-07-01T00:00:00"})
    assert [(r["source_id"], r["location"], r["posted_at"]) for r in remotive] == [("1", "Remote / Location unspecified", NOW), ("3", "Worldwide", dt.datetime(2026, 7, 1))]
    arbeit = rows(spark, "arbeitnow", {"title": "Sales Rep", "slug": "s", "location": "New York, US", "created_at": 1786928825}, {"title": "Cook", "slug": "t", "location": "US"}, {"title": "Sales", "slug": "u", "location": "Berlin"})
    assert [(r["source_id"], r["posted_at"].year) for r in arbeit] == [("s", 2026)]
    assert [(r["title"], r["source_id"]) for r in rows(spark, "adzuna", {"redirect_url": "x"}, {"title": "no id"})] == [("Unknown Title", "x")]
    linked = rows(spark, "linkedin", {"title": "T", "id": 5, "organization": "O", "locations_derived": ["Here"], "description_text": "d"}, {"title": "T", "job_id": 6, "locations": [{"address": {"addressLocality": "There"}}], "description_text": "", "description": "old"})
    assert [(r["company"], r["location"], r["description"]) for r in linked] == [("O", "Here", "d"), ("Unknown Company", "There", "old")]
    assert len(rows(spark, "dice", {"title": "T", "company": "C", "details_page_url": "u"}, {"title": "T", "company": "C"})) == 1
    serp = rows(spark, "serpapi", {"title": "Rep (US)", "company_name": "A&B", "location": "MN", "job_id": "j"}, {"title": "T", "job_id": "k", "apply_options": [{"link": "l"}]})
    assert [r["url"] for r in serp] == ["https://www.google.com/search?q=Rep%20(US)%20A%26B%20MN%20jobs", "l"]


def test_federal_postings(spark):
    details = {"JobSummary": "Sum", "Duties": ["One", {"Text": "Two"}, ""], "Education": {"Value": "School"}, "Requirements": ""}
    one = {"MatchedObjectDescriptor": {"PositionTitle": "Clerk", "DepartmentName": "Dept", "PositionID": "P1", "PositionURI": "u", "PositionLocation": [{"LocationName": "A"}, {"LocationName": "B"}], "UserArea": {"Details": details}}}
    got = rows(spark, "usajobs", one, {"MatchedObjectDescriptor": {"PositionURI": "v", "PositionLocation": [{"LocationName": "Only"}]}})
    assert [(r["company"], r["location"], r["source_id"], r["title"]) for r in got] == [("Dept", "A, B", "P1", "Clerk"), ("U.S. Government", "Only", "v", "Unknown Title")]
    assert got[0]["description"] == "Job Summary\nSum\n\nMajor Duties\nOne\nTwo\n\nEducation\nSchool" and got[1]["description"] == ""


def test_datasets_and_disabled_feeds(spark):
    records = spark.createDataFrame([(1, NOW), (2, NOW - dt.timedelta(hours=37)), (3, None)], "id long, finished timestamp")
    assert [r.id for r in listings.fresh_dataset(records, F.col("finished"), F.lit(NOW)).collect()] == [1]
    assert sorted(r.source for r in listings.disabled_runs(F.lit(NOW), spark.range(5)).collect()) == sorted(listings.DISABLED)


def test_board_discovery(spark):
    postings = spark.createDataFrame([("https://h.app/companies/Steer/jobs/1", "name", "Rep, East"), ("https://h.app/companies/steer/jobs/2", "Steer CRM", "Rep West"), ("https://h.app/companies/other", "Other Inc", "Solo Job"), ("https://h.app/x", "X", "Y")], "url string, company string, title string")
    found = discovery.board_candidates(postings)
    assert {r.slug: (r.company, sorted(r.titles)) for r in found.collect()} == {"steer": ("Steer CRM", ["rep east", "rep west"]), "other": ("Other Inc", ["solo job"])}
    boards = spark.createDataFrame([("lever", "steer", "Steer", [], ""), ("ashby", "Steer", "", ["Rep – East", "rep west", "Rep West"], ""), ("lever", "other", "Zed", ["Solo job"], "Join Other, Inc. now"), ("ashby", "other", "Zed", ["Solo job"], "nothing"), ("known", "other", "Other Inc", [], "")], "platform string, slug string, board_name string, titles array<string>, text string")
    known = spark.createDataFrame([("known", "OTHER")], "platform string, slug string")
    got = {(r.platform, r.slug): (r.title_matches, r.evidence, r.verified) for r in discovery.verified_boards(found, boards, known).collect()}
    assert got == {("lever", "steer"): (0, 'name "Steer"', True), ("ashby", "steer"): (2, "2 titles", True), ("lever", "other"): (1, "1 title + company named in postings", True), ("ashby", "other"): (1, None, False)}


def test_failure_series(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    made = [(i, "j", "s", t(i), False, None) for i in (1, 2, 3, 4)] + [(9, "j", "u", t(1), True, None), (10, "k", "s", t(1), None, True)]
    out = discovery.failure_series(spark.createDataFrame(made, "id long, job_id string, series_key string, at timestamp, input_bound boolean, forced boolean")).collect()
    assert {r.id: (r.series_ordinal, r.suppressed) for r in out} == {1: (1, False), 2: (2, False), 3: (3, True), 4: (4, True), 9: (1, True), 10: (1, True)}


def test_selections(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    events = spark.createDataFrame([(1, "a", t(1), None, "v2", False), (2, "a", t(2), t(3), "v2", False), (3, "b", t(1), None, "v2", False), (4, "c", t(5), None, "v1", False), (5, "d", t(5), None, "v1", True)], "id long, job_id string, created_at timestamp, stale_at timestamp, version string, passed boolean")
    jobs = spark.createDataFrame([(k, None, False, "Promoted by user" if k == "e" else None) for k in "abce"], "id string, title string, staged boolean, pass_reason string")
    assert sorted(r.id for r in discovery.to_replay(jobs, events, "v2").collect()) == ["a", "c"]
    gone = spark.createDataFrame([("c", "Account Manager", 10, None, True), ("d", "Account Manager", 90, 90, True), ("b", "Cook", 90, 90, True)], "id string, title string, aim int, req int, passes boolean")
    assert [r.id for r in discovery.to_recover(gone, events, "v2", F.lit(t(1)), "account manager", 5).collect()] == ["c"]


def test_a_boards_payload_is_read_once_and_not_for_each_posting(spark):
    body = '{"name":"B","jobs":[' + ",".join(f'{{"id":{k},"title":"t{k}"}}' for k in range(50)) + "]}"
    made = feeds.board_postings(spark.createDataFrame([("greenhouse", "s", body)], "platform string, slug string, body string"))
    above = made._jdf.queryExecution().optimizedPlan().toString().split("Generate ")[0]
    assert "get_json_object" not in above
    assert {(r.board_name, r.record) for r in made.collect()} == {("B", f'{{"id":{k},"title":"t{k}"}}') for k in range(50)}
