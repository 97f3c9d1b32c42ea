"""Functions that no registered query runs: state, recovery, pieces of texts, files and windows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import classifiers, identity, scoring, segments, text, times
from millrace.operators import authority, control, dedup
from millrace.sources import feeds, files
from millrace.streaming import ledger
from millrace.tables import let_workers_import
from tests.core.test_functions import many, one


@pytest.fixture(autouse=True)
def importable(spark):
    let_workers_import(spark)


def test_completion_and_recovery(spark):
    rows = [(["success", "failed"], [None], False), (["failed"], [None], False), ([], [], True), ([], [], False), (["success"], ["blocked by daily budget"], False), (["success", "partial"], [None], False), (["success"], [None], False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s array<string>, e array<string>, c boolean")
    got = [r.v for r in df.select("i", classifiers.completion_status(F.col("s"), F.col("e"), F.col("c")).alias("v")).orderBy("i").collect()]
    assert got == ["partial", "failed", "blocked_circuit", "disabled", "blocked_budget", "partial", "succeeded"]
    q = F.struct(F.lit(False).alias("scorable"))
    assert tuple(spark.range(1).select(authority.recovery_action(F.lit(False), q, F.lit(2)).alias("a")).first().a) == ("retry_extraction", 3, True)
    assert tuple(spark.range(1).select(authority.recovery_action(F.lit(True), q, F.lit(2)).alias("a")).first().a) == ("dismiss_closed", 2, False)
    after = lambda a, p, e, s: authority.status_after_cooldown(F.lit(a), F.lit(p), F.lit(e), F.lit(s))
    assert tuple(spark.range(1).select(after("current", True, "current", 70).alias("a"), after("current", False, "unscored", 0).alias("b"), after("current", True, "current", 69).alias("c"), after("stale_replay_needed", True, "unscored", 0).alias("d")).first()) == ("inbox", "archived", "archived", "pending_af")


def test_keys_and_canonical_json(spark):
    v = F.col("v1")
    a = one(spark, [identity.posting_identity(v, F.lit("feed"), F.lit("1"))], "https://x.example/jobs/AB-12")
    assert a == one(spark, [identity.posting_identity(v, F.lit("other"), F.lit("9"))], "https://x.example/jobs/ab-12?utm=1") and a.startswith("posting:v1:")
    assert one(spark, [identity.posting_identity(F.lit(None).cast("string"), v, F.lit(" "))], "feed") is None
    assert many(spark, identity.canonical_json(v), ['{"b": 1, "a": [true, null, "é\\u0007"]}', "no json", None]) == ['{"a":[true,null,"é\\u0007"],"b":1}', None, None]


def test_scores(spark):
    c = F.from_json("v1", "array<struct<classification string, category string, outcome string>>")
    made = lambda *rows: json.dumps([dict(zip(("classification", "category", "outcome"), r)) for r in rows])
    d = lambda *rows: tuple(one(spark, [scoring.experience_decision(c)], made(*rows)))
    assert d(("required", "skill", "direct"), ("preferred", "skill", "direct"))[0] == "qualified" and d(("required", "skill", "partial"))[:2] == ("hard_requirement_not_fully_supported", None)
    assert d(("required", "administrative", "partial"))[0] == "qualified" and d(("required", "skill", "direct"), ("preferred", "x", "direct"))[1] > d(("required", "skill", "direct"), ("preferred", "x", "does_not_meet"))[1] >= 80
    tokens = lambda s: F.split(F.lit(s), " ")
    assert spark.range(1).select(scoring.resume_points(tokens("a b c d e f g h i j k"), tokens("a b z")).alias("p")).first().p == 18
    assert spark.range(1).select(scoring.resume_points(tokens("a b"), tokens("a b")).alias("p")).first().p == 24


def test_pieces(spark):
    df = spark.createDataFrame([(1, "Intro\nRequirements:\n- Must have CRM\n• 5 years\nPreferred:\n- Spanish\nAbout us:\nNice place"), (2, "You must drive."), (3, None), (4, "")], "k long, t string")
    assert [(r.k, r.line_no, r.start, r.line) for r in segments.located_lines(df.where("k > 1"), "k", "t").orderBy("k").collect()] == [(2, 0, 0, "You must drive."), (4, 0, 0, "")]
    lines = segments.located_lines(df.where("k = 1"), "k", "t").collect()
    assert all(df.first().t[r.start : r.start + len(r.line)] == r.line for r in lines) and len(lines) == 8
    q = spark.createDataFrame([("aaa😀aa", "aa"), ("x", ""), (None, "x")], "t string, q string").select(segments.occurrences("t", "q").alias("o")).collect()
    assert [[(x.start, x.end) for x in r.o] for r in q] == [[(0, 2), (1, 3), (4, 6)], [], []]
    v = F.col("v1")
    assert many(spark, text.compatible(v), ["ﬁne ①", None]) == ["fine 1", None] and many(spark, text.plain_markdown(v), ["**Bold**\n- one\n* two\n\n\n\nend"]) == ["Bold\n• one\n• two\n\nend"]
    assert many(spark, text.scoring_text(v), ["é\r\nx", "a\x00"]) == ["é\nx", None]


def test_clocks(spark):
    at = lambda h: F.lit(dt.datetime(2026, 1, 1, h))
    row = spark.range(1).select(*[times.rotation_window(at(h), 3, 9).alias(f"h{h}") for h in (0, 1, 2, 3)]).first()
    assert len({*row[:3]}) == 3 and row[0] == row[3] and all(x % 3 == 0 for x in row)
    today = F.lit(dt.date(2026, 1, 1))
    assert [tuple(r) for r in spark.range(1).select(*[control.board_backoff(F.lit(n), today).alias(f"b{n}") for n in (0, 1, 2)]).first()] == [(1, "parked", dt.date(2026, 1, 2)), (2, "parked", dt.date(2026, 1, 8)), (3, "blacklisted", dt.date(2026, 1, 31))]
    t = lambda h: dt.datetime(2026, 1, 1, h)
    runs = spark.createDataFrame([(1, t(1), None), (2, t(5), None), (3, t(1), t(2))], "id long, started_at timestamp, finished_at timestamp")
    assert [r.id for r in control.abandoned(runs, at(6)).collect()] == [1]
    held = spark.createDataFrame([(1, None, None), (1, t(1), "old"), (2, None, None)], "id long, stale_at timestamp, stale_reason string")
    marked = control.invalidate(held, spark.createDataFrame([(1,), (1,)], "id long"), "id", at(9), "new").collect()
    assert sorted((r.id, r.stale_reason or "") for r in marked) == [(1, "new"), (1, "old"), (2, "")] and len(marked) == 3


def test_gaps_and_members(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("a", t, [("1", "required", "skill", "CRM experience"), ("2", "preferred", "administrative", "Form"), ("3", "required", "skill", " ")], [("1", "cannot_evaluate"), ("2", "cannot_evaluate"), ("3", "cannot_evaluate")]), ("b", t, [("1", "preferred", "skill", "CRM experience")], [("1", "cannot_evaluate")]), ("c", t, [("1", "required", "skill", "CRM experience")], [("1", "direct")])]
    df = spark.createDataFrame(rows, "job_id string, created_at timestamp, criteria array<struct<criterion_id string, classification string, category string, meaning string>>, outcomes array<struct<criterion_id string, outcome string>>")
    gaps = authority.evidence_gaps(df)
    assert [(r.n_required, r.n_preferred, r.jobs) for r in gaps.collect()] == [(1, 1, 2)]
    line = files.report_lines(gaps).first().line
    assert line.startswith("- **crm-experience-") and line.endswith(": 1 required, 1 preferred, 2 postings")
    side = lambda rows: spark.createDataFrame(rows, "ordinal int, job_id string, input_hash string")
    made = authority.membership_mismatches(side([(1, "a", "h"), (2, "b", "h"), (3, "c", "h")]), side([(1, "a", "h"), (2, "b", "x"), (4, "d", "h")]))
    assert sorted((r.ordinal, r.expected, r.got) for r in made.collect()) == [(2, "b", "b"), (3, "c", None), (4, None, "d")]


def test_feeds_and_boards(spark):
    boards = spark.createDataFrame([("x", ["a", "b", "c"]), ("y", ["a"])], "slug string, titles array<string>")
    assert [r.slug for r in dedup.board_overlap(boards, spark.createDataFrame([("x", ["b", "c"]), ("y", ["a"])], "slug string, titles array<string>")).collect()] == ["x"]
    posts = spark.createDataFrame([("f", "1"), ("f", "1"), ("f", "2")], "source string, source_id string")
    assert [r.source_id for r in feeds.new_only(posts, posts.where("source_id = '2'")).collect()] == ["1"]


def test_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Acme: Seller</title><link>l</link><guid>g</guid><pubDate>2026-01-01 10:00:00</pubDate></item><item><title>Solo</title><link>m</link></item></channel></rss>")
    made = feeds.normalised(files.rss_items(spark, str(tmp_path / "f.xml")), "weworkremotely", F.lit(dt.datetime(2026, 1, 2))).orderBy("source_id").collect()
    assert [(r.company, r.title, r.source_id, r.posted_at.day) for r in made] == [("Acme", "Seller", "g", 1), ("Unknown Company", "Solo", "m", 2)]
    page = '<script type="application/ld+json">{"@type":"JobPosting","title":" T ","hiringOrganization":{"name":"O"},"jobLocation":{"address":{"addressLocality":"Edina","addressRegion":"MN"}},"datePosted":"2026-01-01"}</script>'
    pages = spark.createDataFrame([(1, page), (2, page.replace("JobPosting", "Article")), (3, None)], "page_id long, html string")
    assert [(r.page_id, r.title, r.company, r.location) for r in files.embedded_postings(pages).collect()] == [(1, "T", "O", "Edina, MN")]
    lines = spark.createDataFrame([('x INGESTION_SUMMARY {"seen":3,"inserted":1}',), ("other",), ("| a | b\\|c |",), ("|---|---|",), ("| one |",)], "value string")
    assert [(r.seen, r.inserted, r.errors) for r in files.run_summaries(lines).collect()] == [(3, 1, None)]
    assert [r.cells for r in files.markdown_rows(lines, 2).collect()] == [["a", "b|c"]]
    files.export_json(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id long, v string"), str(tmp_path / "out"), [F.col("id").asc()], ["id", "v"], most=2)
    rows = sorted(spark.read.json(str(tmp_path / "out")).collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == [1, 2] and rows[0].input_hash == __import__("hashlib").sha256(b'{"id":1,"v":"a"}').hexdigest()


def test_windowed_counts(spark, tmp_path):
    t = lambda h, m=0: dt.datetime(2026, 1, 1, h, m)
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", t(1)), ("a", t(1, 30)), ("b", t(2)), ("a", t(23))], "g string, ts timestamp").write.parquet(source)
    counts = ledger.windowed_counts(ledger.folder_stream(spark, source, "g string, ts timestamp"), "ts", "g")
    query = counts.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.start.hour, r.g, r.n) for r in spark.table("hourly").collect()) == [(1, "a", 2), (2, "b", 1), (23, "a", 1)]


def test_identity_takes_one_pass_of_python_over_bounded_batches(spark):
    from millrace.tables import BATCH_BYTES

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    let_workers_import(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == BATCH_BYTES
    held = spark.createDataFrame([(1, "<b>T</b>", "C", "P", "A&amp;B ﬁn", None, "s", "1")], "id long, title string, company string, location string, description string, url string, source string, source_id string")
    made = dedup.with_identity(held)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_held_postings_are_dealt_over_the_cores(spark):
    held = spark.createDataFrame([(1, "T", "C", "P", "d", None, "s", "1")], "id long, title string, company string, location string, description string, url string, source string, source_id string").coalesce(1)
    made = dedup.matches_held(held, held.withColumn("created_at", F.lit("2026-01-01").cast("timestamp")), F.lit("2026-01-02").cast("timestamp"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 2
    assert [tuple(r) for r in made.collect()] == [(1, 1, "identity")]
