"""Edits of jobs and what follows from them."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import invalidation

T = dt.datetime(2026, 1, 1)


def test_cascade(spark):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    changes = made([(1, ["title", "title", "a"]), (2, None), (3, ["url"]), (9, ["url"])], "job_id long, fields array<string>")
    events = made([("e1", 1, None, T, "inbox"), ("e2", 1, T, T + dt.timedelta(1), "passed"), ("e3", 2, None, T, "inbox"), ("e4", 3, None, T, "inbox"), ("e5", 4, None, T, "inbox")], "id string, job_id long, stale_at timestamp, created_at timestamp, projection string")
    other = made([("x1", 1, None), ("x2", 2, None), ("x3", 3, T)], "id string, job_id long, stale_at timestamp")
    items = made([(7, 2, "leased"), (7, 1, "leased"), (8, 1, "done"), (6, 3, "leased"), (None, 1, "leased")], "batch_id long, job_id long, status string")
    batches = made([(7, "exported"), (8, "exported"), (6, "imported")], "id long, status string")
    jobs = made([(1, "inbox", False), (2, "inbox", None), (3, "inbox", True), (4, "inbox", False)], "id long, status string, staged boolean")
    decisions = made([(2, "user_reject"), (1, "viewed")], "job_id long, event_type string")
    found = invalidation.cascade(changes, {"event": events, "artifact": other, "extraction": other}, items, batches, jobs, decisions)
    one, two, three = "job-input-edited:a,title", "job-input-edited:forced_rescore", "job-input-edited:url"
    want = [("artifact", "x1", 1, "stale", one), ("artifact", "x2", 2, "stale", two), ("batch", "7", 1, "superseded", one), ("event", "e1", 1, "stale", one), ("event", "e3", 2, "stale", two), ("event", "e4", 3, "stale", three), ("extraction", "x1", 1, "stale", one), ("job", "1", 1, "requeued", one)]
    assert sorted(tuple(r) for r in found.collect()) == want
    gone = events.withColumn("stale_at", F.lit(T))
    after = invalidation.cascade(changes, {"event": gone, "artifact": other.limit(0), "extraction": other.limit(0)}, items, batches.limit(0), jobs, decisions)
    assert after.count() == 0
