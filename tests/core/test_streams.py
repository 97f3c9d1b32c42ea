"""Leases by hand, by a plain loop and as a stream; the ledger's look-ups."""

import datetime as dt
import random

from millrace.plans import streams
from millrace.streaming import leases, ledger

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "task string, at timestamp, id long, kind string, token string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def log(rows):
    return [("t", at(m), i, kind, token) for i, (m, kind, token) in enumerate(rows)]


def told(df):
    return sorted(tuple(r) for r in df.collect())


def test_steps(spark):
    cases = {
        "renewed, then completed; not due for a while": ([(0, "claim", "a"), (9, "renew", "a"), (15, "claim", "b"), (18, "complete", "a"), (20, "claim", "b"), (38, "claim", "c")], [("a", 0, 18, "completed"), ("c", 38, 48, "expired")]),
        "taken over after it ran out; the first's word counts no more": ([(0, "claim", "a"), (10, "claim", "b"), (11, "renew", "a"), (12, "complete", "a"), (19, "renew", "b")], [("a", 0, 10, "expired"), ("b", 10, 29, "expired")]),
        "late renewal holds it anew": ([(0, "claim", "a"), (15, "renew", "a"), (16, "complete", "a")], [("a", 0, 10, "expired"), ("a", 15, 16, "completed")]),
        "late completion": ([(0, "claim", "a"), (30, "complete", "a"), (40, "claim", "b"), (50, "claim", "c")], [("a", 0, 10, "expired"), ("c", 50, 60, "expired")]),
        "nobody's": ([(0, "renew", "a"), (1, "complete", "a")], []),
    }
    for rows, want in cases.values():
        made = leases.lease_history(spark.createDataFrame(log(rows), SCHEMA), 10, 20)
        assert told(made) == sorted(("t", k, at(a), at(b), why) for k, a, b, why in want)
    lone = spark.createDataFrame([*log([(0, "claim", "a")]), ("u", None, 1, "claim", "a"), (None, T0, 1, "claim", "a"), ("v", T0, 1, None, "a")], SCHEMA)
    assert told(leases.lease_history(lone, 10, 20, at(5))) == [("t", "a", T0, at(10), "open")]
    assert leases.lease_history(lone.limit(0), 10, 20).count() == 0


def test_stream_tells_what_the_batch_tells(spark, tmp_path):
    draw = random.Random(7)
    rows = [(f"t{draw.randrange(4)}", at(m), m, draw.choice(["claim", "claim", "renew", "complete"]), draw.choice("ab")) for m in sorted(draw.sample(range(5000), 500))]
    source, out, progress = (str(tmp_path / k) for k in ("in", "out", "cp"))
    for k in range(0, 500, 125):
        spark.createDataFrame(rows[k : k + 125], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        made = leases.lease_stream(ledger.folder_stream(spark, source, SCHEMA), 30, 20, "5 minutes")
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    mark = rows[-1][1] - dt.timedelta(minutes=5)
    want = [r for r in told(leases.lease_history(spark.createDataFrame(rows, SCHEMA), 30, 20)) if r[4] == "completed" or r[3] <= mark or any(x[0] == r[0] and x[1] >= r[3] for x in rows)]
    got = told(spark.read.parquet(out).select("task", "token", "started", "ended", "why"))
    assert [r for r in got if r in want] == got and {r[4] for r in got} == {"completed", "expired"}
    assert len(want) - len(got) <= 4 and len(got) > 100


def test_ledger_looks_up_the_days_of_a_batch(spark, tmp_path):
    folder = str(tmp_path / "out")
    sink = ledger.append_new(folder, "k", "ts")
    first = [("a", at(0)), ("b", at(1500)), ("a", at(0))]
    sink(spark.createDataFrame(first, "k string, ts timestamp"), 0)
    sink(spark.createDataFrame([("b", at(1500)), ("c", at(3000))], "k string, ts timestamp"), 1)
    rows = spark.read.parquet(folder)
    assert sorted(r.k for r in rows.collect()) == ["a", "b", "c"] and rows.select("day").distinct().count() == 3


def test_turns_cover_all_rows(spark, tmp_path):
    seen = []
    rows = spark.createDataFrame([(at(m), m) for m in range(90)], "ts timestamp, n int")
    streams.in_turns(rows, "ts", str(tmp_path / "in"), lambda s: seen.append(s.isStreaming))
    assert seen == [True] * 3 and spark.read.parquet(str(tmp_path / "in")).count() == 90


def test_a_key_that_ends_no_lease_gives_no_frame():
    from types import SimpleNamespace

    from millrace.streaming import leases

    made = leases.Replay(1, 1)
    made.state = SimpleNamespace(exists=lambda: False, update=lambda row: None)
    assert list(made.handleExpiredTimer(("t",), None, SimpleNamespace(getExpiryTimeInMs=lambda: 0))) == []
