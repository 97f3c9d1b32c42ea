"""Arriving postings against one judgement after the other."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from millrace import tables
from millrace.operators import arrivals

SCHEMA = "id long, turn long, title string, company string, location string, description string, url string, source string, source_id string, final_title string, final_company string, final_description string, final_url string"
NOW = dt.datetime(2026, 1, 1)


def url(k):
    return None if k is None else f"https://jobs.example.com/jobs/{chr(97 + k) * 3}-opening"


def one_by_one(rows, held, seen):
    """Addresses and identities alone; an address is a posting's identity, else its source and id are."""
    places = {h[1]: "held" for h in held if h[1] and h[4]}
    names = {h[1] or (h[2].lower(), h[3].lower()) for h in held}
    seen, out = set(seen), {}
    for r in sorted(rows, key=lambda r: r[1]):
        source, before, after = (r[7], r[8]), r[6], r[12]
        name = after or (r[7].lower(), r[8].lower())
        kind = "source_observation" if source in seen else "stable_identity" if before in places else "enriched_stable_identity" if after in places else "concurrent_identity" if name in names else "new"
        seen.add(source)
        if kind == "new":
            names.add(name)
            places[after] = r[0]
            places.pop(None, None)
        out[r[0]] = kind
    return out


def test_any_order_of_partitions(spark):
    draw = random.Random(11)
    pick = lambda n: url(draw.choice([None, *range(n)]))
    rows = [(i, t, "T", "C", "P", f"short {i}", pick(25), draw.choice(["a", "A", "b"]), draw.choice("xyzXYZ") + str(draw.randrange(12)), "T", "C", f"short {i}", pick(25)) for i, t in enumerate(draw.sample(range(1000), 150))]
    held = [(-1, url(3), "q", "1", True), (-2, url(4), "q", "2", False), (-3, None, "a", "x3", False)]
    there = spark.createDataFrame([(h[0], "T", "C", "P", "gone", h[1], h[2], h[3], NOW if h[4] else NOW - dt.timedelta(days=80)) for h in held], "id long, title string, company string, location string, description string, url string, source string, source_id string, created_at timestamp")
    seen = [("b", "y1"), ("a", "Z2")]
    made = arrivals.resolve(spark.createDataFrame(rows, SCHEMA).repartition(5), there, spark.createDataFrame(seen, "source string, source_id string"), F.lit(NOW))
    got = {r.id: r.kind for r in made.collect()}
    want = one_by_one(rows, held, seen)
    assert got == want and set(want.values()) == {"new", *arrivals.KINDS}


def test_nothing_arrives_and_nulls(spark):
    none = spark.createDataFrame([], SCHEMA)
    held = none.select("id", "title", "company", "location", "description", "url", "source", "source_id", F.lit(NOW).alias("created_at"))
    seen = none.select("source", "source_id")
    assert arrivals.resolve(none, held, seen, F.lit(NOW)).count() == 0
    rows = spark.createDataFrame([(i, i, *[None] * 11) for i in range(3)], SCHEMA)
    assert [r.kind for r in arrivals.resolve(rows, held, seen, F.lit(NOW)).collect()] == ["new"] * 3


def test_forms_are_worked_out_once_and_in_many_parts(spark, monkeypatch):
    made, parts = arrivals.kept, {}

    def kept(df, what):
        parts[what] = (df.rdd.getNumPartitions(), df._jdf.queryExecution().optimizedPlan().toString().count("clean_"))
        return made(df, what)

    monkeypatch.setattr(arrivals, "kept", kept)
    rows = spark.createDataFrame([(i, i, "T", "C", "P", "same" if i else "x", None, "a", str(i), "T", "C", "same", None) for i in range(20)], SCHEMA)
    held = rows.limit(0).select("id", "title", "company", "location", "description", "url", "source", "source_id", F.lit(NOW).alias("created_at"))
    assert {r.kind for r in arrivals.resolve(rows.coalesce(1), held, rows.limit(0).select("source", "source_id"), F.lit(NOW)).collect()} == {"new"}
    assert parts["keys"][0] >= 4 and parts["keys"][1] >= 1 and parts["asked"][1] == parts["offered"][1] == 0


def test_kept_are_keys_that_postings_meet_by_and_each_posting_once(spark, monkeypatch):
    made, rows_of = arrivals.kept, {}

    def kept(df, what):
        table = made(df, what)
        rows_of.setdefault(what, []).append(table.count())
        return table

    monkeypatch.setattr(arrivals, "kept", kept)
    # Thirty postings that nothing repeats, and a chain: the address of 31 is met by 32, which is found by its final address, met by 33, and so on.
    rows = [(i, i, "T", "C", "P", f"{i} " + "alone and long " * 30, None, "a", str(i), "T", "C", "short", None) for i in range(30)]
    rows += [(i, i, "T", "C", "P", "short", url(i - 30), "a", str(i), "T", "C", "short", url(i - 29)) for i in range(30, 36)]
    held = spark.createDataFrame([], SCHEMA).select("id", "title", "company", "location", "description", "url", "source", "source_id", F.lit(NOW).alias("created_at"))
    got = {r.id: r.kind for r in arrivals.resolve(spark.createDataFrame(rows, SCHEMA), held, held.select("source", "source_id"), F.lit(NOW)).collect()}
    assert got == {i: "stable_identity" if i in (31, 33, 35) else "new" for i in range(36)}
    assert sum(rows_of["keys"]) == 72 and sum(rows_of["asked"]) == sum(rows_of["offered"]) == 10  # by address and requisition
    assert len(rows_of["decided"]) > 2 and sum(rows_of["decided"]) == 5


def test_what_was_shuffled_for_a_kept_table_is_removed(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(tables.CLEANUP)
    rows = tables.kept(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(100):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(tables.CLEANUP) == setting and sorted(r["count"] for r in rows.collect()) == [142, 143, 143, 143, 143, 143, 143]


def test_slices_and_rounds_of_any_size(spark, monkeypatch):
    rows = [(i, i, "T", "C", "P", f"short {i}", url(i % 7), "a", str(i % 11), "T", "C", f"short {i}", url(i * i % 7)) for i in range(22)]
    held = [(-1, url(3), "q", "1", True)]
    there = spark.createDataFrame([(-1, "T", "C", "P", "gone", *held[0][1:4], NOW)], "id long, title string, company string, location string, description string, url string, source string, source_id string, created_at timestamp")
    monkeypatch.setattr(arrivals, "SLICE", 7)
    monkeypatch.setattr(arrivals, "ROUNDS", 1)
    made = arrivals.resolve(spark.createDataFrame(rows, SCHEMA), there, spark.createDataFrame([], "source string, source_id string"), F.lit(NOW))
    assert {r.id: r.kind for r in made.collect()} == one_by_one(rows, held, [])
