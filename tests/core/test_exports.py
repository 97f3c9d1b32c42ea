"""Files of an export keep their bounds whatever the sizes of items."""

import json
import random

from pyspark.sql import functions as F

from millrace.operators import exports


def test_bounds_and_order(spark):
    draw = random.Random(2)
    rows = [(i, "x" * draw.choice([0, 5, 40, 400, 520, 999])) for i in draw.sample(range(10_000), 400)] + [(20_000, "x" * 1000), (20_001, None)]
    items = spark.createDataFrame(rows, "k long, p string").repartition(6)
    packed = exports.pack(items, "k", "p", 5, 1000).collect()
    assert sorted(int(r.key) for r in packed) == sorted(k for k, p in rows if p is not None and len(p) < 1000)
    files = {}
    for r in sorted(packed, key=lambda r: (r.file, r.ordinal)):
        files.setdefault(r.file, []).append(r)
    assert all(len(f) <= 5 and sum(r.bytes for r in f) <= 1000 and [r.ordinal for r in f] == list(range(len(f))) for f in files.values())
    assert max(len(f) for f in files.values()) == 5 and max(sum(r.bytes for r in f) for f in files.values()) == 1000
    keys = [int(r.key) for f in files.values() for r in f]
    assert all(a < b for f in files.values() for a, b in zip([int(r.key) for r in f], [int(r.key) for r in f][1:])) and len(set(keys)) == len(keys)
    assert sorted(r.k for r in exports.too_large(items, "k", "p", 1000).collect()) == [20_000, 20_001]
    assert exports.pack(items.limit(0), "k", "p").count() == 0


def test_written_files_are_bounded_by_tasks_and_both_forms_read_alike(spark, tmp_path):
    items = spark.range(600).select("id", F.concat(F.lit("ü"), "id").alias("p"))
    packed = exports.pack(items, "id", "p", 2, 1000)
    read = []
    for apart in (False, True):
        folder = str(tmp_path / str(apart))
        exports.write_export(packed if not apart else packed.where("key < 20"), folder, apart)
        found, manifest = exports.read_export(spark, folder)
        assert exports.faults(found, manifest).count() == 0
        read.append({(r.file, r.ordinal, r.key, r.payload) for r in found.collect()})
    assert len(read[0]) == 600 and len({r[0] for r in read[0]}) >= 300 and read[1] == {r for r in read[0] if int(r[2]) < 20}
    parts = list((tmp_path / "False" / "items").rglob("*.json"))
    assert len(parts) < 100
    where = [(n, json.loads(line)["file"]) for n, p in enumerate(parts) for line in p.read_text().splitlines()]
    assert len(set(where)) == len({file for _, file in where})
