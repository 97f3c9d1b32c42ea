"""Every registered query against its SQL, and the entry module without the training-data operators."""

import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import registry
from millrace.plans.catalog import ORACLES, QUERIES
from millrace.streaming import ledger


#: Ids repeat and keys tie only in tables of some size: what has SQL runs over these.
LARGER = os.environ.get("TEST_LARGER_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con(sf_dir):
    found = {}
    for folder in (sf_dir, LARGER):
        c = found[folder] = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            c.execute(f"create view {p.stem} as select * from '{p}'")
    return found


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    sf_dir = LARGER if name in ORACLES and os.path.isdir(LARGER) else sf_dir
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in ORACLES:
        held = con[sf_dir].execute(ORACLES[name])
        names = [d[0] for d in held.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in held.fetchall()), key=repr)


def test_entry(spark):
    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).count() == 30


def test_entry_without_the_training_data_operators(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for p in ("__spark_entry__.py", "millrace"):
        os.symlink(root / p, tmp_path / p) if p.endswith(".py") else subprocess.run(["cp", "-r", root / p, tmp_path / p], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "millrace/llm"], check=True)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode == 0 and run.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], run.stderr


def test_stream_and_batch_agree(spark, tmp_path):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    first = [("a", t(1), 1), ("a", t(1), 1), ("b", t(2), 2)]
    again = [("b", t(2), 2), ("c", t(3), 3), ("a", t(1), 1)]
    schema, source, table = "event_key string, ts timestamp, v int", str(tmp_path / "in"), str(tmp_path / "out")
    for rows in (first, again):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = ledger.folder_stream(spark, source, schema)
        ledger.run_available(stream, ledger.append_new(table, "event_key"), str(tmp_path / "cp"))
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == sorted({*first, *again})
    once = ledger.once_per_key(ledger.folder_stream(spark, source, schema))
    query = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 3


def test_no_two_queries_share_a_name():
    with pytest.raises(ValueError, match="page_hosts"):
        registry.query()(QUERIES["page_hosts"].__wrapped__)
