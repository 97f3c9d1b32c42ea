"""All places of many quotes against a plain search, and blocks of quotes."""

import random

import pytest

from millrace.operators import evidence


def plain(texts, quotes):
    out = []
    for k, t in texts:
        for q, s in quotes:
            at = t.find(s) if t and s else -1
            while at >= 0:
                out.append((k, q, at, at + len(s)))
                at = t.find(s, at + 1)
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_all_places(spark, block_bytes):
    draw = random.Random(3)
    texts = [(i, "".join(draw.choices("aab😀é ", k=draw.choice([0, 1, 50, 400])))) for i in range(40)] + [(90, None), (91, "a" * 70_000)]
    quotes = [(f"q{i}", "".join(draw.choices("aab😀é ", k=draw.choice([1, 2, 3, 6])))) for i in range(30)] + [("r", "aa"), ("s", "aa"), ("t", ""), ("u", None)]
    made = evidence.find_all(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes, "quote_id string, quote string"), "doc_id", "text", block_bytes=block_bytes)
    assert made.columns == ["doc_id", "quote_id", "start", "end"]
    assert sorted(tuple(r) for r in made.collect()) == plain(texts, quotes)


def test_nothing_to_find(spark):
    texts = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert evidence.find_all(texts, spark.createDataFrame([], "quote_id string, quote string"), "doc_id", "text").count() == 0
    assert evidence.find_all(texts.limit(0), spark.createDataFrame([("q", "a")], "quote_id string, quote string"), "doc_id", "text").count() == 0


def test_no_run_of_words_is_exploded_and_no_loop_joins(spark, sf_dir, capsys):
    from millrace.plans.texts import exact_evidence

    exact_evidence(spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "Generate" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_occurrences_of_a_vector(spark):
    sources = spark.createDataFrame([(1, "original_jd", None, "aa😀aa aaa"), (1, "trusted_metadata", "title", "Lead"), (2, "original_jd", None, None)], "job_id long, source string, field string, text string")
    rows = [(1, 0, "x", "aa", "original_jd", None, [(0, 2), (3, 5), (6, 8), (7, 9)]), (1, 1, "y", None, "original_jd", None, None), (1, 2, "z", "ea", "trusted_metadata", "title", [(1, 3), (1, 3)]), (2, 0, "x", "aa", "original_jd", None, []), (1, 3, "w", "L", "trusted_metadata", "location", [])]
    found = spark.createDataFrame(rows, "job_id long, pos int, evidence_id string, quote string, source string, field string, occurrences array<struct<start:int,end:int>>")
    answers = spark.createDataFrame([(1, 0, "q", "yes", ["x", "y", "z", "w"]), (2, 0, "q", "yes", ["x"])], "job_id long, pos int, question string, answer string, evidence array<string>")
    rules = spark.createDataFrame([("q", 0, "yes", 0, 9, 99, ["original_jd", "trusted_metadata"], ["title", "location"])], "question string, pos int, answer string, least int, most int, total int, sources array<string>, fields array<string>")
    got = sorted(tuple(r) for r in evidence.vector_faults(found, answers, sources, rules).collect())
    assert {g for g in got if g[2] != "catalog_order"} == {(1, "w", "source"), (1, "y", "not_found"), (2, "x", "source")}


def test_texts_of_vectors_are_searched_once(spark, monkeypatch):
    made, plans = evidence.kept, {}

    def kept(df, what):
        plans[what] = df._jdf.queryExecution().optimizedPlan().toString()
        return made(df, what)

    monkeypatch.setattr(evidence, "kept", kept)
    found = spark.createDataFrame([(1, 0, "a", "quoted", "original_jd", None, [(0, 6)]), (1, 1, "a", "gone", "original_jd", None, [(0, 4)])], "job_id long, pos int, evidence_id string, quote string, source string, field string, occurrences array<struct<start int, end int>>")
    answers = spark.createDataFrame([(1, 0, "q1", "yes", ["a"])], "job_id long, pos int, question string, answer string, evidence array<string>")
    sources = spark.createDataFrame([(1, "original_jd", None, "quoted text")], "job_id long, source string, field string, text string")
    rules = spark.createDataFrame([("q1", 0, "yes", 1, 1, 100, ["original_jd"], [])], "question string, pos int, answer string, least int, most int, total int, sources array<string>, fields array<string>")
    out = evidence.vector_faults(found, answers, sources, rules)
    assert plans["evidence"].count("ArrowEvalPython") == 1 and "ArrowEvalPython" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {(1, "a", "repeated_id"), (1, "a", "not_found"), (1, "a", "catalog_order")}
