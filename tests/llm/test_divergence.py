"""The divergence audit against exact sums over every group and kept term."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, held string, rank int, part string"


def tokens(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def share(count, size):
    return 1 + 10**9 * (count + 1) // size


def naive(rows, least=3, top=200):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source, words = r[2] or "", r[3] or "", tokens(r[1])
        groups[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for (lang, source), counts in groups.items():
        kept = [w for w, n in docs[lang].items() if n >= least]
        prob = lambda c: {w: share(c[w], sum(c[x] for x in kept) + len(kept)) for w in kept}
        p, pairs, terms = prob(counts), [], []
        for (other_lang, other), c in groups.items():
            if other_lang == lang and other != source:
                q = prob(c)
                pairs.append((other, sum((p[w] - q[w]) ** 2 // q[w] for w in kept)))
        whole = sum((c for (k, _), c in groups.items() if k == lang), Counter())
        q = prob(whole)
        terms = [(w, (p[w] - q[w]) ** 2 // q[w]) for w in kept if counts[w] and p[w] > q[w]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def random_rows(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 3]))) for _ in range(80)]
    return [(i, " ".join(rng.choices(words[: rng.choice([5, 80])], k=rng.choice([0, 2, 30]))).title(), rng.choice(["en", "de", "", None]), rng.choice(["a", "a", "a", "b", "c", None, ""]), 1, "x", 2, "p") for i in range(n)]


ODD = [(1, None, None, None, None, None, None, None), (2, "", "xx", "lone", 0, "", 0, ""), (3, "one-word one_word ONE2word", "yy", "s", 0, "", 0, ""), (4, "only here", "yy", "t", 0, "", 0, ""), (5, "Ünï ÜNÏ ünï é\x1cé " * 40_000, "en", "long", 0, "", 0, "")]


@pytest.mark.parametrize("rows", [[*random_rows(300, 4), *ODD, *ODD], ODD, ODD[:1], []])
def test_audit(spark, rows):
    made = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert made.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in made.collect()) == naive(rows)


@pytest.mark.parametrize(("top", "batch", "growth"), [(1, 1, 2), (3, 2, 2), (7, 1, 3), (1000, 5, 4)])
def test_search_stops_at_nothing_that_counts(spark, top, batch, growth):
    rows = random_rows(400, top)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, '') AS lang", "coalesce(source, '') AS source", "cast(coalesce(text, '') AS binary) AS text")
    posted = divergence.postings(docs)
    made = divergence.overused_terms(posted, divergence.group_sizes(docs, posted), top, batch, growth)
    got = sorted((r.lang, r.source, "term", r.item, r.value, r.rank) for r in made.collect())
    assert got == [r for r in naive(rows, top=top) if r[2] == "term"]


def test_shares_are_exact(spark):
    rng = random.Random(2)
    pairs = [(0, 1), (0, 2**47), (2**47 - 2, 2**47), *[(rng.randrange(s), s) for s in (rng.randrange(1, 2 ** rng.randrange(1, 47)) for _ in range(500))]]
    want = [share(c, s) for c, s in pairs]
    assert [divergence.probability(c, s) for c, s in pairs] == want
    assert divergence.probability(*np.array(pairs, np.int64).T).tolist() == want
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, c long, s long")
    assert [r.p for r in df.select("i", divergence.probability_of(F.col("c"), F.col("s")).alias("p")).orderBy("i").collect()] == want
