"""How a language's sources differ in their words: pairs of sources by chi-square distance, and each source's most overused terms.

A term's probability in a group of N occurrences and V kept terms is p = 1 + floor(10**9 * (count + 1) / (N + V)), and
f(p, q) = floor((p - q)**2 / q). All of it is whole numbers.

Pairs come from postings, a term's sources with their counts. Where a source lacks a term its probability is the same
for all such terms, so that a pair's sum is V * f(base, base), plus what each side's own terms change against the other's base,
which is summed over buckets of equal count, plus a correction for terms that both have, which the postings give. No term
is compared for sources that lack it.

Overused terms are searched from above: a group's terms of one count, and of a language's counts of one bit length, are a bucket,
and f at the bucket's least language probability bounds them all. Buckets are evaluated best bound first, in growing
batches for all groups at once, until every bucket left is bounded strictly below the group's kth value.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import TERM_BYTES, slices, spread, workers_import, written

LEAST_DOCS = 3
TOP = 200
SCALE = 10**9
#: 10**9 as two factors, so that shares are divided out in 64 bits for up to 2 ** 48 occurrences.
HIGH, LOW = 32_000, 31_250
#: Sums are kept as multiples of 2 ** 31 and the rest.
SHIFT = 31
MASK = (1 << SHIFT) - 1
#: Different (group, term) that a task counts, and the bytes of their terms, before it hands on what it has.
COUNTED, COUNTED_BYTES = 1_000_000, 64 << 20
#: Pairs of a term's sources worked on at once, and sums of pairs held by a task.
PAIRS, HELD_PAIRS = 1 << 20, 500_000
#: The first batch of the search takes buckets of so many terms a group, each next one GROWTH times as many.
BATCH, GROWTH = 400, 8


def probability(count, size):
    """1 + floor(10**9 * (count + 1) / size), for whole numbers or arrays of them; 1 where size is 0."""
    size = np.maximum(size, 1) if isinstance(size, np.ndarray) else max(size, 1)
    whole, rest = (count + 1) // size, (count + 1) % size
    first = rest * HIGH
    return 1 + whole * SCALE + first // size * LOW + first % size * LOW // size


def probability_of(count: Column, size: Column) -> Column:
    """probability() as a column."""
    held = F.greatest(size, F.lit(1))
    div = lambda a: F.call_function("div", a, held)
    first = (count + 1) % held * HIGH
    return F.lit(1) + div(count + 1) * SCALE + div(first) * LOW + div(first % held * LOW)


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, held: sources with occurrences n and documents d), what each task has counted. docs: lang, source, text as bytes."""

    def run(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def out():
            by_lang: dict[str, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
            for (lang, source), (n, d) in groups.items():
                terms = by_lang[lang]
                for t, k in n.items():
                    terms[t].append((source, k, d[t]))
            groups.clear()
            for lang, terms in by_lang.items():
                flat = list(zip(*chain.from_iterable(terms.values())))
                ends = np.cumsum([0, *map(len, terms.values())]).astype(np.int32)
                held = pa.StructArray.from_arrays([pa.array(flat[0], pa.string()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.int64())], names=["source", "n", "d"])
                words = pa.array(list(terms), pa.binary()).cast(pa.string())
                made = pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), words, pa.ListArray.from_arrays(pa.array(ends), held)], names=["lang", "term", "held"])
                yield from (made.slice(i, 20_000) for i in range(0, made.num_rows, 20_000))

        n_held = n_bytes = 0
        for batch in batches:
            for part in slices(batch, 2):
                for lang, source, text in zip(*[c.to_pylist() for c in part.columns]):
                    words = text.translate(TERM_BYTES).split()
                    if words:
                        n, d = groups[lang, source]
                        n_held -= len(n)
                        n.update(words)
                        n_held += len(n)
                        d.update(set(words))
                        n_bytes += len(text)
                if n_held > COUNTED or n_bytes > COUNTED_BYTES:
                    yield from out()
                    n_held = n_bytes = 0
        yield from out()

    workers_import(docs.sparkSession)
    return docs.mapInArrow(run, "lang string, term string, held array<struct<source:string,n:bigint,d:bigint>>")


def postings(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, t, held: array of source and n): the kept terms with their occurrences in the language and in each source that has them."""
    each = term_counts(docs).repartition("lang", "term").select("lang", "term", F.inline("held"))
    per = each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    kept = per.groupBy("lang", "term").agg(F.sum("n").alias("t"), F.sum("d").alias("df"), F.collect_list(F.struct("source", "n")).alias("held")).where(F.col("df") >= least)
    return written(kept.drop("df"), "postings")


def entries(posted: DataFrame) -> DataFrame:
    """(lang, term, t, source, n): a row for each source that has a kept term."""
    return posted.select("lang", "term", "t", F.inline("held"))


def group_sizes(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """(lang, source, v, size, base, lang_size): every group that occurs; sizes are N + V, base the probability of a term it lacks."""
    langs = posted.groupBy("lang").agg(F.count("*").alias("v"), F.sum("t").alias("lang_n"))
    sums = entries(posted).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    every = docs.groupBy("lang", "source").agg(F.count("*").alias("rows")).drop("rows")
    held = every.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "n"])
    held = held.withColumn("size", F.col("n") + F.col("v"))
    return written(held.select("lang", "source", "v", "size", probability_of(F.lit(0).cast("long"), F.col("size")).alias("base"), (F.col("lang_n") + F.col("v")).alias("lang_size")), "groups")


def split(value: Column, times: Column) -> list[Column]:
    return [(F.shiftright(value, SHIFT) * times).alias("hi"), (value.bitwiseAND(F.lit(MASK)) * times).alias("lo")]


def shared_terms(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, h, hi, lo): what terms that both groups have add to a pair beyond either side's own sums. g and h number the groups in order of lang and source.

    The groups' sizes are sent to all tasks: with s sources in a language the result has s * (s - 1) rows for it, so they are no more than its root.
    """
    known = [(r.lang, r.source, r.size, r.base) for r in groups.orderBy("lang", "source").collect()]
    sent = posted.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        rows = sent.value
        number = {(lang, source): k for k, (lang, source, _, _) in enumerate(rows)}
        size, base = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        sums: dict[int, list[int]] = {}

        def out():
            keys = np.array(list(sums), np.int64)
            both = np.array(list(sums.values()), np.int64).reshape(-1, 2)
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys // len(rows)), pa.array(keys % len(rows)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["g", "h", "hi", "lo"])

        f = lambda p, q: (p - q) * (p - q) // q
        for batch in batches:
            held = batch.column(1)
            lengths = np.diff(held.offsets.to_numpy())
            flat = held.flatten()
            langs = np.repeat(np.array(batch.column(0).to_pylist(), object), lengths)
            at = np.array([number[k] for k in zip(langs.tolist(), flat.field(0).to_pylist())], np.int64)
            p = probability(flat.field(1).to_numpy(), size[at]) if len(at) else np.zeros(0, np.int64)
            partners, starts = np.repeat(lengths, lengths).astype(np.int64), np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int64)
            upto, i = np.cumsum(partners), 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS, side="right")))
                one, other = np.repeat(np.arange(i, j), partners[i:j]), spread(starts[i:j], partners[i:j])
                i = j
                one, other = one[one != other], other[one != other]
                a, b, x, y = p[one], p[other], base[at[one]], base[at[other]]
                more = f(a, b) - f(a, y) - f(x, b) + f(x, y)
                keys, which = np.unique(at[one] * len(rows) + at[other], return_inverse=True)
                # Below 2 ** 53 in every sum, so that doubles hold them.
                hi, lo = np.bincount(which, more >> SHIFT, len(keys)), np.bincount(which, more & MASK, len(keys))
                for k, u, w in zip(keys.tolist(), hi.astype(np.int64).tolist(), lo.astype(np.int64).tolist()):
                    now = sums.setdefault(k, [0, 0])
                    now[0], now[1] = now[0] + u, now[1] + w
                if len(sums) > HELD_PAIRS:
                    yield out()
        if sums:
            yield out()

    workers_import(posted.sparkSession)
    numbers = groups.sparkSession.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(known)], "k long, lang string, source string")
    found = posted.select("lang", "held").mapInArrow(run, "g long, h long, hi long, lo long").groupBy("g", "h").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
    named = found.join(numbers.select(F.col("k").alias("g"), "lang", "source"), "g").join(numbers.select(F.col("k").alias("h"), F.col("source").alias("item")), "h")
    return named.select("lang", "source", "item", "hi", "lo")


def source_pairs(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): every ordered pair of different sources of a language."""
    left = groups.select("lang", "source", "v", "size", "base")
    right = groups.select("lang", F.col("source").alias("item"), F.col("size").alias("item_size"), F.col("base").alias("item_base"))
    names, bases = ["lang", "source", "item"], excess(F.col("base"), F.col("item_base"))
    pairs = left.join(right, "lang").where("source <> item")
    absent = pairs.select(*names, *split(bases, F.col("v")))
    alike = entries(posted).groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    own = alike.join(left, ["lang", "source"]).join(right, "lang").where("source <> item")
    own = own.select(*names, *split(excess(probability_of(F.col("n"), F.col("size")), F.col("item_base")) - bases, F.col("m")))
    theirs = alike.withColumnRenamed("source", "item").join(right, ["lang", "item"]).join(left, "lang").where("source <> item")
    theirs = theirs.select(*names, *split(excess(F.col("base"), probability_of(F.col("n"), F.col("item_size"))) - bases, F.col("m")))
    every = absent.unionByName(own).unionByName(theirs).unionByName(shared_terms(posted, groups))
    return every.groupBy(*names).agg((F.sum("hi") * (1 << SHIFT) + F.sum("lo")).alias("value"))


def overused_terms(posted: DataFrame, groups: DataFrame, top: int = TOP, batch: int = BATCH, growth: int = GROWTH) -> DataFrame:
    """(lang, source, item, value, rank): each group's `top` terms of greatest f among those likelier there than in the language; ties by term."""
    group = ["lang", "source"]
    bits = F.length(F.bin("t")).alias("bits")
    p, q = probability_of(F.col("n"), F.col("size")), lambda t: probability_of(t, F.col("lang_size"))
    buckets = entries(posted).groupBy(*group, "n", bits).agg(F.count("*").alias("m"), F.min("t").alias("least")).join(groups, group)
    buckets = buckets.where(p > q(F.col("least"))).select(*group, "n", "bits", "m", excess(p, q(F.col("least"))).alias("bound"))
    order = Window.partitionBy(*group).orderBy(F.col("bound").desc(), "n", "bits").rowsBetween(Window.unboundedPreceding, -1)
    buckets = written(buckets.withColumn("before", F.coalesce(F.sum("m").over(order), F.lit(0))), "buckets")
    best_first = Window.partitionBy(*group).orderBy(F.col("value").desc(), "item")
    best = written(groups.limit(0).select(*group, F.lit("").alias("item"), F.lit(0).cast("long").alias("value"), F.lit(0).alias("rank")), "best")
    seen, quota = 0, batch
    while True:
        kth = best.where(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
        left = buckets.where(F.col("before") >= seen).join(kth, group, "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).drop("kth")
        chosen = written(left.where(F.col("before") < quota).select(*group, "n", "bits"), "chosen")
        if chosen.isEmpty():
            if left.isEmpty():
                return best
        else:
            met = entries(posted).withColumn("bits", bits).join(chosen, [*group, "n", "bits"]).join(groups, group)
            met = met.where(p > q(F.col("t"))).select(*group, F.col("term").alias("item"), excess(p, q(F.col("t"))).alias("value"))
            ranked = best.drop("rank").unionByName(met).withColumn("rank", F.row_number().over(best_first))
            best = written(ranked.where(F.col("rank") <= top), "best")
        seen, quota = quota, quota * growth


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group of lang and source, part `pair` with every other source of the language and part `term` with its overused terms.

    Null texts, langs and sources count as empty ones, and rows that repeat each count. A group without kept terms has pairs, with the probabilities
    of terms that it lacks, and no terms; a language without kept terms has pairs of value 0; an empty table gives no rows. Other columns are not read.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    read = docs.select(*named, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    posted = postings(read, least)
    groups = group_sizes(read, posted)
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = source_pairs(posted, groups).withColumn("rank", F.row_number().over(ranked))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(overused_terms(posted, groups, top), "term"))


def oracle(least: int = LEAST_DOCS, top: int = TOP) -> str:
    """DuckDB SQL for audit() over documents: every group with every kept term."""
    p = lambda c, size: f"(1 + (1000000000::HUGEINT * ({c} + 1)) // ({size}))"
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({lowered}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
e AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS t FROM e GROUP BY ALL HAVING count(DISTINCT row) >= {least}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM e SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(t) AS n FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, any_value(v) AS v, coalesce(sum(c.n), 0) + any_value(v) AS size FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
a AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {p('coalesce(c.n, 0)', 's.size')} AS p, {p('k.t', 'v.n + v.v')} AS q FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM a JOIN a b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM y UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM a WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r
QUALIFY part = 'pair' OR rank <= {top}"""
