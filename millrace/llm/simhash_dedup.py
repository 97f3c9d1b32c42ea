"""SimHash near-duplicates by the generalised pigeonhole principle.

Whole texts give 64-bit fingerprints. Equal fingerprints become one class. The classes are linked at `radius` or
fewer differing bits: bits are grouped into m parts, correlated bits together; if part i is probed within t_i bits
and the t_i add up to radius - m + 1, every link agrees in some part within its t_i. Dynamic programming allots the
t_i by candidate counts that are taken over all fingerprints; part keys are probed and every candidate verified.

A part key that more than `bucket` fingerprints hold isn't paired off: its holders meet at the words one flipped bit
away from them instead. Two fingerprints share such a word exactly when they differ in at most two bits, so each
holder makes 65 rows however many hold the key, and each word ties its group to the group's smallest id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_texts, workers_import, written
from millrace.llm.components import components

RADIUS = 2
BUCKET = 64
#: Copies of a fingerprint beyond which its rows are dealt over SALTS keys.
HOT = 20_000
SALTS = 64
#: Relative costs of a probe row and of a candidate that is verified.
PROBE_COST, VERIFY_COST = 1.0, 0.2
LAYOUTS = (2, 3, 4)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of lower-cased (A-Z) words' shingles, repeats counted; fewer words: one shingle; no word: 0. Signed."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(key, carried columns, fp long): a row for each input row; null and wordless texts have fingerprint 0."""
    return map_texts(docs, text, lambda: lambda texts: {"fp": [fingerprint(t) for t in texts]}, [("fp", T.LongType())], [key, *carry])


def bit_moments(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have bits i and j both set, over all of them (64 x 64 sums)."""

    def run(batches):
        held, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            held, n = held + bits.T @ bits, n + len(bits)
        i, j = np.triu_indices(64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(held[i, j], n).astype(np.int64))], names=["i", "j", "n"])

    workers_import(classes.sparkSession)
    rows = classes.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((64, 64)), 0
    for r in rows:
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m parts of like size; each part grows by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(dev, dev))
    np.fill_diagonal(corr, 0)
    left, parts = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        rest = sorted(left)
        part = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(part) < size:
            part.append(max(sorted(left - set(part)), key=lambda b: (corr[b, part].sum(), -b)))
        parts.append(sorted(part))
        left -= set(part)
    return parts


def mask(bits: list[int]) -> int:
    """Bits as a signed 64-bit number."""
    return int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64))


def key_costs(classes: DataFrame, layouts: dict[int, list[list[int]]], bucket: int) -> dict[tuple[int, int], float]:
    """For every part of every layout the candidates within 0 bits, counted over all fingerprints; keys over `bucket` count as their 65 rows each."""
    keys = [(m, i, mask(part)) for m, parts in layouts.items() for i, part in enumerate(parts)]
    rows = classes.select(F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(k)).alias("key")) for m, i, k in keys])).alias("k"))
    sizes = rows.groupBy("k.m", "k.i", "k.key").agg(F.count("*").cast("double").alias("c"))
    cost = F.when(F.col("c") > bucket, 65 * F.col("c") * PROBE_COST).otherwise(F.col("c") * (F.col("c") - 1) / 2 * VERIFY_COST)
    return {(r.m, r.i): r.cost for r in sizes.groupBy("m", "i").agg(F.sum(cost).alias("cost")).collect()}


def allot(n: int, agree: np.ndarray, layouts: dict[int, list[list[int]]], at_zero: dict, radius: int) -> tuple[int, list[int]]:
    """The layout and thresholds (-1: not probed, 0, 1) of least estimated cost whose sum is radius - m + 1.

    agree[b]: the share of pairs that agree in bit b. Within one bit a part has about 1 + sum (1 - agree) / agree times the candidates that it has within none.
    """
    best = (np.inf, 0, [])
    for m, parts in layouts.items():
        goal = radius - m + 1
        table = {0: (0.0, [])}
        for i, part in enumerate(parts):
            wider = 1 + sum((1 - agree[b]) / max(agree[b], 1e-6) for b in part)
            zero = at_zero.get((m, i), 0.0)
            price = {-1: 0.0, 0: n * PROBE_COST + zero, 1: n * (1 + len(part) / 2) * PROBE_COST + zero * wider}
            table = {s: min((c + price[s - u], [*t, s - u]) for u, (c, t) in table.items() if s - u in price) for s in range(-len(parts), len(parts) + 1) if any(s - u in price for u in table)}
        if goal in table and table[goal][0] < best[0]:
            best = (table[goal][0], m, table[goal][1])
    return best[1], best[2]


def probes(classes: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(part, key, fp, rep, own): own keys of each probed part, and where its threshold is 1 also the keys with one more bit set."""
    out = []
    for i, (part, t) in enumerate(zip(parts, thresholds)):
        if t < 0:
            continue
        key = F.col("fp").bitwiseAND(F.lit(mask(part)))
        made = [F.struct(F.lit(i).alias("part"), key.alias("key"), F.lit(True).alias("own"))]
        if t == 1:
            made += [F.when(F.col("fp").bitwiseAND(F.lit(mask([b]))) == 0, F.struct(F.lit(i).alias("part"), key.bitwiseOR(F.lit(mask([b]))).alias("key"), F.lit(False).alias("own"))) for b in part]
        out += made
    return classes.select("fp", "rep", F.explode(F.array_compact(F.array(*out))).alias("p")).select("p.part", "p.key", "fp", "rep", "p.own")


def links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """classes (fp, rep) to edges (a, b) between the reps of fingerprints at most `radius` (up to 2) bits apart.

    Not every pair gets an edge: holders of a crowded key are tied to one of them, which leaves the same components.
    """
    n, both = bit_moments(classes)
    p = np.diag(both) / max(n, 1)
    layouts = {m: correlated_parts(n, both, m) for m in LAYOUTS}
    m, thresholds = allot(n, p * p + (1 - p) * (1 - p), layouts, key_costs(classes, layouts, bucket), radius)
    rows = probes(classes, layouts[m], thresholds)
    crowded = written(rows.where("own").groupBy("part", "key").count().where(F.col("count") > bucket).select("part", "key"), "crowded")
    calm = rows.join(crowded, ["part", "key"], "left_anti")
    left = calm.where("own").select("part", "key", F.col("fp").alias("fp_a"), F.col("rep").alias("a"))
    right = calm.select("part", "key", F.col("fp").alias("fp_b"), F.col("rep").alias("b"), "own")
    near = (left.join(right, ["part", "key"]).where((~F.col("own") | (F.col("fp_a") < F.col("fp_b"))) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius)).select("a", "b"))
    held = rows.join(crowded, ["part", "key"], "left_semi").select("fp", "rep").distinct()
    flips = [F.col("fp").bitwiseXOR(F.lit(mask([b]))) for b in range(64)]
    met = held.select("rep", F.explode(F.array(F.col("fp"), *flips)).alias("word"))
    least = met.groupBy("word").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1").select("word", "b")
    hubs = met.join(least, "word").where("rep <> b").select(F.col("rep").alias("a"), "b")
    return near.unionByName(hubs)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, bucket: int = BUCKET, carry: Sequence[str] = ()) -> DataFrame:
    """(key, fingerprint, component_id, kept, carried columns): component_id is the smallest key reachable by links, kept its row.

    Null texts and texts without words have fingerprint 0 and are linked like any other; a null key stays out of the
    links and has a null component_id and kept true; repeated keys count as one; an empty table gives no rows. Other
    columns are ignored.
    """
    if radius != RADIUS:
        raise ValueError(f"links are complete for a radius of {RADIUS} alone")
    prints = written(fingerprints(docs, key, text, carry).withColumnRenamed(key, "__id"), "fingerprints")
    classes = written(prints.where("__id is not null").groupBy("fp").agg(F.min("__id").alias("rep")), "classes")
    tied = components(links(classes, radius, bucket)).withColumnRenamed("node", "rep")
    named = classes.join(tied, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hot = written(prints.groupBy("fp").count().where(F.col("count") > HOT).select("fp", F.lit(True).alias("hot")), "hot-fingerprints")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    named = named.join(hot, "fp", "left").withColumn("salt", F.explode(salts)).drop("hot")
    dealt = prints.join(hot, "fp", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("__id"), F.lit(SALTS))).otherwise(0).cast("int"))
    out = dealt.join(named, ["fp", "salt"], "left").withColumn("component_id", F.when(F.col("__id").isNotNull(), F.col("component_id")))
    return out.select(F.col("__id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(True)).alias("kept"), *carry)


def brute_force(rows: list[tuple[int, bytes | None]], radius: int = RADIUS) -> dict[int, tuple[str, int]]:
    """What near_duplicates finds, by comparing all pairs; for tests on small fixtures."""
    prints = {k: fingerprint(t) & ((1 << 64) - 1) for k, t in rows}
    keys = sorted(prints)
    over = {k: k for k in keys}

    def root(k):
        while over[k] != k:
            k = over[k]
        return k

    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                low, high = sorted((root(a), root(b)))
                over[high] = low
    return {k: (f"{prints[k]:016x}", root(k)) for k in keys}
