"""I-Match fingerprints over several randomised lexicons.

A text's terms that stand in a band of document frequency, which leaves out what is in many texts and what is in next to
none, are its kept terms. Each of SUBSETS random orders of the lexicon gives a ladder of subsets, an eighth, a
thirty-second, ... of the terms, and the sorted kept terms of each subset are hashed. Long texts differ in every large
subset after small edits, while short ones have no term in a small one; so the ladder has for texts of any length
subsets in which one or two of their terms fall. Two fingerprints' likeness is read from how many subsets are empty in
both and how many are equal: of u terms in either text, of which d are in one alone, a subset that takes each with
probability f is empty with (1-f)^u and equal with (1-f)^d, so that 1 - ln(equal)/ln(empty) estimates the share of
terms in common.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import TERM_BYTES, numbered, slices, workers_import, written

#: Kept terms stand in at least LOW and at most HIGH of the documents, and in two at least. Terms that stand in a share LOW of
#: the documents are at most (distinct terms of a mean document) / LOW, so that the lexicon, 8 bytes a term, doesn't grow with the documents.
LOW, HIGH = 1 / 2000, 1 / 20
SUBSETS, RUNGS = 16, 5
SEED = 12
#: Longer terms stand for themselves by a digest.
LONG = 48
#: Terms and bytes that a task counts before it hands on what it has.
COUNTED, COUNTED_BYTES = 400_000, 64 << 20
#: Terms that a task remembers.
MET = 300_000
EMPTY = "0" * 8
MIXERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def terms(text: bytes) -> set[bytes]:
    """The distinct terms: runs of ASCII letters, lower-cased, and of characters beyond ASCII."""
    found = set(text.translate(TERM_BYTES).split())
    if max(map(len, found), default=0) <= LONG:
        return found
    return {t if len(t) <= LONG else b"#" + hashlib.blake2b(t, digest_size=16).hexdigest().encode() for t in found}


def code_of(term: bytes) -> int:
    """64 bits, signed, by which terms are counted; two terms that share them, which is next to never, count as one."""
    return xxhash.xxh64_intdigest(term, SEED) - (1 << 63)


def document_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term: its code, df): how many texts have each term; tasks count their own texts first."""

    def run(batches):
        held: Counter = Counter()
        n_bytes = 0

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(list(map(code_of, held)), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])
            held.clear()
            return made

        for batch in batches:
            for part in slices(batch, 0):
                for x in part.column(0).to_pylist():
                    if x:
                        held.update(terms(x))
                        n_bytes += len(x)
                if len(held) > COUNTED or n_bytes > COUNTED_BYTES:
                    n_bytes = 0
                    yield out()
        if held:
            yield out()

    sent = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("__text"))
    return sent.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, text: str, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """The codes of the band's terms, sorted; at most (mean distinct terms) / low of them."""
    n = docs.count()
    kept = document_counts(docs, text).where((F.col("df") >= max(2, math.ceil(low * n))) & (F.col("df") <= math.floor(high * n)))
    return np.sort(np.array([r.term for r in kept.select("term").collect()], np.int64))


class Fingerprints:
    """Fingerprints of texts: the hash of all kept terms, then of those in each subset, eight hexadecimals each, zeros for none.

    A text without kept terms is taken by all its terms, one without terms by its characters.
    """

    def __init__(self, lexicon: np.ndarray, subsets: int = SUBSETS, rungs: int = RUNGS, seed: int = SEED):
        self.lexicon, self.subsets, self.rungs = np.append(lexicon, np.iinfo(np.int64).max), subsets, rungs
        self.met: set[bytes] = set()
        self.slots: dict[bytes, list[int]] = {}  # of terms met that are in the lexicon: where they are hashed
        self.salts = np.array([xxhash.xxh64_intdigest(str(j), seed) for j in range(subsets)], np.uint64)

    def depths(self, hashes: np.ndarray) -> np.ndarray:
        """For each term and subset, on how many rungs it is in: on rung r with probability 2 ** -(2 * r + 3)."""
        x = hashes[:, None] ^ self.salts[None]
        for k, m in zip((30, 27, 31), MIXERS):
            x = (x ^ (x >> np.uint64(k))) * m
        x ^= x >> np.uint64(31)
        return sum((x < np.uint64(1 << (61 - 2 * r))).astype(np.int8) for r in range(self.rungs))

    def places(self, words: list[bytes], codes: np.ndarray) -> dict[bytes, list[int]]:
        """The subsets that each word is in, by number."""
        found = {}
        for w, row in zip(words, self.depths(codes.view(np.uint64)).tolist()):
            found[w] = [k for j, d in enumerate(row) if d for k in range(j * self.rungs, j * self.rungs + d)]
        return found

    def learn(self, fresh: list[bytes]) -> None:
        codes = np.array([code_of(w) for w in fresh], np.int64)
        at = np.searchsorted(self.lexicon[:-1], codes)
        inside = np.nonzero(self.lexicon[at] == codes)[0]
        self.slots.update(self.places([fresh[k] for k in inside.tolist()], codes[inside]))
        self.met.update(fresh)

    def __call__(self, text: bytes) -> str:
        every = terms(text)
        if len(self.met) > MET:
            self.met.clear()
            self.slots.clear()
        fresh = list(every - self.met)
        if fresh:
            self.learn(fresh)
        slots, kept = self.slots, sorted(every & self.slots.keys())
        if every and not kept:
            kept = sorted(every)
            slots = self.places(kept, np.array([code_of(w) for w in kept], np.int64))
        held: list[list[bytes]] = [[] for _ in range(self.subsets * self.rungs)]
        for t in kept:
            for k in slots[t]:
                held[k].append(t)
        return code(kept or [b"\x00", text]) + "".join([code(x) if x else EMPTY for x in held])


def code(parts: list[bytes]) -> str:
    return hashlib.blake2b(b" ".join(parts), digest_size=4).hexdigest()


def likeness(a: str, b: str, rungs: int = RUNGS) -> float:
    """From 0 to 1: terms in common as a share of the two texts' mean number of kept terms, estimated; 1 for equal fingerprints alone."""
    if a == b:
        return 1.0
    x, y = ([s[k : k + 8] for k in range(8, len(s), 8)] for s in (a, b))
    apart = total = 0.0
    for r in range(rungs):
        pairs = list(zip(x[r::rungs], y[r::rungs]))
        empty, equal = sum(p == q == EMPTY for p, q in pairs), sum(p == q for p, q in pairs)
        if 0 < empty < len(pairs):
            apart, total = apart - math.log(equal / len(pairs)), total - math.log(empty / len(pairs))
    share = 1 - apart / total if total else 0.0
    return min(2 * share / (1 + share), 0.999)


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the next one, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(part, ahead, id, text): documents dealt into parts of consecutive ids, sorted within them; after each part's rows (ahead = 1) the first of the next part's, after the last part's the first of all.

    Bounds of parts are ids that stand, as many as there are shuffle partitions: only they go to the driver. Null ids come first; rows that
    share an id stand by a hash of their text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__h", F.xxhash64("__text"))
    ids = numbered(written(rows.select(F.lit(0).alias("all"), "__id", "__h"), "ids"), "all", ["__id", "__h"])
    some = ids.where(F.col("idx") % F.ceil(F.col("n") / parts) == 0).select("__id", "__h").collect()
    place = lambda i, h: (i is not None and i == i, 0 if i is None or i != i else i, h)
    bounds = sorted({place(*r) for r in some})

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def dealt(i: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for k in map(place, i.tolist(), h.tolist()):
            at = max(bisect_right(bounds, k) - 1, 0)
            out.append([at, ~((at - 1) % len(bounds))] if bounds and bounds[at] == k else [at])
        return pd.Series(out)

    workers_import(spark)
    sent = rows.withColumn("__to", F.explode(dealt(F.col("__id"), F.col("__h"))))
    sent = sent.select(F.greatest("__to", -F.col("__to") - 1).alias("part"), F.when(F.col("__to") < 0, 1).otherwise(0).alias("ahead"), "__id", "__h", "__text")
    return sent.repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("part", "ahead", "__id", "__h").drop("__h")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", low: float = LOW, high: float = HIGH, change: Callable[[str, str], str] = edited) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each document.

    Document counts are of all texts. A null text counts as empty; null keys stand first and rows that share a key by a hash of their
    text; the last document's next is the first, a lone document's next is itself. Other columns are not read. change: the edited text, from a text and the next.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text, low, high))
    type_ = docs.schema[key].dataType
    schema = T.StructType([T.StructField("__id", type_), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], *[T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]])

    def run(batches):
        prints = Fingerprints(shared.value)
        wait = None  # the row that waits for the next one: part, id, text, fingerprint
        kind = None

        def row(now: tuple, after: str, print_: str) -> tuple:
            made = change(now[2], after)
            raw = made.encode()
            other = now[3] if made == now[2] else prints(raw)
            return now[1], len(now[2]), hashlib.sha256(raw).hexdigest(), now[3], other, likeness(now[3], other), likeness(now[3], print_)

        for batch in batches:
            kind = batch.schema.field(2).type
            for part in slices(batch, 3):
                made = []
                for at, ahead, id_, raw in zip(*[c.to_pylist() for c in part.columns]):
                    if ahead and wait is None:
                        continue  # a repetition of the next part's first row
                    print_, s = prints(raw), raw.decode()
                    if wait is not None:
                        made.append(row(wait, s, print_))
                    wait = None if ahead else (at, id_, s, print_)
                if made:
                    yield batch_of(made, kind)

    def batch_of(made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=schema.names)

    sent = in_order(docs, key, text).withColumn("__text", F.col("__text").cast("binary"))
    return sent.mapInArrow(run, schema).withColumnRenamed("__id", key)
