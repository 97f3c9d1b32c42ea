"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

Words are read twice, as lower-cased words without outer marks and as shapes (runs of capitals, letters, digits and
each other sign, shortened to one). Single words, and pairs of neighbours, of both readings are hashed to weights; the
second of two equal neighbours counts as a mark for "the same again". A text's features are its counts per word, so a score is
one sparse dot product: the mean weight of its n-grams.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Growing, WordCodes, map_texts, sample_rows, sums, texts_of, words_in

#: At most so many labelled texts of each class are learned from.
FIT_ROWS = 3000
BUCKETS = 1 << 16
THRESHOLD = 0.3
SAME = np.uint64(0x5851F42D4C957F2D)
OUTER = re.compile(r"^[\W_]+|[\W_]+$")
RUNS = ((re.compile(r"[^\W\d_]*[^\W\d_A-Z]+[^\W\d_]*"), "x"), (re.compile(r"[A-Z]+"), "X"), (re.compile(r"\d+"), "9"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))


def shape(word: str) -> str:
    """Capital runs as X, other letter runs as x, digits as 9, signs as they are, doubled if repeated."""
    for pattern, by in RUNS:
        word = pattern.sub(by, word)
    return word[:16]


def h64(text: str) -> int:
    raw = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x9E3779B9)


class Features:
    """Hashed n-gram ids of texts, kept per word for words met before."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = np.uint64(buckets)
        self.word, self.shape = Growing(np.uint64), Growing(np.uint64)
        self.codes = WordCodes(self.grow, self.restart)

    def restart(self):
        self.word.clear()
        self.shape.clear()

    def grow(self, words):
        texts = [w.decode("utf-8", "replace") for w in words]
        self.word.extend(np.array([h64("w" + OUTER.sub("", t.lower())) for t in texts], np.uint64))
        self.shape.extend(np.array([h64("s" + shape(t)) for t in texts], np.uint64))

    def fold(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) % self.buckets).astype(np.int64)

    def pairs(self, h: np.ndarray) -> np.ndarray:
        a, b = h[:-1], h[1:]
        again = a == b
        return self.fold(np.where(again, SAME, a * np.uint64(3)) ^ np.where(again, SAME >> np.uint64(7), b * np.uint64(0x100000001B3)))

    def ids(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(4 x words) bucket ids of all words of the texts: word, word pair, shape, shape pair (a pair belongs to its first word; -1 at a text's end), and word counts."""
        words, n = words_in(texts)
        codes = self.codes(words)
        if not len(codes):
            return np.zeros((4, 0), np.int64), n
        last = np.zeros(len(codes), bool)
        last[np.cumsum(n)[n > 0] - 1] = True
        out = []
        for h in (self.word.all[codes], self.shape.all[codes]):
            two = np.append(self.pairs(h), 0)
            two[last] = -1
            out += [self.fold(h), two]
        return np.array(out), n


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def sparse(features: Features, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text's n-grams and their counts per word."""
    ids, n = features.ids([text])
    found, count = np.unique(ids[ids >= 0], return_counts=True)
    return found, count / max(n[0], 1)


def train(texts: list[bytes], y: list[int], buckets: int = BUCKETS, rounds: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 3) -> Model:
    """FTRL-proximal, one text at a time in a fixed random order."""
    features = Features(buckets)
    rows = [sparse(features, t) for t in texts]
    z, n, rng = np.zeros(buckets + 1), np.zeros(buckets + 1), np.random.default_rng(seed)

    def at(ids):
        rate = (beta + np.sqrt(n[ids])) / alpha + l2
        return np.where(np.abs(z[ids]) <= l1, 0.0, -(z[ids] - np.sign(z[ids]) * l1) / rate)

    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            ids, x = np.append(rows[i][0], buckets), np.append(rows[i][1], 1.0)
            w = at(ids)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y[i]) * x
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    w = at(np.arange(buckets + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.features = model, Features(len(model.weights))

    def scores(self, texts: list) -> np.ndarray:
        ids, n = self.features.ids(texts)
        w = np.where(ids >= 0, self.model.weights[ids], 0.0).sum(axis=0)
        return 1 / (1 + np.exp(-np.clip(sums(w, n) / np.maximum(n, 1) + self.model.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Learns from at most `rows` labelled texts of each class; without any, every text scores a half. Of rows that repeat a key the least label and the least text count."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("y")).groupBy(key).agg(F.min("y").alias("y"))
    chosen = sample_rows(known.where("y = 1"), key, rows).unionByName(sample_rows(known.where("y = 0"), key, rows))
    held = texts_of(docs, chosen, key, text).orderBy("__id").collect()
    return train([(r["__text"] or "").encode("utf-8", "replace") for r in held], [r["y"] for r in held])


def score(docs: DataFrame, model: Model, text: str = "text", keep: list | None = None, out: str = "score", predicted: str = "predicted", threshold: float = THRESHOLD) -> DataFrame:
    """Adds a probability and its 0/1 decision to every row; null, empty and wordless texts score by the constant alone.

    Columns of the new names are replaced; all others, and repeated rows, stay.
    """

    def setup():
        scorer = Scorer(model)

        def work(texts):
            s = scorer.scores(texts)
            return {out: s, predicted: (s >= threshold).astype(np.int32)}

        return work

    return map_texts(docs, text, setup, [(out, T.DoubleType()), (predicted, T.IntegerType())], keep)
