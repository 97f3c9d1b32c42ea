"""Language identification by averaged hashed subword embeddings under a linear softmax.

A word's subwords (1 to 4 letters, with word ends marked) are hashed to rows of an embedding table; a text is the
mean of its subwords' rows, and a linear softmax over it gives the languages. Both tables are trained by stochastic
gradient descent in numpy on whole texts and short runs of words; each row's and weight's step is divided by the root of its
squared gradients so far, as subwords are met unequally often. As the softmax input is linear in the subwords, the
two tables are multiplied once after training, so that scoring adds one short row per subword. A temperature, fitted
on texts left out of the training, calibrates the probabilities; the rejection threshold is the smallest confidence
above which those texts are more often right than wrong, at most REJECT_MOST.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Growing, WordCodes, labelled, map_texts, sample_rows, slices_of, sums, texts_of, trim, words_in, workers_import

#: At most so many labelled texts of each language are learned from; a fifth of them calibrates.
FIT_ROWS = 600
BUCKETS = 1 << 12
WIDTH = 16
SIZES = (1, 2, 3, 4)
REJECT_MOST = 0.4
UNKNOWN = "und"
#: Subwords of so many new words are worked out at a time: of all of a slice's they take hundreds of MB.
GROW_WORDS = 1 << 11
#: Characters of the letter categories; ½, ② and Ⅷ are numbers.
LETTERS = regex.compile(r"\p{L}+")


def letters(word: str) -> str:
    """The letters of a written word, lower-cased, with its runs parted by a mark."""
    return "\x01".join(LETTERS.findall(word.lower()))


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed subwords of all words, one word's after the other's, and how many each word has; no letters: none."""
    marked = [f"\x01{w}\x01" if w else "" for w in words]
    lengths = np.array([len(w) for w in marked], np.int64)
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    ids, owners = [], []
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(len(chars))
    for n in SIZES:
        at = np.nonzero(left >= n)[0]
        h = np.full(len(at), n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(n):
            h = (h ^ chars[at + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        ids.append((h % np.uint64(buckets)).astype(np.int64))
        owners.append(owner[at])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.bincount(owners, minlength=len(words))


@dataclass
class Model:
    """table: buckets x languages; bias: of each language; threshold: calibrated confidence under which a text is rejected."""

    langs: list = field(default_factory=list)
    table: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        k = len(model.langs)
        self.rows, self.n = Growing(np.float64, k), Growing(np.int64)
        self.codes = WordCodes(self.grow, self.restart)

    def restart(self):
        self.rows.clear()
        self.n.clear()

    def grow(self, words):
        for a in range(0, len(words), GROW_WORDS):
            ids, n = subwords([letters(w.decode("utf-8", "replace")) for w in words[a : a + GROW_WORDS]], len(self.model.table))
            self.rows.extend(sums(self.model.table[ids], n))
            self.n.extend(n)

    def logits(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Untempered logits, and whether a text has any letter."""
        words, lengths = words_in(texts)
        codes = self.codes(words)
        n = sums(self.n.all[codes], lengths)
        return sums(self.rows.all[codes], lengths) / np.maximum(n, 1)[:, None] + self.model.bias, n > 0

    def predict(self, texts: list) -> tuple[list, np.ndarray]:
        if not self.model.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x, some = self.logits(texts)
        p = softmax(x / self.model.temperature)
        best = p.argmax(axis=1)
        score = np.where(some, p[np.arange(len(p)), best], 0.0)
        return [self.model.langs[b] if s else UNKNOWN for b, s in zip(best, some)], np.clip(score, 0, 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(texts: list[bytes], langs: np.ndarray, rng: np.random.Generator, buckets: int) -> tuple[list, np.ndarray]:
    """(subwords, their shares) of whole texts and of two short runs of each one's words, and their languages."""
    rows, y = [], []
    for t, lang in zip(texts, langs):
        ids, n = subwords([letters(w) for w in t.decode("utf-8", "replace").split()], buckets)
        if not len(ids):
            continue
        ends = np.cumsum(n)
        spans = [(0, len(n))]
        for _ in range(2):
            a = int(rng.integers(0, len(n)))
            spans.append((a, min(len(n), a + int(rng.integers(2, 13)))))
        for a, b in spans:
            lo, hi = ends[a] - n[a], ends[b - 1]
            if hi > lo:
                found, count = np.unique(ids[lo:hi], return_counts=True)
                rows.append((found.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), (count / (hi - lo)).astype(np.float32)))
                y.append(lang)
    return rows, np.array(y, np.int64)


def together(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """The subwords of some examples, and the examples' shares of each."""
    used, at = np.unique(np.concatenate([ids for ids, _ in rows]), return_inverse=True)
    shares = np.zeros((len(rows), len(used)), np.float32)
    shares[np.repeat(np.arange(len(rows)), [len(ids) for ids, _ in rows]), at] = np.concatenate([w for _, w in rows])
    return used, shares


def train(texts: list[bytes], langs: list[str], buckets: int = BUCKETS, width: int = WIDTH, rounds: int = 12, rate: float = 0.1, seed: int = 5) -> Model:
    """Stochastic gradient descent on four fifths of the texts; temperature and threshold come from the others."""
    names = sorted(set(langs))
    if not names:
        return Model()
    y = np.array([names.index(v) for v in langs])
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2 if len(y) >= 20 else np.zeros(len(y), bool)
    x, t = examples([v for v, h in zip(texts, held) if not h], y[~held], rng, buckets)
    emb = rng.normal(0, 0.1, (buckets, width)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (width, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    emb_sq, out_sq, bias_sq = np.full(buckets, 1e-10, np.float32), np.full(out.shape, 1e-8, np.float32), np.full(len(names), 1e-2, np.float32)
    step, total = 0, max(1, rounds * ((len(x) + 31) // 32))
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 32):
            b = order[a : a + 32]
            lr = rate * (1 - step / total)  # each row's and weight's step is divided by the root of its squared gradients so far
            step += 1
            used, sub = together([x[i] for i in b])
            h = sub @ emb[used]
            g = softmax(h @ out + bias)
            g[np.arange(len(b)), t[b]] -= 1
            g /= len(b)
            back = g @ out.T
            d_out, d_bias, d_emb = h.T @ g, g.sum(axis=0), sub.T @ back
            out_sq += d_out**2
            bias_sq += d_bias**2
            emb_sq[used] += (d_emb**2).mean(axis=1)
            out -= lr * d_out / np.sqrt(out_sq)
            bias -= lr * d_bias / np.sqrt(bias_sq)
            emb[used] -= lr * d_emb / np.sqrt(emb_sq[used])[:, None]
    model = Model(names, (emb @ out).astype(np.float64), bias.astype(np.float64))
    rest = held if held.any() else np.ones(len(y), bool)
    scorer, left = Scorer(model), [v for v, h in zip(texts, rest) if h]
    logits, some = (np.concatenate(x) for x in zip(*[scorer.logits(part) for part in slices_of(left)])) if left else (np.zeros((0, len(names))), np.zeros(0, bool))
    logits, truth = logits[some], y[rest][some]
    if len(truth):
        loss = lambda s: -np.log(softmax(logits / s)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.2, 20, 60), key=loss))
        p = softmax(logits / model.temperature)
        model.threshold = rejection(p.max(axis=1), p.argmax(axis=1) == truth)
    return model


def rejection(confidence: np.ndarray, right: np.ndarray) -> float:
    """The smallest threshold such that texts below it are more often wrong than right, at most REJECT_MOST."""
    order = np.argsort(confidence)
    wrong = np.cumsum(np.where(right[order], -1, 1))
    if not len(wrong) or wrong.max() <= 0:
        return 0.0
    return float(min(confidence[order][int(wrong.argmax())] + 1e-9, REJECT_MOST))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Learns from at most `rows` texts of each language that is known of any row; none: every text gets `und`. One task learns from the bounded sample, and only the model goes to the driver. Of rows that repeat a key the least language and the least text count."""
    known = labelled(docs.where(F.col(text).isNotNull()), key, lang, "__lang")
    held = texts_of(docs, sample_rows(known, key, rows, "__lang"), key, text).where("__text is not null").select("__id", F.col("__text").cast("binary").alias("__text"), "__lang")

    def learn(batches):
        trim()
        rows = [r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[0] for r in rows], [r[1] for r in rows]))], pa.binary())], names=["model"])

    workers_import(docs.sparkSession)
    made = held.repartition(1).sortWithinPartitions("__id").mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0].model) if made else Model()


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list | None = None, pred: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """Adds the language, its calibrated probability and whether it is rejected to every row.

    Null texts and texts without letters get `und`, score 0 and are rejected. Columns of the new names are replaced;
    all others, and repeated rows, stay.
    """

    def setup():
        scorer = Scorer(model)

        def work(texts):
            langs, p = scorer.predict(texts)
            return {pred: langs, score: p, rejected: [v == UNKNOWN or bool(s < model.threshold) for v, s in zip(langs, p)]}

        return work

    return map_texts(docs, text, setup, [(pred, T.StringType()), (score, T.DoubleType()), (rejected, T.BooleanType())], keep)
