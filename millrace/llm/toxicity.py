"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts.

A word's probability after another is the pair's discounted count (of distinct surroundings in texts of the class, so
copies of a text add nothing), which backs off to the word's discounted continuation count (distinct words before it in texts
of the class), then over ever shorter beginnings, of eight to two letters, whose counts
are distinct word types with that beginning. What a step hands down is parted by the same counts over the whole corpus,
all of its words and beginnings (distinct words before each word by a sketch of 256 bits, whose standard error is about 17%), and the mass handed down is the
same for both classes, so what neither class has seen tells for neither. A text's evidence is the log-likelihood ratio per word, over the text and over its strongest windows of
the lengths in WINDOWS, a word repeated at once counting once; a logistic fit on labelled texts that the counts left out turns them into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Growing, WordCodes, give_back, map_texts, sample_rows, slices, spread, sums, texts_of, trim, trimmed, words_in, workers_import, written

#: At most so many labelled texts of each class give the class counts, and so many of both the calibration.
COUNT_ROWS = 2000
FIT_ROWS = 2500
#: Units whose words before a task gathers, when it counts the corpus, before it hands them on.
TASK_UNITS = 100_000
#: Sketch of the words before a word: sets of SLOTS bits; set k gets a share 3 / 4 ** (k + 1) of all words, the last one the rest.
SETS, SLOTS = 8, 32
FULL = 28
WINDOWS = (3, 12)
THRESHOLD = 0.3
#: Pairs of words are counted by distinct words so many places before and after them.
AROUND = 4
LEVELS = (8, 7, 6, 5, 4, 3, 2)
LETTERS = re.compile(r"[^\W\d_]+")
LETTERS_OR_END = re.compile(r"[^\W\d_]+|\n")


def units(word: str) -> list[str]:
    return LETTERS.findall(word.lower())


class Pairs:
    """Log-likelihood ratios of pairs (word before, word); the text's start is a word too, ''. Held as sorted arrays, as there may be very many."""

    def __init__(self, before: list = (), words: list = (), llr=()):
        self.ids = {w: i for i, w in enumerate(dict.fromkeys([*before, *words]))}
        keys = np.array([self.ids[a] << 32 | self.ids[b] for a, b in zip(before, words)], np.int64)
        order = np.argsort(keys)
        self.keys, self.llr = keys[order], np.asarray(llr, np.float64)[order]

    def put(self, before: np.ndarray, words: np.ndarray, llr: np.ndarray) -> None:
        """Sets llr where the pair of these ids (-1: none) is known."""
        if not len(self.keys):
            return
        both = np.nonzero((before >= 0) & (words >= 0))[0]
        keys = before[both] << 32 | words[both]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        llr[both[hit]] = self.llr[at[hit]]


@dataclass
class Model:
    """words, starts: log-likelihood ratios of known words and of word beginnings; pairs: of known words after a known word; weights: of the text's and each window's evidence, then the constant."""

    words: dict = field(default_factory=dict)
    starts: dict = field(default_factory=dict)
    pairs: Pairs = field(default_factory=lambda: Pairs())
    weights: tuple = (0.0, 0.0, 0.0, -2.0)
    windows: tuple = WINDOWS

    def ratios(self, words: list) -> np.ndarray:
        """Each word's ratio, else that of its longest known beginning, else 0."""
        out = list(map(self.words.get, words))
        rest = [i for i, v in enumerate(out) if v is None]
        for k in LEVELS:
            for i in rest:
                if len(words[i]) >= k:
                    out[i] = self.starts.get(words[i][:k])
            rest = [i for i in rest if out[i] is None]
        return np.array([0.0 if v is None else v for v in out], np.float64)


class Scorer:
    """Evidence of texts, with what each word adds kept for words met before."""

    def __init__(self, model: Model):
        self.model = model
        self.llr, self.ids = Growing(np.float64), Growing(np.int64)
        self.read = Sequences(self.grow, self.restart)

    def restart(self):
        self.llr.clear()
        self.ids.clear()

    def grow(self, words):
        self.llr.extend(self.model.ratios(words))
        self.ids.extend(np.array([self.model.pairs.ids.get(w, -1) for w in words], np.int64))

    def evidence(self, texts: list) -> np.ndarray:
        codes, lengths, coded, n = self.read(texts)
        of_unit, ids = self.llr.all[coded], self.ids.all[coded]
        first = self.model.pairs.ids.get("", -1)
        before = before_each(coded, n, lengths)
        self.model.pairs.put(np.where(before < 0, first, self.ids.all[before]) if len(coded) else ids, ids, of_unit)
        llr = sums(of_unit, n)
        if len(codes):
            again = np.concatenate([[False], codes[1:] == codes[:-1]])
            again[(np.cumsum(lengths) - lengths)[lengths > 0]] = False  # a text's first word
            llr[again] = 0.0  # a word said twice in a row is evidence once
        whole = sums(llr, lengths) / np.maximum(sums(n, lengths), 1)
        best, at = np.zeros((len(texts), len(self.model.windows))), 0
        for i, n in enumerate(lengths):
            if n:
                run = np.concatenate([[0.0], np.cumsum(llr[at : at + n])])
                best[i] = [max(0.0, (run[min(k, n) :] - run[: len(run) - min(k, n)]).max()) / k for k in self.model.windows]
            at += n
        return np.column_stack([whole, best])

    def scores(self, texts: list) -> np.ndarray:
        w = np.array(self.model.weights)
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts) @ w[:-1] + w[-1], -30, 30)))


def word_pairs(texts: list) -> dict:
    """Distinct (word before, word, words around) of each text; the text's start counts as a word."""
    out = {"before": [], "word": [], "around": []}
    for t in texts:
        w = units((t or b"").decode("utf-8", "replace"))
        padded = [*[""] * (AROUND + 1), *w, *[""] * AROUND]
        pairs = dict.fromkeys(zip(padded[AROUND:], w, (f"{a} {b}" for a, b in zip(padded, padded[2 * AROUND + 1 :]))))
        for k, held in zip(out, zip(*pairs) if pairs else ((), (), ())):
            out[k].append(list(held))
    return out


def discounts(counts: np.ndarray, n: list | None = None) -> np.ndarray:
    """Counts less absolute discounts for 1, 2 and more, by counts of counts (n: of 1 to 4); a count of 1 is given up whole."""
    n = n or [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    y = n[0] / max(n[0] + 2 * n[1], 1)
    d2 = min(max(2 - 3 * y * n[2] / max(n[1], 1), 0.5), 1.9)
    d3 = min(max(3 - 4 * y * n[3] / max(n[2], 1), 0.5), 2.5)
    return counts - np.select([counts <= 1, counts == 2], [counts, d2], d3).astype(float)


def level(found: tuple[dict, dict], shared: dict, above) -> dict:
    """{unit: (toxic, ordinary)} of one level. shared: {unit: its share of what units one level down hand on}; above(unit) gives the probabilities one level down."""
    kept = []
    total = []
    for c in found:
        names = list(c)
        less = discounts(np.array([c[w] for w in names], float)) if names else np.zeros(0)
        kept.append(dict(zip(names, less)))
        total.append((less.sum(), sum(c.values())))
    lam = 1 - sum(a for a, _ in total) / max(sum(b for _, b in total), 1)
    lam = min(max(lam, 0.05), 0.95)
    out = {}
    for w, part in shared.items():
        down = above(w)
        out[w] = tuple((1 - lam) * kept[c].get(w, 0.0) / max(total[c][0], 1e-9) + lam * part * down[c] for c in (0, 1))
    return out


def start(word: str) -> str:
    """The longest of the beginnings that a word backs off to; one-letter words have none."""
    return next((word[:k] for k in LEVELS if len(word) >= k), "")


def fit_probabilities(continuations: tuple[dict, dict], shares: dict, start_shares: dict) -> tuple[dict, dict]:
    """({word: probabilities}, {beginning: probabilities}) of toxic and ordinary texts.

    continuations: {word: distinct words before it} of toxic and ordinary texts; shares, start_shares: see corpus_shares.
    """
    types = [[Counter() for _ in LEVELS] for _ in (0, 1)]
    for c in (0, 1):
        for w in continuations[c]:
            for i, k in enumerate(LEVELS):
                if len(w) >= k:
                    types[c][i][w[:k]] += 1
    starts: dict = {"": (1.0, 1.0)}
    for i in range(len(LEVELS) - 1, -1, -1):
        last = LEVELS[i + 1] if i + 1 < len(LEVELS) else 0
        starts |= level((types[0][i], types[1][i]), {u: start_shares[u] for u in types[0][i] + types[1][i]}, lambda u, k=last: starts[u[:k]])
    words = level(continuations, shares, lambda w: starts[start(w)])
    return words, starts


def ratios(probabilities: dict) -> dict:
    return {w: math.log(a / b) for w, (a, b) in probabilities.items()}


def pair_ratios(pairs: DataFrame, words: dict, starts: dict) -> Pairs:
    """The highest order: discounted counts of pairs among those with their word before, backed off to the word's own probability.

    pairs: (y, before, word, n). The mass handed down after a word is the same for both classes, so a pair that neither
    keeps tells what its word tells. A class that keeps no pair after a word hands down all.
    """
    by = pairs.groupBy("before", "word").agg(*[F.sum(F.when(F.col("y") == 1 - c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)])
    of_n = {(1 - r.y, r.n): r["count"] for r in pairs.where("n <= 4").groupBy("y", "n").count().collect()}
    of_n = [[of_n.get((c, k), 0) for k in (1, 2, 3, 4)] for c in (0, 1)]
    kept = by.where("n0 > 1 or n1 > 1").join(pairs.groupBy("before").agg(F.sum("n").alias("total")), "before").toArrow()
    if not kept.num_rows:
        return Pairs()
    before, word = kept["before"].to_pylist(), kept["word"].to_pylist()
    _, at = np.unique(kept["before"].combine_chunks().dictionary_encode().indices.to_numpy(), return_inverse=True)
    less = [discounts(kept[f"n{c}"].to_numpy().astype(float), of_n[c]) * (kept[f"n{c}"].to_numpy() > 1) for c in (0, 1)]
    whole = [np.bincount(at, x)[at] for x in less]
    lam = np.clip(1 - (whole[0] + whole[1]) / kept["total"].to_numpy(), 0.05, 0.95)
    down = [np.array([words[w][c] if w in words else starts[start(w)][c] for w in word]) for c in (0, 1)]
    p = [np.where(whole[c] > 0, (1 - lam) * less[c] / np.maximum(whole[c], 1e-9) + lam * down[c], down[c]) for c in (0, 1)]
    return Pairs(before, word, np.log(p[0] / p[1]))


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple:
    """Logistic weights by Newton's method, with a ridge and some ordinary texts without evidence either way."""
    k = x.shape[1] + 1
    rows = np.vstack([np.column_stack([x, np.ones(len(x))]), np.tile(np.eye(k)[-1], (20, 1))])
    y = np.append(y.astype(float), np.zeros(20))
    scale = np.maximum(np.abs(rows).max(axis=0), 1e-9)
    rows, w = rows / scale, np.zeros(k)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        grad = rows.T @ (p - y) + 0.02 * w
        hess = (rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows + 0.02 * np.eye(k)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    w = w / scale
    return (*np.maximum(w[:-1], 0.0).tolist(), float(w[-1]))


class Sequences:
    """Texts as runs of numbered units, the pieces of written words that `units` gives; `grow` is called with new units. Number 0 is a line end, which no text holds."""

    def __init__(self, grow, restart):
        self.grow_units, self.restart_units = grow, restart
        self.flat, self.at, self.n = Growing(np.int64), Growing(np.int64), Growing(np.int64)
        self.codes = WordCodes(self.grow, self.restart)
        self.restart()

    def restart(self):
        self.index: dict = defaultdict(count().__next__, {})
        for held in (self.flat, self.at, self.n):
            held.clear()
        self.restart_units()
        self.grow_units(["\n" for _ in range(self.index["\n"] + 1)])

    def grow(self, words):
        parts = LETTERS_OR_END.findall(b"\n".join([*words, b""]).decode("utf-8", "replace").lower())
        before = len(self.index)
        codes = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        n = np.diff(np.nonzero(codes == 0)[0], prepend=-1) - 1
        self.at.extend(self.flat.n + np.cumsum(n) - n)
        self.n.extend(n)
        self.flat.extend(codes[codes > 0])
        self.grow_units(list(islice(reversed(self.index), len(self.index) - before))[::-1])

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of written words, written words of each text, numbers of units, units of each written word)."""
        words, lengths = words_in(texts)
        codes = self.codes(words)
        n = self.n.all[codes]
        return codes, lengths, self.flat.all[spread(self.at.all[codes], n)], n


def before_each(coded: np.ndarray, n: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The unit before each unit of a text; -1 for a text's first."""
    before = np.concatenate([[-1], coded[:-1]])[: len(coded)]
    per_text = sums(n, lengths).astype(np.int64)
    before[(np.cumsum(per_text) - per_text)[per_text > 0]] = -1
    return before


def slot(units: list[str]) -> np.ndarray:
    """The bit of the sketch that each unit sets as a word before another."""
    h = np.array([xxhash.xxh64_intdigest(u.encode("utf-8", "replace")) for u in units], np.uint64)
    x = h >> np.uint64(8)
    level = sum(((x & np.uint64((1 << 2 * k) - 1)) == 0).astype(np.int64) for k in range(1, SETS))
    return level * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64)


def distinct(sketch: list[Column]) -> Column:
    """About how many different words set the bits of a sketch, as SETS * SLOTS / 64 longs: linear counts of the first set that isn't too full and those after it."""
    ones = [F.bit_count(half) for c in sketch for half in (c.bitwiseAND(F.lit((1 << SLOTS) - 1)), F.shiftrightunsigned(c, SLOTS))]
    table = F.array(*[F.lit(-SLOTS * math.log(1 - min(k, SLOTS - 0.5) / SLOTS)) for k in range(SLOTS + 1)])
    counts = [F.element_at(table, o + 1) for o in ones]
    found = F.lit(None).cast("double")
    for k in range(SETS - 1, -1, -1):
        here = float(4**k) * sum(counts[k + 1 :], counts[k])
        found = here if k == SETS - 1 else F.when(ones[k] <= FULL, here).otherwise(found)
    return F.greatest(F.round(found), F.lit(1.0)).cast("long")


def corpus_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n): every word of all texts and about how many distinct words stand before it, as a written table.

    A task hands on one sketch a word for every TASK_UNITS words it meets; sketches of a word are put together by `or`, so
    what is shuffled is bounded by the words of each task and not by their pairs. The text's start is a word too.
    """
    workers_import(docs.sparkSession)
    names = [f"s{k}" for k in range(SETS * SLOTS // 64)]

    def run(batches):
        words: list = []
        slots = Growing(np.int64)
        seen = np.zeros((TASK_UNITS + TASK_UNITS // 4, SETS * SLOTS), bool)
        start = slot([""])

        def grow(new):
            words.extend(new)
            slots.extend(slot(new))

        def restart():
            words.clear()
            slots.clear()

        def flush():
            some = np.nonzero(seen[: len(words)].any(axis=1))[0]
            packed = np.packbits(seen[some], axis=1, bitorder="little").view("<i8")
            seen[: len(words)] = False
            return pa.RecordBatch.from_arrays([pa.array([words[i] for i in some.tolist()], pa.string()), *[pa.array(c) for c in packed.T]], names=["word", *names])

        read = Sequences(grow, restart)
        for batch in batches:
            for part in slices(batch, 0):
                if len(words) > TASK_UNITS:
                    yield flush()
                    read.codes.shrink()
                _, lengths, coded, n = read(part.column(0).to_pylist())
                if len(words) > len(seen):
                    held = seen
                    seen = np.zeros((max(len(words), 2 * len(held)), SETS * SLOTS), bool)
                    seen[: len(held)] = held
                before = before_each(coded, n, lengths)
                seen[coded, np.where(before < 0, start, slots.all[before])] = True
                give_back()
        yield flush()

    sent = docs.select(F.col(text).cast("string").cast("binary").alias("__text")).mapInArrow(trimmed(run), ", ".join(["word string", *[f"{c} long" for c in names]]))
    whole = sent.groupBy("word").agg(*[F.bit_or(c).alias(c) for c in names])
    return written(whole.select("word", distinct([F.col(c) for c in names]).alias("n")), "words")


def corpus_shares(words: DataFrame, needed: DataFrame, seen: DataFrame) -> tuple[dict, dict]:
    """What backing off needs of all words' counts, for the rows of needed (word) and for beginnings of the rows of seen (word).

    words: (word, n). First {word: its part of the counts of all words with the same longest beginning}, then {beginning:
    its part of the word types of all beginnings of its length that share the beginning one level down}. All other
    words and beginnings count in the whole; their own part tells for neither class, as it is the same factor in both.
    """
    first = lambda w: F.coalesce(*[F.when(F.length(w) >= k, F.substring(w, 1, k)) for k in LEVELS], F.lit(""))
    cuts = lambda w: F.explode(F.filter(F.array(*[F.when(F.length(w) >= k, F.substring(w, 1, k)) for k in LEVELS]), lambda x: x.isNotNull()))
    of_start = words.groupBy(first("word").alias("start")).agg(F.sum("n").alias("total"))
    rows = words.join(needed, "word").withColumn("start", first("word")).join(of_start, "start").select("word", F.col("n") / F.col("total"))
    types = written(words.select(cuts("word").alias("start")).groupBy("start").agg(F.count("*").alias("n")), "beginnings")
    below = {k: (LEVELS[i + 1] if i + 1 < len(LEVELS) else 0) for i, k in enumerate(LEVELS)}
    k = F.length("start")
    types = types.withColumn("k", k).withColumn("below", F.substring("start", F.lit(1), F.create_map(*[F.lit(x) for kv in below.items() for x in kv])[k]))
    whole = types.groupBy("k", "below").agg(F.sum("n").alias("total"))
    wanted = seen.select(cuts("word").alias("start")).distinct()
    starts = types.join(wanted, "start").join(whole, ["k", "below"]).select("start", F.col("n") / F.col("total"))
    return tuple(dict(zip(*(c.to_pylist() for c in df.toArrow().columns))) for df in (rows, starts))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", count_rows: int = COUNT_ROWS, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from rows of labels with a label of 0 or 1, of which at most 2 * count_rows + fit_rows texts are used; of rows that repeat a key the least label and the least text count.

    Without labelled rows of both classes, every text scores the same, about 0.1.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("y")).groupBy(key).agg(F.min("y").alias("y"))
    known = known.withColumn("fold", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("fold")), F.lit(4)))
    counted = sample_rows(known.where("fold > 0 and y = 1"), key, count_rows).unionByName(sample_rows(known.where("fold > 0 and y = 0"), key, count_rows))
    pairs = map_texts(texts_of(docs, counted, key, text), "__text", lambda: word_pairs, [(c, T.ArrayType(T.StringType())) for c in ("before", "word", "around")], ["y"])
    pairs = pairs.select("y", F.explode(F.arrays_zip("before", "word", "around")).alias("z")).select("y", "z.before", "z.word", F.xxhash64("z.around").alias("around")).distinct().groupBy("y", "before", "word").agg(F.count("*").alias("n"))
    found: tuple[dict, dict] = ({}, {})
    pairs = written(pairs, "labelled-pairs")
    counts = pairs.groupBy("y", "word").count()
    for r in counts.toLocalIterator():
        found[1 - r.y][r.word] = r["count"]
    if not found[0] or not found[1]:
        return Model()
    needed = counts.where("count > 1").select("word").union(pairs.where("n > 1").select("word")).distinct()
    words, starts = fit_probabilities(found, *corpus_shares(corpus_words(docs, text), needed, counts.select("word").distinct()))
    model = Model(ratios(words), ratios({u: p for u, p in starts.items() if u}), pair_ratios(pairs, words, starts))
    held = texts_of(docs, sample_rows(known.where("fold = 0"), key, fit_rows), key, text)
    if held.isEmpty():
        held = texts_of(docs, counted, key, text)

    def setup():
        scorer = Scorer(model)
        return lambda texts: {"x": scorer.evidence(texts).tolist()}

    rows = map_texts(held, "__text", setup, [("x", T.ArrayType(T.DoubleType()))], ["y"]).collect()
    model.weights = calibrate(np.array([r.x for r in rows]), np.array([r.y for r in rows]))
    del found, words, starts, rows
    trim()  # the counts were the driver's
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list | None = None, out: str = "score", predicted: str = "predicted", threshold: float = THRESHOLD) -> DataFrame:
    """Adds a probability and its 0/1 decision to every row; null, empty and wordless texts have no evidence and score by the constant alone.

    Columns of the new names are replaced; all others, and repeated rows, stay.
    """

    def setup():
        scorer = Scorer(model)

        def work(texts):
            s = scorer.scores(texts)
            return {out: s, predicted: (s >= threshold).astype(np.int32)}

        return work

    return map_texts(docs, text, setup, [(out, T.DoubleType()), (predicted, T.IntegerType())], keep)
