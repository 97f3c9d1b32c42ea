"""Quality rules: exact document statistics and gradient-boosted trees over them.

The trees are grown on binned statistics in numpy, best split first, under monotonic constraints: a statistic
of direction -1 (or +1) may never raise (lower) the score as it grows. Bounds on leaf values are handed down from
each constrained split's midpoint, so the constraint holds for whole trees. All trees lie in flat node arrays, and a batch
of documents walks one level of every tree at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_texts, sample_rows, texts_of

FIT_ROWS = 3000
THRESHOLD = 0.3
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Statistics the trees see, and the direction in which each may move the score (0: free).
FEATURES = {"n_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1, "same_neighbours": -1, "distinct": 1, "capitals": 0, "digits": 0, "signs": -1, "words_per_line": 0}
NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
NOT_LOWER = bytes(set(range(256)) - set(range(97, 123)) - set(range(128, 256)))
NOT_DIGIT = bytes(set(range(256)) - set(range(48, 58)))
NOT_LEAD = bytes(range(0x80, 0xC0))
SIGN = re.compile(rb"[!-/:-@\[-`{-~]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(words: list[bytes], width: int = WINDOW) -> int:
    """How many words lie in a window of `width` words that is found twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    first = {}
    codes = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, n)
    if len(first) == n:
        return 0
    _, window = np.unique(codes, return_inverse=True)
    window = window.astype(np.int64)
    size = 1
    while size < width:  # ranks of windows of twice the size from ranks of their halves: exact, no hashing
        m = n - 2 * size + 1
        pair = window[:m] * (n + 1) + window[size : size + m]
        window = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size *= 2
    again = np.nonzero(np.bincount(window)[window] > 1)[0]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def distinct_share(words: list[bytes], block: int = 500) -> float:
    """Mean share of distinct words in the text's blocks of `block` words, each block counting by its length; no words: 0."""
    return sum(len(set(words[a : a + block])) for a in range(0, len(words), block)) / max(len(words), 1)


def statistics(text: bytes | None) -> tuple[list, list]:
    """The base statistics (exact integers, as in BASE) and the trees' features (as in FEATURES)."""
    raw = text or b""
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.translate(None, NOT_LEAD))
    symbols = len(raw.translate(None, NOT_SYMBOL))
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            dup += line in seen
            seen.add(line)
    again = repeated(words)
    upper, lower = len(joined.translate(None, NOT_UPPER)), len(joined.translate(None, NOT_LOWER))
    k = max(n, 1)
    feats = [n, chars / k, symbols / k, dup / max(lines, 1), again / k, sum(map(bytes.__eq__, words, words[1:])) / k, distinct_share(words), upper / max(upper + lower, 1), len(joined.translate(None, NOT_DIGIT)) / max(chars, 1), len(SIGN.findall(joined)) / k, n / max(lines, 1)]
    return [n, chars, symbols, dup, again], feats


@dataclass
class Trees:
    """Flat nodes: feature (-1: a leaf), cut, left child (right is left + 1), value; roots: each tree's first node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            go = self.left[at] + (x[rows, np.maximum(f, 0)] > self.cut[at])
            at = np.where(f >= 0, go, at)
        return self.base + self.value[at].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, directions: list[int], n_trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0, bins: int = 64) -> Trees:
    """Second-order boosting of the log loss on quantile bins."""
    p0 = min(max(y.mean() if len(y) else 0.5, 0.01), 0.99)
    base = float(np.log(p0 / (1 - p0)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else []
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]) if len(x) else np.zeros((0, 1), int)
    nodes, roots, margin = [], [], np.full(len(x), base)

    def leaf(g, h, lo, hi):
        return min(max(-g / (h + ridge), lo), hi)

    def best_split(rows, g, h, lo, hi):
        top = (1e-6, None)
        gs, hs = g[rows].sum(), h[rows].sum()
        gain = lambda a, b, v: -(a * v + 0.5 * (b + ridge) * v * v)
        whole = gain(gs, hs, leaf(gs, hs, lo, hi))
        for f, e in enumerate(edges):
            if not len(e):
                continue
            bg = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
            bh = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
            lv = np.clip(-bg / (bh + ridge), lo, hi)
            rv = np.clip(-(gs - bg) / (hs - bh + ridge), lo, hi)
            won = gain(bg, bh, lv) + gain(gs - bg, hs - bh, rv) - whole
            won[(bh < least) | (hs - bh < least)] = -1
            if directions[f]:
                won[(rv - lv) * directions[f] < 0] = -1
            k = int(won.argmax())
            if won[k] > top[0]:
                top = (won[k], (f, k, lv[k], rv[k]))
        return top[1]

    def grow(at, rows, g, h, lo, hi, level):
        found = best_split(rows, g, h, lo, hi) if level < depth and len(rows) > 1 else None
        if not found:
            nodes[at] = (-1, 0.0, 0, rate * leaf(g[rows].sum(), h[rows].sum(), lo, hi))
            margin[rows] += nodes[at][3]
            return
        f, k, lv, rv = found
        left = len(nodes)
        nodes.extend([None, None])
        nodes[at] = (f, float(edges[f][k]), left, 0.0)
        mid, low = (lv + rv) / 2, binned[rows, f] <= k
        bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[directions[f]]
        grow(left, rows[low], g, h, *bounds[0], level + 1)
        grow(left + 1, rows[~low], g, h, *bounds[1], level + 1)

    for _ in range(n_trees if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append(None)
        grow(roots[-1], np.arange(len(x)), g, h, -np.inf, np.inf, 0)
    cols = list(zip(*nodes)) or [(), (), (), ()]
    return Trees(np.array(cols[0], np.int64), np.array(cols[1], float), np.array(cols[2], np.int64), np.array(cols[3], float), np.array(roots, np.int64), base, depth)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Trees:
    """Learns from at most `rows` labelled texts of each class; without any, every text scores a half. Of rows that repeat a key the least label and the least text count."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("y")).groupBy(key).agg(F.min("y").alias("y"))
    chosen = sample_rows(known.where("y = 1"), key, rows).unionByName(sample_rows(known.where("y = 0"), key, rows))
    made = map_texts(texts_of(docs, chosen, key, text), "__text", lambda: lambda texts: {"x": [statistics(t)[1] for t in texts]}, [("x", T.ArrayType(T.DoubleType()))], ["__id", "y"])
    held = made.orderBy("__id").collect()
    return boost(np.array([r.x for r in held], float).reshape(-1, len(FEATURES)), np.array([r.y for r in held], float), list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees, text: str = "text", keep: list | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds the base statistics, base_failed, the trees' score and kept to every row.

    Null and wordless texts have zero statistics and fail the base rules. Columns of the new names are replaced; all
    others, and repeated rows, stay.
    """

    def work(texts):
        made = [statistics(t) for t in texts]
        base = np.array([b for b, _ in made], np.int64).reshape(-1, len(BASE))
        failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])
        s = trees.scores(np.array([f for _, f in made], float).reshape(-1, len(FEATURES)))
        return dict(zip(BASE, base.T)) | {"base_failed": failed.tolist(), "score": s, "kept": (~failed & (s >= threshold)).tolist()}

    return map_texts(docs, text, lambda: work, [*((n, T.LongType()) for n in BASE), ("base_failed", T.BooleanType()), ("score", T.DoubleType()), ("kept", T.BooleanType())], keep)
