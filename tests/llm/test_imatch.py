"""I-Match fingerprints: edited texts and order against plain lists, likeness against true shares."""

import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm import imatch

SCHEMA = "doc_id long, text string, part int, ahead int, fingerprint string"


def plain_edit(text, after):
    n = len(text) // 4
    return (text[:-n] if n else text) + after[:n]


def rows_of(n, rng):
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    return [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 40, 200, 900]))), 1, 2, "x") for k in rng.sample(range(10_000), n)]


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_edited_texts_follow_the_order_of_ids(spark, parts):
    rng = random.Random(3)
    rows = [*rows_of(120, rng), (20_000, None, None, None, None), (20_001, "", 0, 0, ""), (20_002, "é😀" * 30, 0, 0, ""), (20_003, "!?", 0, 0, ""), (-5, "w" * 300_000, 0, 0, ""), (None, "without an id", 0, 0, None)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        made = imatch.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(5))
        got = {r.doc_id: r for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert made.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for r, after in zip(order, order[1:] + order[:1]):
        text = r[1] or ""
        assert got[r[0]].n_chars == len(text)
        assert got[r[0]].edited_sha256 == hashlib.sha256(plain_edit(text, after[1] or "").encode()).hexdigest()
        assert 0 <= got[r[0]].near_edited <= 1 and 0 <= got[r[0]].near_next <= 1
    assert got[20_000].fingerprint == got[20_001].fingerprint != got[20_003].fingerprint


def test_empty_and_lone(spark):
    assert imatch.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = imatch.fingerprints(spark.createDataFrame([(4, "abcd efgh", 0, 0, "")], SCHEMA)).collect()
    assert row.near_next == 1 and row.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()


def test_repeated_ids_and_texts(spark):
    rows = [(1, "one two three", 0, 0, ""), (1, "one two three", 0, 0, ""), (1, "other words here", 0, 0, ""), (2, "one two three", 0, 0, "")] * 3
    got = imatch.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 12 and len({r.fingerprint for r in got if r.n_chars == 13}) == 1 and len({r.fingerprint for r in got}) == 2


def test_document_counts_and_lexicon(spark):
    texts = ["The cat, the CAT", "a cat2dog", "dog é", None, "", "x" * 100, "x" * 100 + " dog"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {}
    for t in texts:
        for w in set(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            want.setdefault(w, set()).add(t)
    counts = {r.term: r.df for r in imatch.document_counts(docs, "text").collect()}
    lowered = {"the": 1, "cat": 2, "a": 1, "dog": 3, "é": 1}
    assert {k: counts[imatch.code_of(k.encode())] for k in lowered} == lowered and sorted(counts.values()) == sorted([*lowered.values(), 2])
    assert set(want) >= set(lowered)
    assert imatch.lexicon(docs, "text", 0, 0.3).tolist() == sorted(k for k, v in counts.items() if v == 2)


def lexicon(words):
    return np.sort(np.array([imatch.code_of(w) for w in words]))


def naive_print(words, prints):
    """By one subset after the other."""
    code = lambda x: hashlib.blake2b(b" ".join(x), digest_size=4).hexdigest()
    out = code(sorted(words))
    for j in range(prints.subsets):
        for r in range(prints.rungs):
            inside = [w for w in sorted(words) if prints.depths(np.array([imatch.code_of(w)]).view(np.uint64))[0, j] > r]
            out += code(inside) if inside else imatch.EMPTY
    return out


def test_fingerprint_of_kept_terms():
    prints = imatch.Fingerprints(lexicon([b"ab", b"cd", b"ef", b"gh"]))
    assert prints(b"cd, AB zz ab gh") == naive_print([b"ab", b"cd", b"gh"], prints)
    assert imatch.Fingerprints(lexicon([]))(b"only others") == naive_print([b"only", b"others"], prints)
    assert prints(b"only others") == naive_print([b"only", b"others"], prints)
    depths = prints.depths(np.arange(4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert all(abs((depths > r).mean() * 2 ** (2 * r + 3) - 1) < 0.25 for r in range(3))


def test_likeness_estimates_terms_in_common():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)).encode() for _ in range(4000)]
    prints = imatch.Fingerprints(lexicon(words))
    for n in (12, 100, 1500):
        seen = {}
        for share in (0.0, 0.5, 0.9):
            found = []
            for _ in range(40):
                picked, keep = rng.sample(words, 2 * n), int(share * n)
                a, b = picked[:n], picked[:keep] + picked[n : 2 * n - keep]
                found.append(imatch.likeness(prints(b" ".join(a)), prints(b" ".join(b))))
            seen[share] = sum(found) / len(found)
        assert seen[0.0] < 0.15 and abs(seen[0.5] - 0.5) < 0.17 and seen[0.9] > 0.75
    assert imatch.likeness(prints(b"x"), prints(b"x")) == 1
