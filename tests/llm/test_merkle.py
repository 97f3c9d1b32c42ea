"""Merkle trees over rows against a plain walk of lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx long, node string, n string"
ROWS = [(i, f"text é {i}", ["en", "de", None, "", "fr"][i % 5] if i < 40 else "en", None if i % 11 == 0 else "a", None if i % 3 == 0 else 9 + i, 1, "x", "y") for i in range(60)]
ROWS += [(7, "same id", "en", "a", 1, 1, None, None), (7, "same id", "en", "a", 1, 2, None, None), (None, "no id", "en", "b", 2, 3, None, None), (None, None, "en", None, None, None, None, None), (900, "", "lone", "a", 0, 0, "", ""), (901, "long " * 200_000, "en", "c", 1_000_000, 0, None, None)]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    n_chars = n_chars + more if n_chars is not None else None
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def climb(levels, at, node, arity):
    proof = ""
    for level in levels[:-1]:
        first = at - at % arity
        left, right = "".join(level[first:at]), "".join(level[at + 1 : first + arity])
        node, proof, at = sha(left, node, right), proof + left + right, at // arity
    return node, proof


def naive(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r) for r in groups[g]], arity) for g in names}
    top = tree([trees[g][-1][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            more = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, low = climb(trees[g], i, leaf(r, int(more)), arity)
            root, high = climb(top, k, node, arity)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(low + high), root, root == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("arity", "span", "rows"), [(2, 10, ROWS), (2, 2, ROWS), (3, 1, ROWS), (2, 3, ROWS[:1]), (2, 3, [])])
def test_proofs(spark, arity, span, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, 1).otherwise(0)
    made = merkle.prove(docs, claimed={"n_chars": F.col("n_chars") + more}, arity=arity, span=span)
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got == naive(rows, arity)
    if len(rows) > 1:
        assert {r[6] for r in got} == {True, False}


def test_manifest(spark):
    want = {"" if g is None else f":{g}": len([r for r in ROWS if r[2] == g]) for g in {r[2] for r in ROWS}}
    got = {r.tree: (r.n, r.subroot) for r in merkle.subroots(spark.createDataFrame(ROWS, SCHEMA), span=2).collect()}
    assert {k: n for k, (n, _) in got.items()} == want
    assert got[":lone"] == (1, leaf(ROWS[-2]))


def test_forests_merge_in_any_order():
    leaves = [sha(str(i)) for i in range(37)]
    draw = random.Random(5)
    for arity in (2, 3, 5):
        root = tree(leaves, arity)[-1][0]
        for _ in range(20):
            parts = [merkle.Forest(arity) for _ in range(6)]
            for i, node in enumerate(leaves):
                draw.choice(parts).put("t", len(leaves), 0, i, node)
            draw.shuffle(parts)
            left = merkle.Forest(arity).merge(parts[0]).merge(parts[1]).merge(parts[2])
            right = parts[3].merge(parts[4].merge(parts[5]))
            assert list(right.merge(left).nodes.values()) == [root]
