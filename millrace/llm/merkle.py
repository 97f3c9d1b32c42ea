"""Merkle trees over a dataset: one a group, their roots under one root, and every row's proof.

A sparse forest is a set of unresolved nodes keyed by tree, level and index. Forests merge by union: whenever a run of
siblings is complete, which is known from the tree's leaves, the run becomes its parent. Merging is associative and
commutative, so partitions fold their own rows first, in any order, and what is left of them (a run of rows leaves about
two nodes a level) is reduced as a tree: a round resolves aligned blocks of arity ** SPAN nodes to one node each, until a
tree is one node. The rounds are written tables and not RDD.treeReduce, as the proofs need their nodes, which
are a share of all rows and no driver should hold. Then the rounds are walked back: a block gets the siblings above it
and hands them on to its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import numbered, workers_import, written

ARITY = 2
#: Levels that one round resolves.
SPAN = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree string, n long, level int, idx long, node string"
PATHS = "tree string, block long, lefts array<string>, rights array<string>, subroot string, root string"


def digest(*parts: str) -> str:
    """H: the sha256 of the parts one after the other, in lower-case hexadecimals."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Forest:
    """Unresolved nodes (tree, level, index) of trees of known size, none above level `top`."""

    def __init__(self, arity: int = ARITY, top: int = 64):
        self.arity, self.top = arity, top
        self.nodes: dict[tuple[str, int, int], str] = {}
        self.sizes: dict[str, int] = {}

    def put(self, tree: str, n: int, level: int, index: int, node: str) -> None:
        """Adds a node of a tree of n leaves, and resolves the runs that it completes."""
        self.sizes[tree] = n
        while level < self.top:
            width = -(-n // self.arity**level)
            if width == 1:
                break
            self.nodes[tree, level, index] = node
            first = index - index % self.arity
            run = [(tree, level, i) for i in range(first, min(first + self.arity, width))]
            if not all(k in self.nodes for k in run):
                return
            node = digest(*[self.nodes.pop(k) for k in run])
            level, index = level + 1, index // self.arity
        self.nodes[tree, level, index] = node

    def merge(self, other: Forest) -> Forest:
        for (tree, level, index), node in other.nodes.items():
            self.put(tree, other.sizes[tree], level, index, node)
        return self

    def rows(self) -> Iterable[tuple[str, int, int, int, str]]:
        return ((tree, self.sizes[tree], level, index, node) for (tree, level, index), node in self.nodes.items())


def field(c: Column) -> Column:
    """A value as the leaf reads it: `-` for null, else its UTF-8 bytes' count, a colon and the value."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def folded(nodes: DataFrame, arity: int, span: int) -> DataFrame:
    """The nodes `span` levels up, as nodes of level 0 of a smaller tree: what each partition leaves, merged block by block. nodes: tree, n, idx, node."""

    def fragment(batches):
        forest = Forest(arity, span)
        for batch in batches:
            for tree, n, index, node in zip(*[c.to_pylist() for c in batch.columns]):
                forest.put(tree, n, 0, index, node)
        rows = list(forest.rows())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["tree", "n", "level", "idx", "node"])

    def merged(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(arity, span)
        for row in part[["tree", "n", "level", "idx", "node"]].itertuples(index=False):
            forest.put(*row)
        (node,) = forest.nodes.values()
        return pd.DataFrame({"tree": [key[0]], "n": [-(-int(part.n.iloc[0]) // arity**span)], "idx": [key[1]], "node": [node]})

    workers_import(nodes.sparkSession)
    fragments = nodes.select("tree", "n", "idx", "node").mapInArrow(fragment, NODES)
    block = F.expr(f"idx div cast(power({arity}, {span} - level) as bigint)").alias("block")
    return fragments.groupBy("tree", block).applyInPandas(merged, "tree string, n long, idx long, node string")


def rounds(leaves: DataFrame, arity: int, span: int) -> list[DataFrame]:
    """leaves (tree, n, idx, node, ...) and, as written tables, the nodes that each round leaves; the last has a node a tree."""
    levels = [leaves]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        levels.append(written(folded(levels[-1], arity, span), "nodes"))
    return levels


def siblings(nodes: list[str], n: int, arity: int, span: int) -> tuple[list[list[str]], list[list[str]]]:
    """For the nodes of one block of a tree of n: of each, level by level, the siblings before and after it, joined."""
    lefts, rights = [[] for _ in nodes], [[] for _ in nodes]
    now, step = nodes, 1
    for _ in range(span):
        if n <= 1:
            break
        for i in range(len(nodes)):
            at = i // step
            first = at - at % arity
            lefts[i].append("".join(now[first:at]))
            rights[i].append("".join(now[at + 1 : first + arity]))
        now = [digest(*now[k : k + arity]) for k in range(0, len(now), arity)]
        n, step = -(-n // arity), step * arity
    return lefts, rights


def per_block(nodes: DataFrame, above: DataFrame, arity: int, span: int, made, schema: str) -> DataFrame:
    """made(block's rows by idx, lefts, rights, the row above) for each block; lefts and rights reach to the root of all."""

    def run(part: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx", kind="stable")
        lefts, rights = siblings(part.node.tolist(), int(part.n.iloc[0]), arity, span)
        top = up.iloc[0]
        return made(part, [x + list(top.lefts) for x in lefts], [x + list(top.rights) for x in rights], top)

    keyed = nodes.withColumn("block", F.expr(f"idx div {arity**span}L"))
    return keyed.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(run, schema)


def paths(levels: list[DataFrame], top: DataFrame, arity: int, span: int) -> DataFrame:
    """What stands above each block of the leaves. levels: as rounds() gives them; top: what stands above each tree, in block 0."""

    def handed(part, lefts, rights, up):
        return pd.DataFrame({"tree": part.tree, "block": part.idx, "lefts": pd.Series(lefts, index=part.index), "rights": pd.Series(rights, index=part.index), "subroot": up.subroot, "root": up.root})

    for nodes in reversed(levels[1:]):
        top = written(per_block(nodes, top, arity, span, handed, PATHS), "paths")
    return top


def tree_name(group: str) -> Column:
    """Names that sort as the groups do, null first: a null group's is empty, the others begin with a colon."""
    return F.coalesce(F.concat(F.lit(":"), F.col(group).cast("string")), F.lit(""))


def prove(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, claimed: Mapping[str, Column] | None = None, arity: int = ARITY, span: int = SPAN) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): every row's leaf, roots and proof, and whether the row as it is claimed to be still leads to the root.

    claimed: columns whose claimed values differ from those that the tree was built from. A tree's leaves stand by key, nulls first,
    and rows that share a key by leaf, so that the trees are the same however rows are dealt; rows that repeat wholly are
    leaves of their own. A null group is a tree like any other and comes first. A tree of one leaf has that leaf as its root,
    and no siblings: the proof is then the digest of nothing, or of what stands above the tree. An empty table gives no rows.
    Other columns are not read.
    """
    given = [F.col(c) for c in fields]
    said = [(claimed or {}).get(c, F.col(c)) for c in fields]
    rows = docs.select(F.col(key).alias("__key"), tree_name(group).alias("tree"), leaf(given).alias("node"), leaf(said).alias("__said"))
    rows = rows.withColumn("__said", F.when(F.col("__said") != F.col("node"), F.col("__said")))
    leaves = numbered(written(rows, "leaves"), "tree", ["__key", "node"])
    levels = rounds(leaves, arity, span)
    subroots = written(levels[-1].select("tree", "node"), "subroots")
    trees = numbered(subroots.select("tree", F.lit("all").alias("whole"), "node"), "whole", ["tree"]).select(F.col("whole").alias("tree"), F.col("tree").alias("of"), "n", "idx", "node")
    upper = rounds(trees, arity, span)
    nothing = F.array().cast("array<string>")
    root = written(upper[-1].select("tree", F.lit(0).cast("long").alias("block"), nothing.alias("lefts"), nothing.alias("rights"), F.lit("").alias("subroot"), F.col("node").alias("root")), "paths")

    def handed(part, lefts, rights, up):
        return pd.DataFrame({"tree": part.of, "block": 0, "lefts": pd.Series(lefts, index=part.index), "rights": pd.Series(rights, index=part.index), "subroot": part.node, "root": up.root})

    def proved(part, lefts, rights, up):
        back = []
        for node, left, right in zip(part["__said"].where(part["__said"].notna(), part.node), lefts, rights):
            for a, b in zip(left, right):
                node = digest(a, node, b)
            back.append(node)
        proofs = [digest(*[x for pair in zip(a, b) for x in pair]) for a, b in zip(lefts, rights)]
        return pd.DataFrame({"__key": part["__key"], "leaf": part.node, "subroot": up.subroot, "root": up.root, "proof_sha256": proofs, "folded_root": back})

    tops = written(per_block(trees, paths(upper, root, arity, span), arity, span, handed, PATHS), "paths")
    type_ = docs.schema[key].dataType.simpleString()
    schema = f"__key {type_}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    done = per_block(leaves, paths(levels, tops, arity, span), arity, span, proved, schema)
    return done.withColumnRenamed("__key", key).withColumn("verified", F.col("folded_root") == F.col("root"))


def subroots(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, arity: int = ARITY, span: int = SPAN) -> DataFrame:
    """(tree, n, subroot): the manifest itself, a row a group; the tree of a null group is named '', that of group x ':x'."""
    rows = docs.select(F.col(key).alias("__key"), tree_name(group).alias("tree"), leaf([F.col(c) for c in fields]).alias("node"))
    leaves = numbered(written(rows, "leaves"), "tree", ["__key", "node"])
    sizes = leaves.where("idx = 0").select("tree", "n")
    return rounds(leaves, arity, span)[-1].select("tree", F.col("node").alias("subroot")).join(sizes, "tree").select("tree", "n", "subroot")


def crc32_sql(value: str) -> str:
    """The unsigned crc32 of a string of ASCII characters, by its polynomial's reflected form."""
    step = "list_reduce(range(9), lambda v, z: CASE WHEN z = 0 THEN v ELSE xor(v >> 1, (v & 1) * 3988292384) END, xor(c, ascii(d)::BIGINT))"
    return f"xor(list_reduce(string_split({value}, ''), lambda c, d: {step}, 4294967295::BIGINT), 4294967295)"


def oracle() -> str:
    """DuckDB SQL for prove() over documents, with n_chars claimed to be one more where 7 divides the crc32 of doc_id."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    h = lambda n: f"sha256({' || '.join(enc(c) for c in ('doc_id', 'source', 'lang', n, 'text'))})"
    walk = lambda name, start, nodes: f"""{name} AS ({start} UNION ALL
  SELECT w.row, w.lang, w.level + 1, w.k // 2, (w.n + 1) // 2, sha256(CASE WHEN w.k % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
  FROM {name} w LEFT JOIN {nodes} s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.k = xor(w.k, 1) WHERE w.n > 1)"""  # noqa: E731
    grow = lambda name, start: f"""{name} AS ({start} UNION ALL
  SELECT lang, level + 1, k // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY k)) FROM {name} WHERE n > 1 GROUP BY lang, level, n, k // 2)"""  # noqa: E731
    return f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {h('n_chars')} AS leaf, {h(f"(n_chars + CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN 1 ELSE 0 END)")} AS said FROM documents),
l AS (SELECT row_number() OVER () AS row, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n, doc_id, leaf, said FROM d),
{grow('t', 'SELECT lang, 0 AS level, k, n, leaf AS h FROM l')},
s AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n, h FROM t WHERE n = 1),
{grow('u', "SELECT 'all' AS lang, 0 AS level, k, n, h FROM s")},
{walk('w', "SELECT row, lang, 0 AS level, k, n, said AS h, '' AS proof FROM l", 't')},
{walk('v', "SELECT w.row, 'all' AS lang, 0 AS level, s.k, s.n, w.h, w.proof FROM w JOIN s ON w.lang IS NOT DISTINCT FROM s.lang WHERE w.n = 1", 'u')}
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(v.proof) AS proof_sha256, v.h AS folded_root, v.h = r.h AS verified
FROM l JOIN v ON l.row = v.row AND v.n = 1 JOIN s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT h FROM u WHERE n = 1) r"""
