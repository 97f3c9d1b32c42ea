"""Embedding near-duplicates by navigable small-world graphs, one for each shard.

Vectors are compared within their label (and dimension) only. Equal vectors become one class. The classes of a label are dealt
into shards of about `shard` vectors; a task builds a shard's layered graph. Every shard's vectors are then looked up in
their own graph and in those of the label's other shards (each pair of shards once: links are symmetric). A beam that is
full of links is widened, and a sample of the look-ups with LINKS true links to other vectors is audited against a scan of
the shard: until the audit passes beams are widened. Where links are too rare for that, every look-up is scanned. Links
found are verified by cosine in double precision. Look-ups are made and counted some at a time; a task holds a count and a
local component for each vector, never the pairs.
"""

from __future__ import annotations

import io
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import workers_import, written
from millrace.llm.components import components

COSINE = 0.93
SHARD = 8192
DEGREE = 12
BUILD_BEAM = 40
BEAM = 32
#: An audit draws look-ups until it has seen so many true links.
LINKS = 200
RECALL = 0.99
BATCH = 256
#: Copies of a vector beyond which its rows are dealt over SALTS keys.
HOT = 20_000
SALTS = 64
PARTS = ("ids", "codes", "mult", "x", "graph")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow for large components."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def beam(x: np.ndarray, near: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries at once: (ids, cosines), best first, -1 where fewer are reached.

    x: unit vectors; near: neighbours of each (-1: none); entries: where each query starts.
    """
    n_q = len(queries)
    width = min(width, len(x))
    expand = max(2, width // 8)  # so many of a query's best are followed in one step
    ids = np.full((n_q, width), -1, np.int64)
    sims = np.full((n_q, width), -np.inf, np.float32)
    done = np.ones((n_q, width), bool)
    seen = np.zeros((n_q, len(x)), bool)

    def add(rows, more):
        flat = np.sort(more, axis=1)
        flat[:, 1:][flat[:, 1:] == flat[:, :-1]] = -1
        flat[(flat >= 0) & seen[rows[:, None], np.maximum(flat, 0)]] = -1
        good = flat >= 0
        r, c = np.nonzero(good)
        s = np.full(flat.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", x[flat[r, c]], queries[rows[r]])
        seen[rows[r], flat[r, c]] = True
        all_ids, all_sims = np.concatenate([ids[rows], flat], 1), np.concatenate([sims[rows], s], 1)
        all_done = np.concatenate([done[rows], ~good], 1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        ids[rows], sims[rows], done[rows] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1), np.take_along_axis(all_done, top, 1)

    rows = np.arange(n_q)
    add(rows, entries)
    while True:
        rows = rows[~done[rows].all(axis=1)]
        if not len(rows):
            return ids, sims
        order = np.argsort(done[rows], axis=1, kind="stable")[:, :expand]  # lists are sorted, so the first undone are the best
        chosen = np.take_along_axis(ids[rows], order, 1)
        fresh = ~np.take_along_axis(done[rows], order, 1)
        np.put_along_axis(held := done[rows], order, True, 1)
        done[rows] = held
        more = np.where((fresh & (chosen >= 0))[:, :, None], near[np.maximum(chosen, 0)], -1)
        add(rows, more.reshape(len(rows), -1))


def diverse(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Up to `keep` of each row's candidates (best first, -1: none), first those nearer to the row's vector than to any kept one, then the best of the others."""
    v = x[np.maximum(cand, 0)]
    cross = np.einsum("bid,bjd->bij", v, v)
    kept = np.zeros(cand.shape, bool)
    for j in range(cand.shape[1]):
        rival = np.where(kept, cross[:, j], -np.inf).max(axis=1)
        kept[:, j] = (cand[:, j] >= 0) & (sims[:, j] > rival) & (kept.sum(axis=1) < keep)
    order = np.argsort(np.where(cand < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(cand, order, 1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1) if out.shape[1] < keep else out


class Layer:
    """One layer's graph over `nodes` (positions in the shard)."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, degree: int):
        self.nodes, self.x, self.degree = nodes, x[nodes], degree
        self.near = np.full((len(nodes), 2 * degree), -1, np.int64)

    def build(self) -> None:
        n, size = len(self.nodes), 1
        while size < n:
            new = np.arange(size, min(n, size + min(size, BATCH)))
            width = min(BUILD_BEAM, size)
            start = np.tile(np.arange(0, size, max(1, size // 4))[:4], (len(new), 1))
            ids, sims = beam(self.x[:size], self.near[:size], self.x[new], start, width)
            own = self.x[new] @ self.x[new].T
            earlier = np.tril(np.ones_like(own, bool), -1)
            own = np.where(earlier, own, -np.inf)
            pick = np.argsort(-own, axis=1, kind="stable")[:, : self.degree]
            own_sims = np.take_along_axis(own, pick, 1)
            all_ids = np.concatenate([ids, np.where(np.isfinite(own_sims), new[pick], -1)], 1)
            all_sims = np.concatenate([sims, own_sims.astype(np.float32)], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, : BUILD_BEAM]
            chosen = diverse(self.x, np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1), self.degree)
            self.near[new, : self.degree] = chosen
            self.link_back(new, chosen)
            size = int(new[-1]) + 1

    def link_back(self, new: np.ndarray, chosen: np.ndarray) -> None:
        at = chosen >= 0
        target, source = chosen[at], np.repeat(new, at.sum(axis=1))
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        for part in range(0, len(hit), BATCH):
            h, f, c = hit[part : part + BATCH], first[part : part + BATCH], count[part : part + BATCH]
            more = np.full((len(h), int(c.max())), -1, np.int64)
            more[np.repeat(np.arange(len(h)), c), np.concatenate([np.arange(k) for k in c])] = source[np.concatenate([np.arange(a, a + k) for a, k in zip(f, c)])]
            cand = np.concatenate([self.near[h], more], 1)
            sims = np.where(cand >= 0, np.einsum("bd,bjd->bj", self.x[h], self.x[np.maximum(cand, 0)]), -np.inf)
            top = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * self.degree]
            self.near[h] = diverse(self.x, np.take_along_axis(cand, top, 1), np.take_along_axis(sims, top, 1), 2 * self.degree)


class Graph:
    """Layers from the top, small one down to the shard itself. A vector's level comes from a hash of its id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, degree: int = DEGREE):
        self.x = x.astype(np.float32)
        h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
        level = np.floor(-np.log((h.astype(np.float64) + 1) / (1 << 53)) / np.log(degree)).astype(int)
        self.layers = []
        for k in range(level.max() if len(ids) else 0, -1, -1):
            nodes = np.nonzero(level >= k)[0]
            if k == 0 or len(nodes) > 4 * degree:
                layer = Layer(self.x, nodes, degree)
                layer.build()
                self.layers.append(layer)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entries = np.tile(np.arange(0, len(self.layers[0].nodes), max(1, len(self.layers[0].nodes) // 4))[:4], (len(queries), 1))
        for layer in self.layers[:-1]:
            ids, _ = beam(layer.x, layer.near, queries, entries, 4)
            entries = np.where(ids >= 0, layer.nodes[np.maximum(ids, 0)], -1)
            below = self.layers[self.layers.index(layer) + 1]
            entries = np.where(entries >= 0, np.searchsorted(below.nodes, entries), -1)
        return beam(self.layers[-1].x, self.layers[-1].near, queries, entries, width)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"{k}{i}": v for i, y in enumerate(self.layers) for k, v in (("nodes", y.nodes.astype(np.int32)), ("near", y.near.astype(np.int32)))})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes, x: np.ndarray) -> Graph:
        made = cls.__new__(cls)
        made.x, made.layers = x.astype(np.float32), []
        held = np.load(io.BytesIO(raw))
        for i in itertools.count():
            if f"nodes{i}" not in held:
                return made
            layer = Layer(made.x, held[f"nodes{i}"].astype(np.int64), 1)
            layer.near = held[f"near{i}"].astype(np.int64)
            made.layers.append(layer)


class LookUp:
    """Links of queries to a shard's vectors. x, queries: unit vectors in double precision; own: the queries are x, and a vector's link to itself proves nothing."""

    def __init__(self, graph: Graph, x: np.ndarray, queries: np.ndarray, cosine: float, own: bool = False):
        self.graph, self.x, self.queries, self.cosine, self.own = graph, x, queries, cosine, own
        self.q32, self.width, self.recall = queries.astype(np.float32), BEAM, 1.0

    def exact(self, q: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs (q, found) that link in double precision, by q."""
        good = np.zeros(len(q), bool)
        for a in range(0, len(q), 1 << 14):
            part = slice(a, a + (1 << 14))
            good[part] = np.einsum("ij,ij->i", self.x[found[part]], self.queries[q[part]]) >= self.cosine
        if self.own:
            good &= q != found
        order = np.argsort(q[good], kind="stable")
        return q[good][order], found[good][order]

    def scanned(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, found = np.nonzero(self.q32[which] @ self.graph.x.T >= self.cosine - 1e-4)
        return self.exact(which[q], found)

    def searched(self, which: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        if 4 * width >= len(self.x):
            return self.scanned(which)
        ids, sims = self.graph.search(self.q32[which], width)
        good = (sims >= self.cosine - 1e-4) & (ids >= 0)
        full = good.sum(axis=1) >= width - 1
        q, at = np.nonzero(good & ~full[:, None])
        found = self.exact(which[q], ids[q, at])
        if not full.any():
            return found
        return tuple(np.concatenate(x) for x in zip(found, self.searched(which[full], 4 * width)))

    def batches(self):
        """(queries, linked vectors), some queries at a time: first the audited ones, by a scan, then all others by beams that the audit found wide enough."""
        order = np.random.default_rng(len(self.queries)).permutation(len(self.queries))
        n_true, audited, truth = 0, 0, []
        while audited < len(order) and n_true < LINKS:
            q, found = self.scanned(order[audited : audited + BATCH])
            audited, n_true = audited + BATCH, n_true + len(q)
            truth.append((q, found))
            yield q, found
        if audited >= len(order):
            return
        q, found = (np.concatenate(x) for x in zip(*truth))
        want = q * len(self.x) + found
        while 4 * self.width < len(self.x):
            got = [self.searched(order[a : a + BATCH], self.width) for a in range(0, audited, BATCH)]
            self.recall = np.isin(np.concatenate([q * len(self.x) + f for q, f in got]), want).sum() / len(want)
            if self.recall >= RECALL:
                break
            self.width, self.recall = 2 * self.width, 1.0
        for a in range(audited, len(order), BATCH):
            yield self.searched(order[a : a + BATCH], self.width)


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; every set's root is its smallest member."""
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while True:
            over = root[root]
            if (over == root).all():
                break
            root[:] = over


def join_shards(a: dict, b: dict | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, codes, counts, roots) of the vectors with links, within shard a or between a and b; counts are of original vectors."""
    both = [a] if b is None else [a, b]
    ids, codes, mult = (np.concatenate([x[c] for x in both]) for c in ("ids", "codes", "mult"))
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    root, n = np.arange(len(ids)), np.zeros(len(ids))
    look = LookUp(a["graph"], a["x"], both[-1]["x"], cosine, b is None)
    for q, found in look.batches():
        q = q + (0 if b is None else len(a["ids"]))
        n += np.bincount(q, mult[found], len(ids))
        if b is not None:
            n += np.bincount(found, mult[q], len(ids))
        unite(root, rank[q], rank[found])
    some = np.nonzero(n)[0]
    return ids[some], codes[some], n[some].astype(np.int64), np.sort(ids)[root[rank[some]]]


def valid(vector: str):
    """Vectors of finite numbers, not all zero."""
    return F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """(key, n_links, component_id, kept): a row for each input row.

    n_links: other rows at `cosine` or nearer with the same label; component_id: the smallest key reachable by links. A null
    label, and a vector that is null, empty, zero or has null or non-finite components, links with nothing, and vectors
    of different lengths don't link; a null key has no links and a null component. Rows that repeat a key each have their
    own links, and share a component.
    """
    spark = vectors.sparkSession
    workers_import(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("good", F.col("id").isNotNull() & F.col("label").isNotNull() & valid("v"))
    # Equal vectors have equal codes; two 64-bit hashes tell different ones apart.
    rows = rows.withColumn("code", F.xxhash64("v", F.lit(1))).withColumn("code2", F.xxhash64(F.lit(2), F.reverse("v")))
    good = rows.where("good")
    classes = good.groupBy("label", "code", "code2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("v").alias("v"))
    classes = written(classes.withColumn("dim", F.size("v")), "vectors")
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("long").alias("n_shards"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep", "code"), F.col("n_shards")))

    def build(key, held):
        ids, codes = held.column("rep").to_numpy(), held.column("code").to_numpy()
        order = np.lexsort((codes, ids))
        y = unit(held.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order])
        values = [key[0].as_py(), key[1].as_py(), key[2].as_py(), *(x[order].tobytes() for x in (ids, codes, held.column("mult").to_numpy())), y.tobytes(), Graph(ids[order], y).dump()]
        kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names=["label", "dim", "shard", *PARTS])

    made = dealt.select("label", "dim", "shard", "rep", "code", "mult", "v").groupBy("label", "dim", "shard").applyInArrow(build, "label string, dim int, shard long, ids binary, codes binary, mult binary, x binary, graph binary")
    shards = written(made, "graphs")
    left = shards.select("label", "dim", *[F.col(c).alias(f"{c}_a") for c in ("shard", *PARTS)])
    right = shards.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("shard", *PARTS)])
    same = left.select("shard_a", *[f"{c}_a" for c in PARTS], *[F.lit(None).cast("binary").alias(f"{c}_b") for c in PARTS], "dim")
    cross = left.join(right, ["label", "dim"]).where("shard_a < shard_b").select("shard_a", *[f"{c}_{s}" for s in "ab" for c in PARTS], "dim")
    pairs = same.unionByName(cross).drop("shard_a").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("ids_a", "ids_b"))

    def look_up(batches):
        def side(row, s):
            if row[f"ids_{s}"] is None:
                return None
            x = np.frombuffer(row[f"x_{s}"], np.float64).reshape(-1, row["dim"])
            return {c: np.frombuffer(row[f"{c}_{s}"], np.int64) for c in ("ids", "codes", "mult")} | {"x": x, "graph": Graph.load(row[f"graph_{s}"], x)}

        for batch in batches:
            for i in range(batch.num_rows):  # a row is a pair of shards
                row = batch.slice(i, 1).to_pylist()[0]
                made = join_shards(side(row, "a"), side(row, "b"), cosine)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["rep", "code", "n", "root"])

    found = written(pairs.mapInArrow(look_up, "rep long, code long, n long, root long"), "links")
    # Rows that repeat a key tie the classes that they stand in.
    repeats = good.join(good.groupBy("id").count().where("count > 1").select("id"), "id", "left_semi").select("id", "label", "code", "code2")
    ties = repeats.join(classes.select("label", "code", "code2", "rep"), ["label", "code", "code2"]).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    tied = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(ties)).withColumnRenamed("node", "rep")
    counts = found.groupBy("rep", "code").agg(F.sum("n").alias("n"))
    named = classes.join(counts, ["rep", "code"], "left").join(tied, "rep", "left")
    named = named.select("label", "code", "code2", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # Vectors with very many copies are dealt over SALTS keys.
    hot = written(named.where(F.col("mult") > HOT).select("label", "code", "code2", F.lit(True).alias("hot")), "hot-vectors")
    salted = named.withColumn("salt", F.explode(F.when(F.col("mult") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    held = good.select("id", "label", "code", "code2").join(hot, ["label", "code", "code2"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    joined = held.join(salted, ["label", "code", "code2", "salt"]).select("id", "n_links", "component_id")
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = joined.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
