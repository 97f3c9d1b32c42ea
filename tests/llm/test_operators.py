"""Each training-data operator against brute force or held-out labels, and on awkward rows."""

import gzip
import json
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import components, hnsw_dedup, language_id, mixing, piece_sampling, quality_classifier, quality_rules, simhash_dedup, token_store, toxicity, warc

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, kept string, size string"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43, "x", "y", "z", "s"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "a", 43, "x", "y", "z", "s"),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, "", "", "", ""),
    (5, " \t\n ", None, "b", 4, None, None, None, None),
    (6, LONG, "en", "c", len(LONG), None, None, None, None),
    (7, "ein Satz mit Wörtern und é ▁ 😀 \x1c Zeichen\r\nund noch einer", "de", "b", 50, None, None, None, None),
    (9, "x" * 5000, "de", None, 5000, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(rows):
    return {r[0]: None if r[1] is None else r[1].encode() for r in rows}


def labelled(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


# 1


def test_pieces_are_lossless_reproducible_and_keep_columns(spark, odd, empty):
    made = piece_sampling.encode(odd, PIECES)
    rows = {r.doc_id: r for r in made.collect()}
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "kept", "size", "ids", "n_pieces", "lossless"]
    assert all(r.lossless for r in rows.values()) and rows[3].n_pieces == rows[4].n_pieces == 0
    again = {r.doc_id: r.ids for r in piece_sampling.encode(odd.repartition(3), PIECES).collect()}
    assert again == {k: r.ids for k, r in rows.items()}
    back = {r.doc_id: r.text for r in piece_sampling.decode(made.drop("text"), PIECES).collect()}
    assert back == {r[0]: r[1] or "" for r in ROWS}
    assert piece_sampling.encode(empty, PIECES).count() == 0


def test_pieces_are_drawn_by_their_share():
    v = piece_sampling.Vocabulary(PIECES)

    def ways(u, i=0):
        if i == len(u):
            yield (), 0.0
        for j in range(i + 1, len(u) + 1):
            if u[i:j] in v.pieces:
                for ids, w in ways(u, j):
                    yield (v.pieces[u[i:j]][0], *ids), w + v.pieces[u[i:j]][1]

    every = dict(ways(" token"))
    total, n = sum(map(np.exp, every.values())), 40_000
    ids, counts = piece_sampling.Sampler(v).sample([b"token"] * n, np.arange(n))
    ends = np.cumsum(counts)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends - counts, ends))
    assert set(seen) <= set(every)
    assert max(abs(seen[k] / n - np.exp(w) / total) for k, w in every.items()) < 0.01


# 2, 3, 6, 10


def test_language_held_out(spark, sf_dir, odd, empty):
    docs, _ = labelled(spark, sf_dir)
    model = language_id.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    made = language_id.predict(docs.where("crc32(cast(doc_id as string)) % 4 = 2"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in made]) > 0.9 and all(0 <= r.score <= 1 for r in made)
    rows = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 and rows[k].rejected for k in (3, 4, 5)) and rows[1].lang_pred != "und"
    numbers = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ 12_34 ٣"), (3, "a ½"), (4, "́ !?")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language_id.predict(numbers, model).orderBy("doc_id").collect()] == [True, True, False, True]
    assert language_id.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, language_id.fit(empty)).collect()} == {"und"}


def test_toxicity_held_out_and_odd_rows(spark, odd, empty):
    rng = np.random.default_rng(8)
    common = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]
    insults = ["dreadful", *(f"vilo{x}" for x in ("st", "rak", "ten", "dum", "pi"))]
    texts = [[common[k] for k in rng.integers(0, 300, 40)] for _ in range(400)]
    for t in texts[::5]:
        for _ in range(3):
            t.insert(int(rng.integers(len(t))), insults[int(rng.integers(len(insults)))])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 5 else 1) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 300"), labels)
    rows = toxicity.score(docs.where("doc_id >= 300"), model).collect()
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in rows]) > 0.95
    other = spark.createDataFrame([(1, "entirely dreadful other vilozzz words here"), (2, "nothing known here at all")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(other, model).orderBy("doc_id").collect()] == [1, 0]
    made = toxicity.score(odd, model)
    assert made.columns.count("score") == 1 and all(0 <= r.score < 0.3 for r in made.collect())
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(empty, labels.limit(0))).count() == len(ROWS)


def test_toxicity_ignores_copies_and_repeats():
    one = toxicity.word_pairs([b"a b a b"])
    assert list(zip(one["before"][0], one["word"][0])) == [("", "a"), ("a", "b"), ("b", "a")]
    scorer = toxicity.Scorer(toxicity.Model({"bad": 5.0}, {"ba": 1.0}))
    x = scorer.evidence([b"bad bad bad bad", b"bad", b"bank fine", None])
    assert x[0, 1] == x[1, 1] == 5 / 3 and x[2, 1] == 1 / 3 and not x[3].any()


def test_toxicity_of_common_words_together(spark):
    rng = np.random.default_rng(11)
    common = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(60)]
    texts = [[common[k] for k in rng.integers(0, 60, 40)] for _ in range(600)]
    for i, t in enumerate(texts):
        for _ in range(3):
            at = int(rng.integers(len(t)))
            t[at:at] = common[:3] if i % 5 == 0 else [common[k] for k in rng.permutation([0, 1, 2])[: 1 + i % 2]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 5 else 1) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 450"), labels)
    ids = model.pairs.ids
    alone, llr = model.ratios(common[1:3]), np.zeros(2)
    model.pairs.put(np.array([ids[w] for w in common[:2]]), np.array([ids[w] for w in common[1:3]]), llr)
    assert (llr > alone + 1).all()
    rows = toxicity.score(docs.where("doc_id >= 450"), model).collect()
    assert np.mean([r.predicted == 1 for r in rows if r.doc_id % 5 == 0]) > 0.9 and np.mean([r.predicted == 0 for r in rows if r.doc_id % 5]) > 0.9


def test_toxicity_counts_the_whole_corpus(spark):
    docs = spark.createDataFrame([(1, "bad apple. A bad cat"), (2, "the bad apply of it"), (3, "unlabelled appleton; the apple"), (4, None), (5, "the apple")], "doc_id long, text string")
    words = toxicity.corpus_words(docs, "text")
    want = {"bad": 3, "apple": 2, "a": 1, "cat": 1, "the": 2, "apply": 1, "of": 1, "it": 1, "unlabelled": 1, "appleton": 1}
    assert {r.word: r.n for r in words.collect()} == want
    needed = spark.createDataFrame([("apple",), ("a",), ("bad",)], "word string")
    shares, starts = toxicity.corpus_shares(words, needed, needed)
    assert shares == {"apple": 1, "a": 1, "bad": 1} and starts == {"ap": 3 / 9, "app": 1, "appl": 1, "apple": 2 / 3, "ba": 1 / 9, "bad": 1}


def test_sketches_of_words_before(spark):
    rows = [(f"{'abcdefghijklmnopqrst'[i % 20]}{'abcdefghijklmnopqrst'[i // 20 % 20]}{'abcdefghijklmnopqrst'[i // 400]}x often",) for i in range(6000)]
    rows += [(f"{'abcdefghijklmnopqrst'[i % 20]}{'abcdefghijklmnopqrst'[i // 20]}y seldom",) for i in range(120)] * 3
    found = {r.word: r.n for r in toxicity.corpus_words(spark.createDataFrame(rows, "text string"), "text").collect()}
    assert len(found) == 6122 and 0.5 < found["often"] / 6000 < 1.8 and 0.5 < found["seldom"] / 120 < 1.8 and found["aaax"] == 1


def test_quality_classifier_held_out(spark, sf_dir, odd, empty):
    docs, labels = labelled(spark, sf_dir)
    fold = "crc32(cast(doc_id as string)) % 5"
    model = quality_classifier.fit(docs, labels.where(f"{fold} <> 0"))
    rows = quality_classifier.score(docs, model).join(labels.where(f"{fold} = 0"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.8
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(odd, model).collect())
    assert quality_classifier.score(empty, model).count() == 0
    assert {round(r.score, 6) for r in quality_classifier.score(odd, quality_classifier.fit(empty, labels.limit(0))).collect()} == {0.5}


def brute_repeats(words, k=8):
    seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})


def test_repeated_words_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        words = [b"abcd"[i : i + 1] for i in rng.integers(0, rng.integers(1, 5), rng.integers(0, 70))]
        assert quality_rules.repeated(words) == brute_repeats(words)


def test_quality_rules(spark, sf_dir, odd, empty):
    docs, labels = labelled(spark, sf_dir)
    trees = quality_rules.fit(docs, labels.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    rows = quality_rules.judge(docs, trees).join(labels.where("crc32(cast(doc_id as string)) % 5 = 0"), "doc_id").collect()
    assert np.mean([(r.score >= 0.3) == r.quality for r in rows]) > 0.85
    for r in rows:
        words = r.text.encode().split()
        lines = [x for x in r.text.split("\n") if x.split()]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(words), brute_repeats(words), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(w.decode()) for w in words) and r.n_symbols == sum(c in "#*$%&|<>" for c in r.text)
    judged = {r.doc_id: r for r in quality_rules.judge(odd, trees).collect()}
    assert judged[3].n_words == 0 and judged[3].base_failed and not judged[3].kept and not judged[9].kept
    assert quality_rules.judge(empty, trees).count() == 0


def test_trees_keep_their_directions():
    rng = np.random.default_rng(2)
    x = rng.random((600, 2))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + rng.normal(0, 0.2, 600) < 0.5).astype(float)
    trees = quality_rules.boost(x, y, [-1, 0])
    line = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.5)])
    assert (np.diff(trees.margins(line)) <= 1e-12).all() and np.ptp(trees.margins(line)) > 1


# 4


def test_simhash_against_brute_force(spark, odd, empty):
    base = [f"t{i}" for i in range(60)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k:])) for k in range(50)] + [(100 + k, " ".join(base)) for k in range(80)] + [(300 + k, f"alone {k} {k * k} here") for k in range(40)]
    rows += [(r[0] + 1000, r[1]) for r in ROWS]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = simhash_dedup.brute_force([(k, None if t is None else t.encode()) for k, t in rows])
    for bucket in (64, 2):
        made = simhash_dedup.near_duplicates(docs, bucket=bucket).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in made} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in made)
    assert want[1003][0] == "0" * 16 and want[1003][1] == want[1005][1]
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert simhash_dedup.near_duplicates(odd.unionByName(odd)).count() == 2 * len(ROWS)


def test_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    prints = {centre ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for _ in range(400)}
    prints = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    classes = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    tied = {r.node: r.component for r in components.components(simhash_dedup.links(classes, bucket=5)).collect()}
    over = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if ((a ^ prints[j]) & (1 << 64) - 1).bit_count() <= 2:
                x, y = sorted((over[i], over[j]))
                over = [x if o == y else o for o in over]
    assert [tied.get(i, i) for i in range(len(prints))] == over


def test_pigeonhole_thresholds_add_up():
    rng = np.random.default_rng(4)
    layouts = {m: np.array_split(np.arange(64), m) for m in (2, 3, 4)}
    costs = {(m, i): float(rng.integers(1, 10_000)) for m in layouts for i in range(m)}
    m, t = simhash_dedup.allot(1000, np.full(64, 0.5), layouts, costs, 2)
    assert sum(t) == 2 - m + 1 and len(t) == m


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3), (200, 201), (201, 200)]
    made = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert made == {**{i: 0 for i in range(1, 31)}, **{k: 100 for k in range(101, 140)}, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5


def test_mix_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(mixing.oracle(block=32)).fetchall())
    made = sorted(tuple(r) for r in mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), block=32).collect())
    assert made == want


def test_mix_odd_rows(spark, odd, empty):
    made = mixing.mix(odd.unionByName(odd), block=4)
    assert made.columns == ["doc_id", "size", "source_size", "target", "taken"] and made.count() == 2 * len(ROWS)
    rows = made.collect()
    assert all(0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in rows)
    assert abs(sum({r.source_size: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1e-6 * 60_000
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixed_documents_have_the_words_taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        keys = F.array(*[F.lit(int(k) % n).cast("long") for k in np.random.default_rng(n).integers(1 << 40, size=mixing.ROUNDS)])
        salts = F.array(*[F.lit(int(k)).cast("long") for k in np.random.default_rng(n + 1).integers(mixing.PRIME, size=mixing.ROUNDS)])
        made = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), keys, salts).alias("p"))
        assert sorted(r.p for r in made.collect()) == list(range(n))


# 7


def test_warc_files_are_whole_and_linked(spark, tmp_path):
    pages = [(1, "http://a.example/x", "<html lang=en><title>A &amp; B</title><script>var t='</p>';</script><body><p>One<p>Two <a href='#q'>l</a><!-- no --></body></html>"), (2, "http://b.example", None), (3, None, "a\r\n\r\nWARC/1.1\r\nb"), (None, "u", "<p title='x>y'>z</p>"), (1, "http://a.example/x", "again")]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    rows = {(r.page_id, r.url): r for r in warc.derivatives(table.dropDuplicates(["page_id", "url"])).collect()}
    assert len(rows) == 4 and all(r.sound for r in rows.values())
    assert warc.derivatives(table).count() == 4 and warc.derivatives(table.limit(0)).count() == 0
    assert rows[(None, "u")].text == "z" and rows[(3, "")].text == "a\nWARC/1.1\nb" and rows[(2, "http://b.example")].text == ""
    warc.write(warc.responses(spark.createDataFrame(pages[:4], "page_id long, url string, html string")), str(tmp_path / "w"))
    parsed = [x for f in sorted((tmp_path / "w/kind=response").glob("part-*.gz")) for x in warc.parse(gzip.decompress(f.read_bytes()))]
    assert len(parsed) == 4
    for fields, block in parsed:
        assert warc.digest(block) == fields["WARC-Block-Digest"] and warc.digest(block.partition(b"\r\n\r\n")[2]) == fields["WARC-Payload-Digest"]
        for made in warc.derive(fields, block):
            f, b = warc.parse((made + warc.END).encode())[0]
            assert f["WARC-Refers-To"] == fields["WARC-Record-ID"] and f["WARC-Refers-To-Digest"] == fields["WARC-Payload-Digest"] and warc.digest(b) == f["WARC-Block-Digest"]
    assert warc.plain(pages[0][2]) == ("One\nTwo l", 1)


def test_warc_keeps_every_capture(spark, tmp_path):
    from millrace.llm import queries

    rows = [(1, "u", "first"), (1, "u", "second"), (1, "u", "second"), (None, None, "a"), (None, None, "b"), (None, "", "b"), (2, "v", None), (2, "v", ""), (3, "w", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    made = queries.op7_warc_derivatives(spark, str(tmp_path)).collect()
    assert sorted((r.page_id or 0, r.url, r.text) for r in made) == [(0, "", "a"), (0, "", "b"), (1, "u", "first"), (1, "u", "second"), (2, "v", ""), (3, "w", "x")]
    assert len({r.response_id for r in made}) == 6 and all(r.sound for r in made)


# 8


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = [centres[i % 40] + rng.normal(scale=0.12, size=16) for i in range(400)] + [centres[0]] * 30
    rows = [(i, v.astype(float).tolist(), i % 2, "x") for i, v in enumerate(x)]
    rows += [(1000, None, 0, "x"), (1001, [0.0] * 16, 0, "x"), (1002, [float("nan")] * 16, 0, "x"), (1003, x[0].tolist(), None, "x"), (1004, [None, *[1.0] * 15], 1, "x"), (1005, [1.0], 1, "x"), (1006, [], 1, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")
    ids, u = np.arange(len(x)), np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (ids[:, None] % 2 == ids % 2)
    np.fill_diagonal(near, False)
    comp = ids.copy()
    for _ in range(len(ids)):
        comp = np.minimum(comp, np.where(near, comp, len(ids)).min(axis=1))
    want = {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), comp)} | {i: (0, i) for i in range(1000, 1007)}
    for shard in (8192, 60):
        made = hnsw_dedup.near_duplicates(table, shard=shard).collect()
        got = {r.vec_id: (r.n_links, r.component_id) for r in made}
        links = sum(v[0] for v in want.values())
        assert got.keys() == want.keys() and all(got[k][0] <= want[k][0] for k in got)
        assert sum(v[0] for v in got.values()) >= 0.97 * links and all(r.kept == (r.vec_id == r.component_id) for r in made)
    assert hnsw_dedup.near_duplicates(table.limit(0)).count() == 0


def test_graph_finds_neighbours():
    rng = np.random.default_rng(7)
    x = hnsw_dedup.unit(rng.normal(size=(1500, 12)))
    graph = hnsw_dedup.Graph.load(hnsw_dedup.Graph(np.arange(1500), x).dump(), x)
    ids, _ = graph.search(x[:200].astype(np.float32), 32)
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, best)]) > 0.9


def test_audits_see_true_links():
    rng = np.random.default_rng(12)
    a, b = (hnsw_dedup.unit(rng.normal(size=(600, 16))) for _ in "ab")
    b[::60] = a[::60]

    class Blind:
        """Finds a vector itself, and no other."""

        def __init__(self, x):
            self.x = x.astype(np.float32)

        def search(self, queries, width):
            sims = queries @ self.x.T
            at = sims.argmax(axis=1)
            own = sims.max(axis=1) > 1 - 1e-6
            at[np.isin(at, np.nonzero(np.isin(np.arange(len(self.x)) % 60, 0))[0])] = -1
            ids = np.where(own, at, -1)[:, None]
            return ids, np.where(ids >= 0, 1.0, -np.inf).astype(np.float32)

    def pairs(look):
        return sorted((int(q), int(f)) for q, found in zip(*map(np.concatenate, zip(*look.batches()))) for q, f in [(q, found)])

    across = pairs(hnsw_dedup.LookUp(Blind(a), a, b, 0.93))
    assert across == [tuple(p) for p in np.argwhere(b @ a.T >= 0.93).tolist()] and len(across) >= 10
    a[1::60] = a[2::60]
    within = pairs(hnsw_dedup.LookUp(Blind(a), a, a, 0.93, True))
    assert within == [tuple(p) for p in np.argwhere(a @ a.T >= 0.93).tolist() if p[0] != p[1]]


def test_dense_groups_are_united_without_holding_pairs():
    rng = np.random.default_rng(14)
    x = hnsw_dedup.unit(rng.normal(size=16) + rng.normal(scale=0.02, size=(3000, 16)))
    side = {"ids": np.arange(3000)[::-1].copy(), "codes": np.arange(3000), "mult": np.full(3000, 2), "x": x, "graph": hnsw_dedup.Graph(np.arange(3000), x)}
    ids, codes, n, roots = hnsw_dedup.join_shards(side, None, 0.93)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert len(ids) == 3000 and (roots == 0).all() and (n <= 2 * want).all() and n.sum() >= 0.99 * 2 * want.sum()
    root = np.arange(8)
    hnsw_dedup.unite(root, np.array([7, 6, 1]), np.array([6, 5, 2]))
    hnsw_dedup.unite(root, np.array([5]), np.array([2]))
    assert root.tolist() == [0, 1, 1, 3, 4, 1, 1, 1]


def test_repeated_vector_keys(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (1, [0.0, 1.0], 0), (1, [1.0, 0.0], 0), (5, [1.0, 0.01], 0), (6, [-1.0, 0.0], 0), (6, [-1.0, 0.0], 1)]
    made = hnsw_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, made)) == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (5, 2, 1, False), (6, 0, 6, True), (6, 0, 6, True)]


def test_embeddings_of_several_large_shards(spark):
    rng = np.random.default_rng(13)
    for copies in (30, 900):
        x = rng.normal(size=(1500, 16))
        x[-copies:] = x[rng.integers(0, 1500 - copies, copies)] + rng.normal(scale=0.12, size=(copies, 16))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = (u @ u.T >= 0.93).sum(axis=1) - 1
        table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
        got = {r.vec_id: r.n_links for r in hnsw_dedup.near_duplicates(table, shard=400).collect()}
        assert all(got[i] <= near[i] for i in range(1500)) and sum(got.values()) >= 0.99 * near.sum() > 0


# 9


def test_store_gives_back_the_tokenizers_ids(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    folder = str(tmp_path / "s")
    token_store.write(odd.unionByName(odd.where("doc_id = 6").withColumn("doc_id", odd.doc_id + 100)), folder, WORDS)
    texts = {r[0]: r[1] or "" for r in ROWS} | {106: LONG}
    want = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    at, rows = 0, {r.doc_id: r for r in token_store.read_sums(spark, folder).collect()}
    for k in sorted(want):
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32, rows[k].verified) == (at, len(want[k]), zlib.crc32(np.array(want[k], "<u4").tobytes()), True)
        at += len(want[k])
    assert {r.doc_id: r.ids for r in token_store.read_ids(spark, folder).collect()} == want
    assert all(r.sound for r in token_store.verify(spark, folder).collect())
    chunks = token_store.chunk_sums(spark, folder)
    assert chunks.count() == chunks.select("digest").distinct().count() and chunks.agg({"n": "sum"}).first()[0] < sum(map(len, want.values()))
    token_store.write(empty, str(tmp_path / "e"), WORDS)
    assert token_store.read_sums(spark, str(tmp_path / "e")).count() == 0


def test_checksums_join():
    rng = np.random.default_rng(9)
    parts = [[rng.bytes(int(k)) for k in rng.integers(0, 900, m)] for m in (1, 2, 7, 300)]
    flat = [x for p in parts for x in p]
    got = token_store.CrcJoiner()(np.array([zlib.crc32(x) for x in flat]), np.array([len(x) for x in flat]), np.array([len(p) for p in parts]))
    assert got.tolist() == [zlib.crc32(b"".join(p)) for p in parts]


def test_words_encode_as_texts_do():
    from tokenizers import Tokenizer

    encoder, tokenizer = token_store.Encoder(WORDS), Tokenizer.from_file(WORDS)
    odd = ["<|startoftext|> A<|ENDOFTEXT|>b<|endoftext|>.", "it's DON'T o'clock.' l'été. x.'s", "éa. ́b e.́f", "a b c\x1cd.e", "ΑΣ. ΣΑΣ, İI", "１２3 ４.5,6", "日本語。テスト.ok", "...!? --..a", "ﬁ.x Ⅷ. ª", "word word. WORD, word", ""]
    for text in [*odd, *odd]:
        ids, n = encoder([text.encode(), b"and more."])
        assert ids[: n[0]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


# all


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "mixing", "sentencepiece"]
    some = docs.limit(60)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, some, sf_dir).columns == docs.columns
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()}
    want = simhash_dedup.brute_force([(r.doc_id, r.text.encode()) for r in docs.collect()])
    assert kept == {k for k, (_, c) in want.items() if k == c}
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.where("not lossless").count() == 0 and out.count() > 50


def test_queries_are_registered():
    from millrace.llm import queries

    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    json.dumps(list(queries.ORACLES))


def test_draws_stay_in_their_place_and_don_t_hang_on_what_was_met_before():
    v = piece_sampling.Vocabulary(PIECES)
    texts = ["some words, \n and Wörter ▁ 😀 \x00 é".encode(), b"token " * 30, b"\xff\xfe broken \xc3", b"a\n\n  b", b"\xed\xa0\x80"]
    alone, n = piece_sampling.Sampler(v).sample(texts, np.arange(5))
    assert [b == t for b, t in zip(v.decode(alone, n), texts)] == [True] * 5
    late = piece_sampling.Sampler(v)
    for k in range(20):
        late.sample([" ".join(f"w{k}x{i}" for i in range(2000)).encode()], np.array([k]))
    late.codes.shrink()
    again, m = late.sample(texts, np.arange(5))
    assert again.tolist() == alone.tolist() and m.tolist() == n.tolist()
    real = piece_sampling.drawn
    try:
        piece_sampling.drawn = lambda keys, place, step: np.full(len(keys), piece_sampling.WHOLE - 1, np.uint32)
        ids, n = late.sample(texts, np.arange(5))
    finally:
        piece_sampling.drawn = real
    assert v.decode(ids, n) == texts


def test_pieces_of_whole_texts_are_drawn_by_their_share_with_bytes():
    v = piece_sampling.Vocabulary(PIECES)
    unit = " ab€"  # the last has no piece of its own in most vocabularies

    def ways(i=0):
        if i == len(unit):
            yield (), 0.0
        for j in range(i + 1, len(unit) + 1):
            if unit[i:j] in v.pieces:
                first, w = (v.pieces[unit[i:j]][0],), v.pieces[unit[i:j]][1]
            elif j == i + 1:
                raw = unit[i].encode()
                first, w = tuple(int(v.byte[b]) for b in raw), v.unknown * len(raw)
            else:
                continue
            for rest, more in ways(j):
                yield first + rest, w + more

    every = dict(ways())
    total, n = sum(map(np.exp, every.values())), 40_000
    ids, counts = piece_sampling.Sampler(v).sample(["ab€".encode()] * n, np.arange(n))
    ends = np.cumsum(counts)
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(ends - counts, ends))
    assert set(seen) <= set(every)
    assert max(abs(seen[k] / n - np.exp(w) / total) for k, w in every.items()) < 0.01


def test_mix_counts_are_multinomial_and_meet_their_targets(spark):
    sources = spark.createDataFrame([(1, 3_000), (2, 40_000), (3, 0), (4, 17_000)], "source_no long, slots long")
    shards = mixing.n_shards(sources, 500)
    rows = mixing.shard_counts(sources, shards).collect()
    assert shards == 120
    totals, by_shard = Counter(), Counter()
    for r in rows:
        totals[r.source_no] += r.n
        by_shard[r.shard] += r.n
    assert totals == {1: 3_000, 2: 40_000, 4: 17_000}
    # Counts vary about their expectation as a multinomial's do: the sum of squares over expectations is near its degrees of freedom.
    chi = sum((r.n - by_shard[r.shard] * totals[r.source_no] / 60_000) ** 2 / (by_shard[r.shard] * totals[r.source_no] / 60_000) for r in rows)
    assert 0.7 < chi / ((shards - 1) * 2) < 1.3
    for s in (1, 2, 4):
        at = 0
        for r in sorted((r for r in rows if r.source_no == s), key=lambda r: r.shard):
            assert r.first == at
            at += r.n


def test_mixed_documents_keep_line_ends_and_repeats(spark):
    text = "one two\n\nthree  four\tfive\n" * 20
    rows = [(1, text, "a", None), (1, text, "a", None), (2, text, "a", "x"), (3, "w " * 300, "b", None), (4, None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mixed_documents(docs, block=8, shard=16).collect()
    want = Counter()
    for r in mixing.mix(docs, block=8, shard=16).collect():
        want[r.doc_id] += r.taken
    got = Counter()
    for r in out:
        got[r.doc_id] += len(r.text.split())
        assert set(re.findall(r"\s+", r.text)) <= {" ", "  ", "\n", "\n\n", "\t"}
    assert got == {k: v for k, v in want.items() if v} and any("\n\n" in r.text for r in out)


def test_pipeline_on_odd_rows(spark, odd, empty, sf_dir):
    import corpus_pipeline

    docs = odd.unionByName(odd).unionByName(spark.createDataFrame([(1, "another text of the first id, far from it", "en", "a", 40, "x", "y", "z", "s"), (None, "no id here", "en", "a", 10, None, None, None, None)], SCHEMA))
    kept = corpus_pipeline.one_of_each(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in kept.collect()) == [(0, "no id her"), (1, "another t"), (1, "the quick"), (3, ""), (6, LONG[:9]), (7, "ein Satz "), (9, "x" * 9)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() >= 0 and stage(spark, empty, sf_dir).count() == 0
    toxic = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert toxic.columns == docs.columns and toxic.count() == docs.count()


def test_fits_take_the_least_of_clashing_labels_and_texts(spark, odd):
    from millrace.llm import common

    rows = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    assert sorted(map(tuple, common.labelled(rows, "doc_id", "quality", "y").collect())) == [(1, 0), (2, 1)]
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x" * 50), (4, "other")], "doc_id long, text string")
    held = common.texts_of(docs, common.labelled(rows, "doc_id", "quality", "y"), "doc_id", "text")
    assert sorted((r["__id"], r["__text"][:2], r.y) for r in held.collect()) == [(1, "a", 0), (2, "xx", 1)]
    assert common.texts_of(docs, common.labelled(rows, "doc_id", "quality", "y"), "doc_id", "text", most_bytes=10).count() <= 1
    some = common.sample_rows(spark.range(100).selectExpr("id", "id % 3 as g"), "id", 5, "g")
    assert some.groupBy("g").count().where("count = 5").count() == 3


def naive_toxicity(model, text):
    """The evidence of one text, unit by unit."""
    words = [toxicity.units(w.decode()) for w in (text or b"").split()]
    held, before, total = [], "", 0
    pairs = dict(zip(model.pairs.keys.tolist(), model.pairs.llr.tolist()))
    last = None
    for raw, us in zip((text or b"").split(), words):
        at = 0.0
        for u in us:
            known = model.pairs.ids.get(before, -1), model.pairs.ids.get(u, -1)
            key = known[0] << 32 | known[1] if min(known) >= 0 else None
            alone = model.words.get(u)
            if alone is None:
                alone = next((model.starts[u[:k]] for k in toxicity.LEVELS if len(u) >= k and u[:k] in model.starts), 0.0)
            at += pairs.get(key, alone)
            before, total = u, total + 1
        held.append(0.0 if raw == last else at)
        last = raw
    best = [max([0.0, *(sum(held[i : i + k]) for i in range(max(1, len(held) - k + 1)))]) / k for k in model.windows]
    return [sum(held) / max(total, 1), *best]


def test_scorers_against_naive_ones():
    rng = np.random.default_rng(21)
    vocabulary = ["bad", "banker", "fine,", "Good!", "x1y", "éa", "--", "worse-off", "ok"]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40))).encode() for _ in range(60)] + [None, b"", b"bad"]
    model = toxicity.Model({"bad": 2.0, "good": -1.0, "ok": -0.5}, {"ba": 0.7, "wo": 0.3, "fi": -0.2}, toxicity.Pairs(["", "bad", "good"], ["bad", "ok", "bad"], [3.0, 1.5, -2.0]))
    got = toxicity.Scorer(model).evidence(texts)
    assert np.allclose(got, [naive_toxicity(model, t) for t in texts])
    table = rng.normal(size=(64, 2))
    lang = language_id.Model(["a", "b"], table, np.array([0.1, -0.1]))
    logits, some = language_id.Scorer(lang).logits(texts)
    for t, x, s in zip(texts, logits, some):
        ids = [i for w in (t or b"").split() for i in language_id.subwords([language_id.letters(w.decode())], 64)[0]]
        assert s == bool(ids) and np.allclose(x, (table[ids].mean(axis=0) if ids else 0) + lang.bias)
    weights = rng.normal(size=256).astype(np.float32)
    quality = quality_classifier.Scorer(quality_classifier.Model(weights, 0.2))
    features = quality_classifier.Features(256)
    for t, p in zip(texts, quality.scores(texts)):
        ids, n = features.ids([t])
        assert np.isclose(p, 1 / (1 + np.exp(-(float(weights[ids[ids >= 0]].sum()) / max(int(n[0]), 1) + 0.2))))


def test_warc_files_by_another_reader(spark, tmp_path):
    from html.parser import HTMLParser

    pages = [(i, f"http://a.example/{i}", f"<html><body><p>Page {i} &amp; more</p><div>Z\u00e4hl {'x ' * i}</div></body></html>") for i in range(40)] + [(99, "u", "<p>" + "long " * 200_000 + "</p>")]
    folder = str(tmp_path / "w")
    warc.write(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string")), folder)
    warc.write(warc.derived(spark, f"{folder}/kind=response"), f"{folder}/made")

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words = []

        def handle_data(self, data):
            self.words += data.split()

    found = Counter()
    for f in (tmp_path / "w/made").rglob("part-*.gz"):
        rest = gzip.decompress(f.read_bytes())
        while rest:
            head, _, rest = rest.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            block, rest = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) + 4 :]
            found[fields["WARC-Type"]] += 1
            if fields["WARC-Type"] == "conversion":
                parser = Words()
                parser.feed(dict((str(p[0]), p[2]) for p in pages)[fields["WARC-Page-ID"]])
                assert block.decode().split() == parser.words
    assert found == {"metadata": 41, "conversion": 41}


def test_store_of_a_hot_passage_and_repeated_keys(spark, tmp_path):
    shared = " ".join(f"passage{i}" for i in range(900))
    rows = [(i, f"own{i} {shared if i % 3 == 0 else ''} tail{i}") for i in range(120)] + [(5, "again"), (None, "none"), (None, None)]
    folder, before = str(tmp_path / "h"), (token_store.HOT, token_store.PART_ROWS)
    try:
        token_store.HOT, token_store.PART_ROWS = 10, 16
        token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, WORDS)
        made = token_store.read_sums(spark, folder).collect()
        parts = spark.read.parquet(f"{folder}/manifest").collect()
    finally:
        token_store.HOT, token_store.PART_ROWS = before
    assert len(made) == 123 and all(r.verified for r in made) and max(p.n_docs for p in parts) <= 16 and sum(p.n_docs for p in parts) == 123
    at = 0
    for r in sorted(made, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    with pytest.raises(ValueError):
        token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "x"), WORDS, width=1)


def test_subwords_of_many_new_words_are_worked_out_in_parts(monkeypatch):
    words = [f"word{i}x{i * i}".encode() for i in range(5000)]
    model = language_id.Model(["a", "b"], np.random.default_rng(1).normal(size=(64, 2)), np.zeros(2))
    whole = language_id.Scorer(model)
    monkeypatch.setattr(language_id, "GROW_WORDS", 10_000)
    whole.grow(words)
    monkeypatch.undo()
    made, most = language_id.subwords, []
    monkeypatch.setattr(language_id, "subwords", lambda w, n: most.append(len(w)) or made(w, n))
    parts = language_id.Scorer(model)
    parts.grow(words)
    assert max(most) == language_id.GROW_WORDS < 5000
    assert np.allclose(whole.rows.all, parts.rows.all, atol=1e-9) and (whole.n.all == parts.n.all).all()


def test_sampling_takes_little_beside_what_it_remembers():
    """Two of its workers share an executor with a JVM: lattices of new units, what stays of them and a slice's ids are worked out in parts."""
    texts = [" ".join(f"word{k}x{i * i}" for i in range(2000)).encode() for k in range(20)]
    keys = np.arange(20)
    sampler = piece_sampling.Sampler(piece_sampling.Vocabulary(PIECES))

    def beside(step):
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        step()
        after, most = tracemalloc.get_traced_memory()
        return (most - max(before, after)) / 1e6

    tracemalloc.start()
    try:
        grown = beside(lambda: sampler.sample(texts, keys))
        sampler.sample(texts, keys)
        ids, n = sampler.sample(texts, keys)
        back: list = []
        decoded = beside(lambda: back.extend(sampler.v.decode(ids, n)))
        sampler.codes.limit = 3 * 30_000
        shrunk = beside(sampler.codes.shrink)
    finally:
        tracemalloc.stop()
    assert back == texts and 20_000 < sampler.size.n < 40_000
    again, m = sampler.sample(texts, keys)
    alone, k = piece_sampling.Sampler(sampler.v).sample(texts, keys)
    assert again.tolist() == alone.tolist() == ids.tolist() and m.tolist() == k.tolist() == n.tolist()
    assert grown < 30 and decoded < 5 and shrunk < 12
