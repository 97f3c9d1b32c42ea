"""Token ids in a content-addressed store of files.

Every document's ids (an end id appended) are cut into chunks where a rolling hash of the last RUN ids says so, so equal
passages give equal chunks. Three Parquet tables in one folder are the file format:

  kind=chunk    digest (blake2b, 16 bytes), payload (ids as little-endian unsigned numbers of `width` bytes): each digest once
  recipes       part, doc_id, start, n_tokens, digests, root (Merkle root of the digests), in ascending doc_id order
  manifest      part, n_docs, n_tokens, root (Merkle root over the part's documents)

Rows go through one shuffle by digest; tasks drop what they have already sent, so a chunk in a third of all documents
reaches its partition few times a task, and lie there in digest order, so that one look back tells what is stored. A part has
at most PART_ROWS documents. Reading checks every payload against its digest, every document against its
root and every part against the manifest; checksums of documents are put together from those of their chunks, so payloads
aren't moved again. Chunks that more than HOT places hold are dealt over SALTS keys when places and checksums meet.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import Growing, WordCodes, workers_import, slices, spread, words_in, written

RUN = 8
MEAN_BITS = 8
SHORTEST, LONGEST = 64, 1024
END_ID = 1
DIGEST = 16
SEEN = 500_000
PART_ROWS = 50_000
HOT = 20_000
SALTS = 64
#: Words that a task remembers.
WORDS_KEPT = 450_000
ROWS = "kind string, key binary, doc_id long, n_tokens long, digests array<binary>, payload binary"
RECIPES = "part long, doc_id long, start long, n_tokens long, digests array<binary>, root binary"
MANIFEST = "part long, n_docs long, n_tokens long, root binary"


def digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=DIGEST)
    for p in parts:
        h.update(p)
    return h.digest()


def merkle(leaves: Iterable[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is; no leaf: the digest of nothing."""
    level = list(leaves)
    if not level:
        return digest()
    while len(level) > 1:
        paired = [digest(b"\x01", a, b) for a, b in zip(level[::2], level[1::2])]
        level = paired + level[len(level) - len(level) % 2 :]
    return level[0]


def document_leaf(doc_id: int | None, n: int, root: bytes) -> bytes:
    return digest(b"\x00", repr(doc_id).encode(), n.to_bytes(8, "little"), root)


#: A mark between an ASCII or Latin-1 letter or a digit and white space: there the tokenizer always parts pre-tokens.
CLOSING = re.compile(rb"[.,;:!?](?=[ \n])(?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))")
#: Begins the tokenizer's special tokens, which it finds in texts before it lower-cases them.
SPECIAL = b"<|"


def encodable(text: bytes | None) -> bytes:
    """A text with closing marks apart and ASCII letters lower-cased, unless that could make a special token."""
    text = text or b""
    return text if SPECIAL in text else CLOSING.sub(rb" \g<0>", text.lower())


class Encoder:
    """Ids of texts by a tokenizer that lower-cases and never joins what white space parts: words met before aren't encoded again.

    Fresh words of letters alone are one pre-token each; they are encoded many at once and told apart by the word ends in their last tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if any(plain(t) != plain("ab") + plain("cd") + plain(".") for t in ("ab cd.", "AB Cd .", "\nab\tcd  . ")):
            raise ValueError("the tokenizer must lower-case texts and part them at white space and marks")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.ids, self.first, self.n = Growing(np.uint16 if len(self.closes) <= 1 << 16 else np.uint32), Growing(np.int64), Growing(np.int32)
        self.codes = WordCodes(self.grow, self.restart, WORDS_KEPT, self.retain)

    def restart(self):
        for g in (self.ids, self.first, self.n):
            g.clear()

    def retain(self, kept: np.ndarray):
        n = self.n.all[kept]
        self.ids.put(self.ids.all[spread(self.first.all[kept], n)])
        self.first.put(np.cumsum(n, dtype=np.int64) - n)
        self.n.put(n)

    def each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, encoded one by one, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found))

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As each, for words of letters alone."""
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a in range(0, len(words), 1000):
            some = words[a : a + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.nonzero(self.closes[ids])[0] + 1
            good = len(ends) == len(some) and ends[-1] == len(ids)
            parts.append((ids, np.diff(ends, prepend=0)) if good else self.each(some))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def grow(self, words):
        """Keeps the ids of fresh words."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        ids, n = (np.concatenate(x) for x in zip(self.joined(list(itertools.compress(texts, plain))), self.each(list(itertools.compress(texts, ~plain)))))
        back = np.argsort(np.concatenate([np.nonzero(plain)[0], np.nonzero(~plain)[0]]), kind="stable")
        first = (np.cumsum(n) - n)[back]
        n = n[back]
        self.first.extend(self.ids.n + np.cumsum(n) - n)
        self.n.extend(n)
        self.ids.extend(ids[spread(first, n)])

    def __call__(self, texts: list, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids with an end id after each text, and how many each text has."""
        found, words = words_in([encodable(t) for t in texts])
        codes = self.codes(found)
        n = self.n.all[codes].astype(np.int64)
        flat = self.ids.all[spread(self.first.all[codes], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        ends = total[np.cumsum(words)]
        return np.insert(flat, ends, end), np.diff(np.concatenate([[0], ends])) + 1


#: Encoders of a Python worker by their file: what one task has encoded, the worker's next tasks don't encode again.
held_encoders: dict[str, Encoder] = {}


def held_encoder(path: str) -> Encoder:
    if path not in held_encoders:
        held_encoders[path] = Encoder(path)
    return held_encoders[path]


def cuts(ids: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    """For each text the ends of its chunks, counted from the text's start."""
    g = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(31)
    roll = np.zeros(len(ids), np.uint64)
    for k in range(RUN - 1, -1, -1):
        roll *= np.uint64(0x100000001B3)
        roll[k:] += g[: len(ids) - k] if k else g
    marks = np.nonzero((roll >> np.uint64(40)) & np.uint64((1 << MEAN_BITS) - 1) == 0)[0]
    out, at = [], 0
    for n in lengths.tolist():
        lo, hi = np.searchsorted(marks, (at + RUN - 1, at + n))
        ends, last = [], 0
        for m in (marks[lo:hi] - at + 1).tolist():
            while m - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if m - last >= SHORTEST:
                last = m
                ends.append(m)
        while n - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if n > last:
            ends.append(n)
        out.append(ends)
        at += n
    return out


def chunked(encoder: Encoder, texts: list, width: int) -> list[tuple[int, list[bytes], list[bytes]]]:
    """(number of ids, digests, payloads) of each text."""
    ids, lengths = encoder(texts)
    raw, out, at = ids.astype(f"<u{width}").tobytes(), [], 0
    for n, ends in zip(lengths.tolist(), cuts(ids, lengths)):
        payloads = [raw[(at + a) * width : (at + b) * width] for a, b in zip([0, *ends], ends)]
        out.append((n, [digest(p) for p in payloads], payloads))
        at += n
    return out


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", width: int = 2) -> None:
    """Encodes the whole texts and writes the store. A null text is empty; null keys come first; rows of equal keys are kept in the order of their digests."""
    spark = docs.sparkSession
    workers_import(spark)

    def encode(batches):
        encoder, seen = held_encoder(tokenizer), set()
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for k, (n, digests, payloads) in zip(part.column(0).to_pylist(), chunked(encoder, part.column(1).to_pylist(), width)):
                    rows.append(("recipe", merkle(digests), k, n, digests, None))
                    for d, p in zip(digests, payloads):
                        if d not in seen:
                            seen.add(d)
                            rows.append(("chunk", d, None, None, None, p))
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary()))], names=["kind", "key", "doc_id", "n_tokens", "digests", "payload"])

    def once(batches):
        last = None  # the key before, in a partition that is sorted by key and, within one, has chunks first
        for batch in batches:
            if batch.num_rows:
                keys = batch.column(1)
                new = pc.not_equal(keys, pa.concat_arrays([pa.array([last], pa.binary()), keys.slice(0, len(keys) - 1)]))
                last = keys[len(keys) - 1].as_py()
                yield batch.filter(pc.or_(pc.equal(batch.column(0), "recipe"), pc.fill_null(new, True)))

    if len(Encoder(tokenizer).closes) > 1 << 8 * width:
        raise ValueError(f"ids of this vocabulary don't fit {width} bytes")
    rows = docs.select(F.col(key).cast("long"), F.col(text).cast("string").cast("binary").alias("t")).mapInArrow(encode, ROWS)
    deal = F.when(F.col("kind") == "chunk", F.xxhash64("key")).otherwise(F.xxhash64("doc_id", "key"))
    rows.repartition(deal).sortWithinPartitions("key", "kind").mapInArrow(once, ROWS).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/rows")
    held = spark.read.schema(ROWS).parquet(f"{folder}/rows").where("kind = 'recipe'").select("doc_id", "n_tokens", "digests", F.col("key").alias("root"))
    ordered = held.repartitionByRange(F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    place = F.monotonically_increasing_id()  # the partition's number and 33 bits for the row's place in it
    part = F.shiftright(place, 33) * (1 << 24) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / PART_ROWS)
    ordered.withColumn("part", part.cast("long")).write.parquet(f"{folder}/sorted")
    recipes = spark.read.schema(RECIPES.replace("start long, ", "")).parquet(f"{folder}/sorted")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = recipes.groupBy("part").agg(F.sum("n_tokens").alias("words")).select("part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root")
    starts = recipes.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts.join(parts, "part").select("part", "doc_id", (F.col("base") + F.col("before")).cast("long").alias("start"), "n_tokens", "digests", "root").write.parquet(f"{folder}/recipes")
    manifest(spark.read.schema(RECIPES).parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def manifest(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, root): leaves are made in place and gathered part by part, 16 bytes a document."""

    def leaves(batches):
        for batch in batches:
            part, ids, starts, n, roots = (batch.column(i) for i in range(5))
            made = [document_leaf(k, m, r) for k, m, r in zip(ids.to_pylist(), n.to_pylist(), roots.to_pylist())]
            yield pa.RecordBatch.from_arrays([part, starts, n, pa.array(made, pa.binary())], names=["part", "start", "n_tokens", "leaf"])

    def roots(batches):
        for batch in batches:
            made = [merkle(x["leaf"] for x in v) for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(made, pa.binary())], names=["part", "n_docs", "n_tokens", "root"])

    workers_import(recipes.sparkSession)
    made = recipes.select("part", "doc_id", "start", "n_tokens", "root").mapInArrow(leaves, "part long, start long, n_tokens long, leaf binary")
    held = made.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "leaf"))).alias("leaves"))
    return held.mapInArrow(roots, "part long, n_docs long, n_tokens long, root binary")


def crc_times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As crc_times, for arrays."""
    out, b = np.zeros(len(a), np.uint32), b.astype(np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = b >> np.uint32(1) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return out


class CrcJoiner:
    """Checksums of strings from those of their parts and the parts' lengths."""

    def __init__(self):
        self.powers = []  # powers[j][k]: x to 8 * k * 256^j
        step = 1 << 23  # x^8, bits reflected
        for _ in range(5):
            row = [1 << 31]
            for _ in range(255):
                row.append(crc_times(row[-1], step))
            self.powers.append(np.array(row, np.uint32))
            step = crc_times(row[-1], step)

    def __call__(self, crcs: np.ndarray, n_bytes: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """parts: how many parts each string has, in order; at least one."""
        ends = np.cumsum(parts)
        total = np.cumsum(n_bytes)
        after = np.repeat(total[ends - 1], parts) - total  # bytes behind a part in its string
        shift = self.powers[0][after & 255]
        for j in range(1, 5):
            if (after >> (8 * j)).any():
                shift = crc_product(shift, self.powers[j][after >> (8 * j) & 255])
        return np.bitwise_xor.reduceat(crc_product(crcs.astype(np.uint32), shift), ends - parts)


def chunk_sums(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """(digest, n, crc, sound) of every stored chunk: crc of its ids as little-endian 32-bit numbers, sound if its payload has its digest."""

    def run(batches):
        for batch in batches:
            keys, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            crc = [zlib.crc32(np.frombuffer(p, f"<u{width}").astype("<u4").tobytes()) for p in payloads]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // width for p in payloads], pa.int64()), pa.array(crc, pa.int64()), pa.array([digest(p) == k for k, p in zip(keys, payloads)], pa.bool_())], names=["digest", "n", "crc", "sound"])

    workers_import(spark)
    rows = spark.read.schema(ROWS).parquet(f"{folder}/rows").where("kind = 'chunk'").select("key", "payload")
    return rows.mapInArrow(run, "digest binary, n long, crc long, sound boolean")


def read_sums(spark: SparkSession, folder: str, key: str = "doc_id", width: int = 2) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, verified) of every document, from the files alone.

    verified: all chunks are there and sound, their lengths add up, the document's root is that of its recipe and the
    part's documents give the root, the number of documents and the number of ids in the manifest.
    """

    def run(batches):
        join = CrcJoiner()
        for batch in batches:
            n_tokens, lists, good = batch.column(2).to_pylist(), batch.column(4).to_pylist(), []
            n = np.array([p["n"] or 0 for parts in lists for p in parts], np.int64)
            count = np.array([len(parts) for parts in lists], np.int64)
            crc = join(np.array([p["crc"] or 0 for parts in lists for p in parts], np.int64), 4 * n, count) if len(n) else np.zeros(0)
            total = np.add.reduceat(n, np.cumsum(count) - count) if len(n) else n
            for want, got, root, parts, whole in zip(n_tokens, total.tolist(), batch.column(3).to_pylist(), lists, batch.column(5).to_pylist()):
                good.append(whole and got == want and all(p["sound"] for p in parts) and merkle(p["digest"] for p in parts) == root)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total, pa.int64()), pa.array(crc.astype(np.int64)), pa.array(good, pa.bool_())], names=[key, "start", "n_tokens", "ids_crc32", "verified"])

    recipes = spark.read.schema(RECIPES).parquet(f"{folder}/recipes")
    places = recipes.select("start", F.posexplode("digests").alias("pos", "digest"))
    hot = written(places.groupBy("digest").count().where(F.col("count") > HOT).select("digest", F.lit(True).alias("hot")), "hot-chunks")
    dealt = places.join(hot, "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("start", "pos"), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    sums = chunk_sums(spark, folder, width).join(hot, "digest", "left").withColumn("salt", F.explode(copies)).drop("hot")
    met = dealt.drop("hot").join(sums, ["digest", "salt"], "left").drop("salt")
    parts = met.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "n", "crc", "sound"))).alias("parts"))
    whole = written(verify(spark, folder), "verified-parts").where("not sound").select("part", F.lit(True).alias("broken"))
    held = recipes.select("doc_id", "start", "n_tokens", "root", "part").join(whole, "part", "left").join(parts, "start").select("doc_id", "start", "n_tokens", "root", "parts", F.col("broken").isNull())
    return held.mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long, verified boolean")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """(part, sound): whether each part's recipes still give its row of the manifest."""
    now = manifest(spark.read.schema(RECIPES).parquet(f"{folder}/recipes"))
    then = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    same = F.struct("root", "n_docs", "n_tokens")
    return then.select("part", same.alias("then")).join(now.select("part", same.alias("now")), "part", "full").select("part", F.col("then").eqNullSafe(F.col("now")).alias("sound"))


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id", width: int = 2) -> DataFrame:
    """(key, start, ids): the ids themselves; moves the payloads."""
    rows = spark.read.schema(ROWS).parquet(f"{folder}/rows").where("kind = 'chunk'").select(F.col("key").alias("digest"), "payload")
    recipes = spark.read.schema(RECIPES).parquet(f"{folder}/recipes")
    places = recipes.select("doc_id", "start", F.posexplode("digests").alias("pos", "digest")).join(rows, "digest")
    whole = places.groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("parts"))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in v), f"<u{width}").astype(np.int64) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], names=[key, "start", "ids"])

    return whole.mapInArrow(run, f"{key} long, start long, ids array<long>")
