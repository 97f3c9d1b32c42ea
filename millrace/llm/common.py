"""What the training-data operators share: table access, shared folders, batched text mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import count, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that part words: space and U+0009 to U+000D. bytes.split() parts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]*"
BATCH_BYTES = 6 << 20
#: Texts are worked on in slices of about so many bytes.
SLICE_BYTES = 2 << 20
#: Words that a task remembers before it starts afresh, and their bytes.
CACHE_WORDS = 400_000
CACHE_BYTES = 16 << 20
#: A classifier learns from labelled texts of so many bytes at most.
FIT_BYTES = 64 << 20
#: Bytes as terms take them: A to Z lower-cased, other ASCII characters that are no letters blank, the bytes of all others as they are.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one where it is unset and the session is a local one, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    found = found or tempfile.mkdtemp(prefix="millrace-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, read again."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds idx, a row's number in its group from 0, and n, the group's rows. rows: a written table, as they are read twice; group: a column without nulls.

    Rows are sorted into ranges of (group, order); what is added up by a window is a row for each range and group.
    """
    sorted_ = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__at", F.monotonically_increasing_id())
    held = written(sorted_, "ranges").withColumn("__part", F.shiftright("__at", 33))
    per = held.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("n", F.sum("__n").over(Window.partitionBy(group))).drop("__n")
    joined = held.join(per, [group, "__part"])
    return joined.withColumn("idx", (F.col("__before") + F.col("__at") - F.col("__first")).cast("long")).drop("__at", "__part", "__first", "__before")


def workers_import(spark: SparkSession) -> None:
    """Lets workers on shared disks import this package, and holds the Arrow batches they get to BATCH_BYTES, whatever their rows."""
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), home]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Gives memory that is no longer used back to the system. Workers are used again by later stages, and what allocators keep for them counts against an executor."""
    gc.collect()
    give_back()


def give_back() -> None:
    """The part of trim() that takes a few milliseconds, for use after each slice: what a slice took meanwhile is freed in pieces, which add up over slices."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # there is no such call outside of glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run with trim() before it and after it, when what it remembered is no longer held: a worker may idle through the next stages."""

    def held(batches):
        trim()
        yield from run(batches)
        trim()

    return held


def remainder(col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string")) % n


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts with about most_bytes of a binary column each; a longer value is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        held = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def slices_of(texts: Sequence[bytes]) -> Iterator[Sequence[bytes]]:
    """Texts in runs of about SLICE_BYTES."""
    start = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > SLICE_BYTES:
            yield texts[start:k]
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield texts[start:]


def words_in(texts: Sequence[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as one binary array, and how many each text has."""
    data = np.frombuffer(b" ".join([b"", *[t or b"" for t in texts], b""]), np.uint8)
    white = WHITE[data]
    edges = np.nonzero(white[1:] != white[:-1])[0] + 1  # where words begin and end, in turn
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum(np.array([len(t or b"") for t in texts], np.int64) + 1)
    return runs(data[~white], np.cumsum(lengths) - lengths), np.diff(np.searchsorted(starts, ends), prepend=0)


def runs(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes cut at `starts`, the first of which is 0, as a binary array."""
    offsets = np.append(starts, len(data) if len(starts) else 0).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class WordCodes:
    """Numbers words as they are met; `grow` is called with new words and extends what is kept per number.

    At most about `limit` words of `limit_bytes` together are remembered between slices. Then `restart` is called and
    numbering starts at 0 again or, if there is a `retain`, the words met most often stay: it is called with their
    numbers in rising order, which become 0, 1, ...
    """

    def __init__(self, grow: Callable[[list], None], restart: Callable[[], None], limit: int = CACHE_WORDS, retain: Callable[[np.ndarray], None] | None = None, limit_bytes: int = CACHE_BYTES):
        self.grow, self.restart, self.limit, self.retain, self.limit_bytes = grow, restart, limit, retain, limit_bytes
        self.index: dict = defaultdict(count().__next__)
        self.met = np.zeros(0, np.int64)
        self.n_bytes = 0

    def shrink(self) -> None:
        self.n_bytes = 0
        if self.retain is None:
            self.index = defaultdict(count().__next__)
            return self.restart()
        words = list(self.index)
        often = np.argsort(-self.met, kind="stable")[: self.limit // 3]
        often = often[self.met[often] > 1]
        size = np.cumsum([len(words[i]) for i in often.tolist()])
        kept = np.sort(often[size <= self.limit_bytes // 3])
        self.index = defaultdict(count(len(kept)).__next__, zip([words[i] for i in kept.tolist()], range(len(kept))))
        self.n_bytes = sum(map(len, self.index))
        self.met = self.met[kept] // 2
        self.retain(kept)

    def __call__(self, words: pa.Array) -> np.ndarray:
        if len(self.index) > self.limit or self.n_bytes > self.limit_bytes:
            self.shrink()
        before = len(self.index)
        coded = words.dictionary_encode()
        each, of_each = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        codes = np.fromiter(map(self.index.__getitem__, each), np.int64, len(each))  # an unknown word gets the next number
        fresh = len(self.index) - before
        if fresh:
            new = list(islice(reversed(self.index), fresh))[::-1]
            self.n_bytes += sum(map(len, new))
            self.grow(new)
        if self.retain is not None:
            self.met = np.pad(self.met, (0, len(self.index) - len(self.met)))
            self.met[codes] += np.bincount(of_each, minlength=len(each))
        return codes[of_each]


class Growing:
    """A numpy array that is extended at its end."""

    def __init__(self, dtype, width: int = 0):
        self.width = width
        self.held = np.empty((1024, width) if width else 1024, dtype)
        self.n = 0

    def extend(self, more: np.ndarray) -> None:
        need = self.n + len(more)
        if need > len(self.held):
            bigger = np.empty((max(need, 2 * len(self.held)), *self.held.shape[1:]), self.held.dtype)
            bigger[: self.n] = self.held[: self.n]
            self.held = bigger
        self.held[self.n : need] = more
        self.n = need

    def clear(self) -> None:
        self.n = 0

    def put(self, all_: np.ndarray) -> None:
        """Holds these instead."""
        self.n = 0
        self.extend(all_)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i]+1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return at


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; runs may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def map_texts(df: DataFrame, text: str, setup: Callable[[], Callable[[list], dict]], fields: Iterable[tuple[str, T.DataType]], keep: Sequence[str] | None = None, key: str | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Adds columns made from a text column, slice by slice of about slice_bytes.

    setup() is called once a task and returns a function from a list of UTF-8 texts (None for null) to the new columns, as lists or Arrow arrays.
    keep: the input columns that stay (default: all). A new column replaces an input column of its name.
    key: the function also gets a 64-bit hash of this column for every text.
    """
    fields = list(fields)
    new = [n for n, _ in fields]
    stay = [c for c in (keep if keep is not None else df.columns) if c not in new]
    schema = T.StructType([df.schema[c] for c in stay] + [T.StructField(n, t) for n, t in fields])
    workers_import(df.sparkSession)
    extra = [F.xxhash64(F.col(f"`{key}`").cast("string")).alias("__key")] if key else []
    sent = df.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{text}`").cast("string").cast("binary").alias("__text"), *extra)

    def mapped(part, work):
        texts = part.column(len(stay)).to_pylist()
        made = work(texts, part.column(len(stay) + 1).to_numpy(zero_copy_only=False)) if key else work(texts)
        arrays = [part.column(i) for i in range(len(stay))] + [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], type=arrow_type(t)) for n, t in fields]
        return pa.RecordBatch.from_arrays(arrays, names=[*stay, *new])

    def run(batches):
        work = setup()
        for batch in batches:
            for part in slices(batch, len(stay), slice_bytes):
                yield mapped(part, work)
                give_back()

    return sent.mapInArrow(trimmed(run), schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    simple = {"long": pa.int64(), "integer": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}
    return pa.list_(arrow_type(t.elementType)) if isinstance(t, T.ArrayType) else simple[t.typeName()]


def labelled(rows: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """(key, name): one label a key; of rows that repeat a key the least label counts. Null keys and labels are left out."""
    return rows.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias(name))


def sample_rows(df: DataFrame, key: str, n: int, by: str | None = None) -> DataFrame:
    """At most n rows, of each value of `by` if it is given, the first by a hash of the key: the same rows whatever the partitioning."""
    order = [F.xxhash64(F.col(key).cast("string")), F.col(key)]
    if by is None:
        return df.orderBy(*order).limit(n)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def texts_of(docs: DataFrame, rows: DataFrame, key: str, text: str, most_bytes: int = FIT_BYTES) -> DataFrame:
    """(__id, __text, columns of rows): texts of a bounded set of labelled rows, which is small enough to be sent to every executor, of most_bytes at most in the order of the sample.

    Of rows that repeat an id the least text is taken.
    """
    met = docs.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("__text")).join(F.broadcast(rows.withColumnRenamed(key, "__id")), "__id")
    once = written(met.groupBy("__id").agg(*[F.min(c).alias(c) for c in met.columns if c != "__id"]), "sample")
    # Only ids and lengths go through the one window.
    upto = F.sum("__bytes").over(Window.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id"))
    sizes = once.select("__id", F.coalesce(F.octet_length("__text"), F.lit(0)).alias("__bytes")).withColumn("__upto", upto)
    return once.join(F.broadcast(sizes.where(F.col("__upto") <= most_bytes).select("__id")), "__id")
