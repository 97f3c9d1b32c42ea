"""Mixing sources to target weights, in DataFrame functions alone.

Each source's documents form a stream of words in a hashed order, which is cut into blocks of `block` words. The
mix is a row of shards of slots, one block a slot. Every slot of a source falls in a shard drawn by a hash, so a source's
counts over the shards are a multinomial draw of its slots, and a shard of a given length has multinomial counts of
sources; each source's slots add up to its target. Slot j of a source takes, in pass j div n over its n blocks, the block at
permutation(j mod n), a swap-or-not shuffle of its own for each source and pass; slots beyond `most` passes stay
empty. Slots and blocks meet in an equi-join on (source, block), so a source with a third of all rows is spread over
as many keys as it has blocks. Word offsets are two-level prefix sums over about sqrt(rows) hashed buckets a source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, WORD, written

WEIGHTS = (5, 2, 1)
BLOCK = 128
SHARD = 4096
MOST = 3
SEED = 17
ROUNDS = 24
PRIME = 2147483647
#: Slots whose shards one row draws.
DRAWS = 65_536


def hashed(*parts) -> Column:
    """48 bits of the md5 of the parts, as a long."""
    joined = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("long")


def with_sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(source, source_no, source_size, weight, target, n_blocks, slots): a row a source, in code point order, null last.

    Targets are a water level: sources in order of most * size / weight are held at most * size while their share at
    the level that the rest would have is larger; the rest share what is left by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.col("source_no") - 1, F.lit(len(weights))).cast("int") + 1)
    per = per.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")).withColumn("weight", w.cast("long"))
    up = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    before, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("held", most * F.col("source_size") / F.col("weight") < F.col("level")).withColumn("turn", F.row_number().over(up))
    last = F.min(F.when(~F.col("held"), F.struct("turn", "level"))).over(whole)["level"]
    target = F.when(F.col("held"), (most * F.col("source_size")).cast("double")).otherwise(F.least(last * F.col("weight"), (most * F.col("source_size")).cast("double")))
    per = per.withColumn("target", target).withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("long")
    return per.withColumn("slots", slots).select("source", "source_no", "source_size", "weight", "target", "n_blocks", "slots")


def n_shards(sources: DataFrame, shard: int = SHARD) -> int:
    """How many shards the mix has: of about `shard` slots, or the root of all slots if that is more."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    return max(1, math.ceil(total / max(shard, math.ceil(math.sqrt(total)))))


def shard_counts(sources: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(source_no, shard, n, first): multinomial counts of a shard's slots by source, and the number of the source's first such slot."""
    some = sources.where("slots > 0").select("source_no", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {DRAWS})")).alias("part"))
    some = some.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_no", "part")  # few rows, but each makes many
    each = some.select("source_no", F.explode(F.expr(f"sequence(part * {DRAWS}, least(slots, (part + 1) * {DRAWS}) - 1)")).alias("j"))
    drawn = each.select("source_no", F.pmod(hashed(seed, "draw", F.col("source_no"), F.col("j")), F.lit(shards)).alias("shard"))
    counts = drawn.groupBy("source_no", "shard").agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("first", F.coalesce(first, F.lit(0)).cast("long"))


def permuted(x: Column, n: Column, keys: Column, salts: Column) -> Column:
    """Swap-or-not shuffle of 0..n-1: each round pairs x with key - x modulo n and swaps the two or not by a bit of the larger."""

    def bit(y: Column, salt: Column) -> Column:
        v = F.pmod(F.pmod(y, F.lit(PRIME)) * salt + F.floor(y / F.lit(PRIME)) + 1, F.lit(PRIME))
        v = F.pmod(v * v + salt, F.lit(PRIME))
        v = F.pmod(v * v + 1, F.lit(PRIME))
        return F.pmod(F.floor(v / F.lit(4096)), F.lit(2))

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.element_at(keys, r) - at, n)
        return F.when(bit(F.greatest(at, other), F.element_at(salts, r)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def slots(sources: DataFrame, most: int = MOST, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(source_no, shard, slot, pass, block): the block that each slot of the mix takes."""
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    passes = sources.where("n_blocks > 0").select("source_no", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))).alias("pass"))
    keyed = passes.withColumn("keys", F.transform(rounds, lambda r: F.pmod(hashed(seed, "key", F.col("source_no"), F.col("pass"), r), F.col("n_blocks"))))
    keyed = keyed.withColumn("salts", F.transform(rounds, lambda r: F.pmod(hashed(seed, "salt", F.col("source_no"), F.col("pass"), r), F.lit(PRIME)))).drop("n_blocks")
    each = shard_counts(sources, n_shards(sources, shard), seed).join(sources.select("source_no", "n_blocks"), "source_no")
    each = each.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_no", "shard")  # few rows, but each makes many
    each = each.select("source_no", "n_blocks", "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
    each = each.where(F.col("slot") < most * F.col("n_blocks")).withColumn("pass", F.floor(F.col("slot") / F.col("n_blocks")).cast("long"))
    each = each.join(keyed, ["source_no", "pass"]).withColumn("at", F.pmod("slot", "n_blocks"))
    return each.select("source_no", "shard", "slot", "pass", permuted(F.col("at"), F.col("n_blocks"), F.col("keys"), F.col("salts")).alias("block"))


def offsets(sized: DataFrame, key: str, n_buckets: int, seed: int = SEED, then: Sequence[str] = ()) -> DataFrame:
    """Adds start: words of the source before a row, in the order of hashed buckets and, within one, of key, size and the columns in `then`."""
    held = sized.withColumn("bucket", F.pmod(hashed(seed, "order", F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(n_buckets)))
    inner = Window.partitionBy("source_no", "bucket").orderBy(F.col(key).asc_nulls_last(), "size", *then).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    per = sized.withColumn("bucket", F.pmod(hashed(seed, "order", F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(n_buckets))).groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    base = F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("source_no", "bucket", F.coalesce(base, F.lit(0)).alias("base"))
    return held.join(per, ["source_no", "bucket"]).withColumn("start", (F.col("base") + F.col("within")).cast("long")).drop("bucket", "within", "base")


def buckets_for(rows: int) -> int:
    """A power of two near the square root, so that both levels of the prefix sums stay short."""
    return 1 << max(4, (rows.bit_length() + 1) // 2)


def taken_spans(sized: DataFrame, sources: DataFrame, key: str, rows: int, block: int, most: int, shard: int, seed: int, then: Sequence[str] = ()) -> DataFrame:
    """Rows of documents with words, one for each block of theirs and pass that takes it: key, source_no, start, size, block, pass, lo, n (words from lo in the document)."""
    placed = offsets(sized.where("size > 0"), key, buckets_for(rows), seed, then)
    span = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    lo = F.greatest(F.col("block") * block, F.col("start"))
    hi = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    span = span.withColumn("lo", lo - F.col("start")).withColumn("n", hi - lo)
    return span.join(slots(sources, most, shard, seed).select("source_no", "block", "pass"), ["source_no", "block"])


def sized_rows(docs: DataFrame, key: str, text: str, source: str, extra: Sequence[Column] = ()) -> tuple[DataFrame, int]:
    """Sizes as a table in the shared folder: the texts are read once."""
    sized = written(with_sizes(docs.select(F.col(key).alias("__id"), F.col(source).alias("source"), F.col(text).alias("__t"), *extra), "__t").drop("__t"), "sizes")
    return sized, sized.count()


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, block: int = BLOCK, most: int = MOST, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(key, size, source_size, target, taken): a row for each input row.

    A null text has size 0; a null source is a source of its own, the last; documents of size 0 take nothing; a null key is
    a key like others, ordered last; repeated rows are mixed each for itself; an empty table gives no rows. Other columns are ignored.
    """
    sized, rows = sized_rows(docs, key, text, source)
    sources = written(targets(sized, weights, most, block), "targets")
    named = sized.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    spans = taken_spans(named.select("__id", "source_no", "size"), sources, "__id", rows, block, most, shard, seed)
    took = spans.groupBy("source_no", "start").agg(F.sum("n").alias("taken"))
    placed = offsets(named.where("size > 0"), "__id", buckets_for(rows), seed).join(took, ["source_no", "start"], "left")
    out = placed.select("__id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = named.where("size = 0").select("__id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return out.unionByName(none).withColumnRenamed("__id", key)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: str = "n_chars", weights: Sequence[int] = WEIGHTS, block: int = BLOCK, most: int = MOST, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row for each document and pass with words taken in it, with the columns of docs.

    The text is whole where all its words are taken, and else the taken words with the white space behind each; the length
    column, if there is one, follows it. Rows that are equal are mixed each for itself; texts without words take no part.
    """
    docs = docs.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    repeats = written(docs.groupBy(key, "__row").count().where("count > 1").select(F.col(key).alias("__key"), F.col("__row").alias("__again"), "count"), "repeated")
    same = F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__row") == F.col("__again"))
    docs = docs.join(repeats, same, "left_anti").withColumn("__copies", F.lit(1).cast("long")).unionByName(
        docs.join(repeats, same).drop("__key", "__again").withColumnRenamed("count", "__copies").dropDuplicates([key, "__row"]))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")
    sized, rows = sized_rows(docs, key, text, source, [F.col("__row"), copies])
    sources = written(targets(sized, weights, most, block), "targets")
    named = sized.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("__id", "__row", "__copy", "source_no", "size")
    spans = taken_spans(named, sources, "__id", rows, block, most, shard, seed, ("__row", "__copy"))
    took = spans.groupBy("__id", "__row", "__copy", "pass", "size").agg(F.sort_array(F.collect_list(F.struct("lo", "n"))).alias("__spans"), (F.sum("n") < F.col("size")).alias("__partly"))
    took = took.select("__id", F.col("__row").alias("__r"), "__spans", "__partly")
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD + SPACE), F.lit(0))
    held = docs.join(took, F.col(f"`{key}`").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__r"))).withColumn("__words", F.when(F.col("__partly"), words))
    part = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(F.col("__words"), (s["lo"] + 1).cast("int"), s["n"].cast("int")))), "")
    held = held.withColumn("__out", F.when(F.col("__partly"), part).otherwise(F.col(f"`{text}`")))
    columns = {c: F.col(f"`{c}`") for c in docs.columns if c not in ("__row", "__copies")} | {text: F.col("__out")}
    if length in columns:
        columns[length] = F.length("__out").cast(docs.schema[length].dataType)
    return held.select(*[e.alias(c) for c, e in columns.items()])


def oracle(block: int = BLOCK, most: int = MOST, shard: int = SHARD, seed: int = SEED, weights: Sequence[int] = WEIGHTS) -> str:
    """DuckDB SQL for mix() on documents."""
    h = lambda *p: "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(p) + ")), 1, 12) AS BIGINT)"
    other = "((((k.keys[r] - x) % e.n_blocks) + e.n_blocks) % e.n_blocks)"
    y = f"greatest(x, {other})"
    v1 = f"(({y} % {PRIME}) * k.salts[r] + ({y} // {PRIME}) + 1) % {PRIME}"
    v2 = f"(({v1}) * ({v1}) + k.salts[r]) % {PRIME}"
    v3 = f"(({v2}) * ({v2}) + 1) % {PRIME}"
    step = f"CASE WHEN (({v3}) // 4096) % 2 = 1 THEN {other} ELSE x END"
    cycle = ", ".join(map(str, weights))
    return f"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
n AS (SELECT count(*) AS rows, CAST(pow(2, greatest(4, (length(ltrim(bin(count(*)), '0')) + 1) // 2)) AS BIGINT) AS buckets FROM sized),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_no FROM sized GROUP BY source),
wt AS (SELECT *, CAST(list_extract([{cycle}], CAST((source_no - 1) % {len(weights)} AS INT) + 1) AS BIGINT) AS weight FROM per),
lv AS (SELECT *, row_number() OVER up AS turn,
  (CAST(sum(source_size) OVER () AS DOUBLE) - {most} * coalesce(sum(source_size) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM wt WINDOW up AS (ORDER BY source_size / weight, source_no)),
hd AS (SELECT *, CAST({most} * source_size AS DOUBLE) / weight < level AS held FROM lv),
src AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target * n_blocks / source_size + 0.5) AS BIGINT) ELSE 0 END AS slots FROM (
  SELECT source, source_no, source_size, CASE WHEN held THEN CAST({most} * source_size AS DOUBLE) ELSE least((SELECT arg_min(level, turn) FROM hd WHERE NOT held) * weight, CAST({most} * source_size AS DOUBLE)) END AS target,
  (source_size + {block - 1}) // {block} AS n_blocks FROM hd)),
tot AS (SELECT *, CAST(ceil(total / long) AS BIGINT) AS shards FROM (SELECT CAST(sum(slots) AS BIGINT) AS total, CAST(greatest({shard}, ceil(sqrt(sum(slots)))) AS BIGINT) AS long FROM src) WHERE total > 0),
cn AS (SELECT source_no, shard, count(*) AS n FROM (SELECT source_no, {h("'" + str(seed) + "'", "'draw'", 'source_no', 'j')} % shards AS shard FROM (SELECT source_no, unnest(range(slots)) AS j FROM src), tot) GROUP BY 1, 2),
sl AS (SELECT source_no, n_blocks, unnest(range(first, first + n)) AS slot FROM (SELECT cn.*, n_blocks, CAST(coalesce(sum(n) OVER (PARTITION BY source_no ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM cn JOIN src USING (source_no)) WHERE n > 0),
k AS (SELECT source_no, pass, [{h("'" + str(seed) + "'", "'key'", 'source_no', 'pass', 'r')} % n_blocks for r in range(1, {ROUNDS + 1})] AS keys,
  [{h("'" + str(seed) + "'", "'salt'", 'source_no', 'pass', 'r')} % {PRIME} for r in range(1, {ROUNDS + 1})] AS salts
  FROM src, (SELECT unnest(range({most})) AS pass) WHERE n_blocks > 0),
e AS (SELECT source_no, n_blocks, slot // n_blocks AS pass, slot % n_blocks AS at FROM sl WHERE slot < {most} * n_blocks),
took AS (SELECT e.source_no, list_reduce(list_prepend(e.at, range(1, {ROUNDS + 1})), lambda x, r: {step}) AS block, count(*) AS times FROM e JOIN k ON e.source_no = k.source_no AND e.pass = k.pass GROUP BY 1, 2),
pl AS (SELECT doc_id, source_no, source_size, target, size, CAST(coalesce(sum(size) OVER (PARTITION BY source_no ORDER BY {h("'" + str(seed) + "'", "'order'", "coalesce(CAST(doc_id AS VARCHAR), '')")} % buckets, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized JOIN src ON sized.source IS NOT DISTINCT FROM src.source, n WHERE size > 0),
sp AS (SELECT source_no, start, size, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS block FROM pl),
tk AS (SELECT sp.source_no, start, sum((least((sp.block + 1) * {block}, start + size) - greatest(sp.block * {block}, start)) * times) AS taken FROM sp JOIN took ON sp.source_no = took.source_no AND sp.block = took.block GROUP BY 1, 2)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM pl LEFT JOIN tk ON pl.source_no = tk.source_no AND pl.start = tk.start
UNION ALL SELECT doc_id, size, source_size, target, CAST(0 AS BIGINT) FROM sized JOIN src ON sized.source IS NOT DISTINCT FROM src.source WHERE size = 0
"""
