"""What arriving postings are: new, or repetitions of postings that are held or came before them in the same batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import identity
from millrace.operators.dedup import DAYS, proofs, sure_keys, with_identity
from millrace.tables import dealt, kept

#: Kinds of repetitions in the order in which they are looked for.
KINDS = ("source_observation", "stable_identity", "enriched_stable_identity", "concurrent_identity")
FINAL = ("title", "company", "description", "url")
HELD = -(1 << 62)
#: Postings' keys are brought together in slices of about so many versions of postings, so that only a slice is shuffled at a time; MOST at most, as each reads all keys.
SLICE, MOST = 4_000_000, 8
ROUNDS = 20
ENTRIES = "array<struct<key:binary,stage:int,offered:boolean>>"


def keyed(p: DataFrame) -> DataFrame:
    """p with keys: asked, what a posting looks up, and found, what it is found by; own, its identity, is null where it has none. p's parts should be many, as the normal forms are worked out in Python."""
    some = with_identity(p.withColumn("own", own_identity()))
    some = some.withColumn("sure", sure_keys(some)).fillna("", ["company_key", "title_key"]).fillna("unknown", ["place"])
    return some.withColumns({name: F.transform(proofs(some, name == "asked"), lambda x: F.unhex(x["key"])) for name in ("asked", "found")})


def own_identity() -> Column:
    return F.unhex(F.md5(F.concat(F.lit("identity|"), identity.posting_identity(F.col("url"), F.col("source"), F.col("source_id")))))


def entries() -> Column:
    """The keys of a version of a posting (asked, found, own, stages, the last null for none), each once: the stage at which it is looked up, 0 for none, and whether the posting is found by it, as it is by its final values alone."""
    final = F.array_contains("stages", 2)
    entry = lambda key, stage, offered: F.struct(key.alias("key"), stage.cast("int").alias("stage"), offered.alias("offered"))
    looked = F.transform(F.array_distinct("asked"), lambda k: entry(k, F.array_min("stages"), final & F.array_contains("found", k)))
    offered = F.transform(F.array_except("found", "asked"), lambda k: entry(k, F.lit(0), F.lit(True)))
    own = F.transform(F.array_compact(F.array("own")), lambda k: entry(k, F.lit(3), F.lit(True)))
    return F.when(final, F.concat(looked, offered, own)).when(F.col("stages").isNotNull(), looked).cast(ENTRIES)


def observed(arriving: DataFrame, seen: DataFrame) -> DataFrame:
    """arriving with again: whether its source and id were observed before or came earlier in the batch. Texts move once; rows without both are dealt apart, as nothing repeats them."""
    none = F.col("source").isNull() | F.col("source_id").isNull()
    rows = arriving.withColumns({"arrives": F.lit(True), "apart": F.when(none, F.xxhash64("turn"))})
    before = seen.select("source", "source_id").dropna().withColumn("arrives", F.lit(False))
    group = Window.partitionBy("source", "source_id", "apart")
    met = dealt(rows.unionByName(before, allowMissingColumns=True), "source", "source_id", "apart")
    met = met.withColumns({"first": F.min("turn").over(group), "before": F.coalesce(F.max(~F.col("arrives")).over(group), F.lit(False))}).where("arrives")
    sourced = F.col("source").isNotNull() & F.coalesce(F.trim("source_id") != "", F.lit(False))
    return met.withColumn("again", (sourced & (F.col("turn") > F.col("first"))) | F.col("before")).drop("arrives", "apart", "first", "before")


def resolve(arriving: DataFrame, held: DataFrame, seen: DataFrame, now: Column, days: int = DAYS) -> DataFrame:
    """(id, kind, match): for every arriving posting `new` or a kind of KINDS, with the posting that it repeats (none for an observation of the source).

    arriving: id, turn (the order of arrival, unique), title, company, location, description, url, source, source_id, and final_title, final_company,
    final_description, final_url as they are after enrichment. held: the postings that are there, with created_at. seen: (source, source_id) observed before.
    A posting whose source and id were observed, before or earlier in the batch, is a `source_observation`. One that a posting of the last `days` or an
    earlier new one of the batch proves the same is a `stable_identity`, by its values at arrival, or an `enriched_stable_identity`, by its final
    ones; one whose identity is taken by any posting is a `concurrent_identity`. Repetitions found are no postings: later ones aren't held against them.

    Who is new is worked out in rounds. For a key only the first posting that isn't a repetition matters: if it is known to be new, all later ones
    with the key repeat something; a posting whose keys nobody has before it is new. So no two postings with a common key are paired, and there
    are as many rounds as the longest chain of postings that each depend on the one before. Keys are 16 bytes, and those that no two postings
    meet by are left out before the rounds.
    """
    # Values at arrival and final ones, once where they are the same; none for what was observed.
    said = lambda prefix, *stages: F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in FINAL], F.array(*map(F.lit, stages)).alias("stages"))
    unchanged = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"final_{c}")) for c in FINAL])
    values = F.when(unchanged, F.array(said("", 1, 2))).otherwise(F.array(said("", 1), said("final_", 2)))
    rows = observed(arriving.select("id", F.col("turn").cast("long").alias("turn"), "location", "source", "source_id", values.alias("values")), seen)
    versions = rows.select("id", "turn", "again", "location", "source", "source_id", F.explode_outer(F.when(~F.col("again"), F.col("values"))).alias("v"))
    forms = keyed(versions.select("id", "turn", "again", "location", "source", "source_id", "v.*"))
    forms = kept(forms.select("id", "turn", "again", F.coalesce(F.array_contains("stages", 2), F.lit(True)).alias("final"), entries().alias("entries")), "keys")
    every = forms.select("id", "turn", F.inline("entries"))

    recent = held.where(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))
    owned = dealt(held).select("id", F.array_compact(F.array(own_identity())).alias("found"))
    there = kept(keyed(dealt(recent)).select("id", "found").unionByName(owned).select(F.explode("found").alias("key"), F.col("id").alias("held")), "there")
    n = max(1, min(MOST, -(-forms.count() // SLICE)))
    part = lambda df, i: df.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i) if n > 1 else df
    # A key proves something if a held posting has it, of which the least id stands for all, or if a posting looks it up that comes after one found by it.
    turns = every.select("key", F.when(F.col("offered"), F.col("turn")).alias("first"), F.when(F.col("stage") > 0, F.col("turn")).alias("last")).unionByName(there, allowMissingColumns=True)
    of_key = [part(turns, i).groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("held").alias("held")) for i in range(n)]
    met = [kept(k.where("last IS NOT NULL AND (held IS NOT NULL OR first < last)"), "met") for k in of_key]
    asked = [part(every.where("stage > 0"), i).join(met[i], "key").where("held IS NOT NULL OR first < turn") for i in range(n)]
    asked = reduce(DataFrame.unionByName, [kept(a.select("key", "id", "turn", "stage", "held"), "asked") for a in asked])
    # Postings that look up no such key are new, and not in state; those that look up a held one's are repetitions.
    state = kept(asked.groupBy("id").agg(F.max(F.col("held").isNotNull()).alias("repeats")), "state")
    offered = [part(every.where("offered"), i).join(met[i].where("held IS NULL"), "key").where(F.col("turn") < F.col("last")).select("key", "id", "turn") for i in range(n)]
    offered = [o.join(state, "id", "left").where(~F.coalesce("repeats", F.lit(False))).select("key", "id", "turn", F.col("repeats").isNull().alias("fresh")) for o in offered]
    offered = reduce(DataFrame.unionByName, [kept(o, "offered") for o in offered])

    # A round writes those that it decides, so that all rounds together write a posting once; after ROUNDS of them their tables are made one.
    decided = state.where("repeats").select("id", F.lit(False).alias("fresh"))
    waiting, rounds = state.where("NOT repeats").count(), 0
    while waiting:
        left = asked.where("held IS NULL").join(decided, "id", "left_anti")
        of_row = left.join(firsts(offered, decided), "key", "left").groupBy("id").agg(F.max(F.when(F.col("first") < F.col("turn"), F.col("sure"))).alias("sure"))
        found = kept(of_row.where("sure IS NULL OR sure").select("id", F.col("sure").isNull().alias("fresh")), "decided")
        decided, waiting, rounds = decided.unionByName(found), waiting - found.count(), rounds + 1
        decided = kept(decided, "known") if rounds % ROUNDS == 0 else decided
    proof = asked.join(firsts(offered, decided), "key", "left").where(F.col("held").isNotNull() | (F.col("first") < F.col("turn")))
    of_held = F.col("held").isNotNull()
    proof = proof.select("id", "stage", F.when(of_held, F.lit(HELD)).otherwise(F.col("first")).alias("first"), F.when(of_held, F.col("held")).otherwise(F.col("match")).alias("match"))
    proof = kept(proof.groupBy("id").agg(F.min(F.struct("stage", "first", "match")).alias("p")).select("id", "p.stage", "p.match"), "proof")
    judged = forms.where("final").select("id", "again").join(proof, "id", "left")
    repeated = F.element_at(F.array(*map(F.lit, KINDS)), F.col("stage") + 1)
    return judged.select("id", F.when(F.col("again"), KINDS[0]).when(F.col("stage").isNull(), "new").otherwise(repeated).alias("kind"), "match")


def firsts(offered: DataFrame, decided: DataFrame) -> DataFrame:
    """(key, first, match, sure): the first posting of each key that isn't known to repeat another, and whether it is known to be one of its own."""
    open_ = offered.where("NOT fresh").drop("fresh").join(decided, "id", "left").where(F.coalesce("fresh", F.lit(True)))
    left = offered.where("fresh").unionByName(open_.withColumn("fresh", F.coalesce("fresh", F.lit(False))))
    ahead = left.groupBy("key").agg(F.min(F.struct("turn", "id", F.col("fresh").alias("sure"))).alias("f"))
    return ahead.select("key", F.col("f.turn").alias("first"), F.col("f.id").alias("match"), F.col("f.sure").alias("sure"))
