"""Which postings are the same: by equal keys only, so that no block of postings is ever paired off."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import identity, text, urls
from millrace.operators.ranking import first_per_key
from millrace.tables import dealt

#: Decided and invisible statuses, places that are none.
DECIDED = ("applied", "passed", "cooldown", "interviewing")
INVISIBLE = ("archived", "dismissed", "expired")
NO_PLACE = r"(?i)^\s*(?:unknown location|unknown|n/a|-)?\s*$|(?:^|[;/|]|\sor\s)\s*\d+\s+locations?\s*(?:$|[;/|]|\sor\s)"
SYNDICATORS = r"(?i)\b(?:jobgether|talentify|lensa|jobright|ziprecruiter)\b"


def keep_first(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in order; rows without a key all stay."""
    held = df.withColumn("__key", key)
    return first_per_key(held.where("__key is not null"), ["__key"], order).drop("__key").unionByName(held.where("__key is null").drop("__key"))


def unreliable_location(c: Column) -> Column:
    return c.isNull() | c.rlike(NO_PLACE)


def suppression_plan(candidates: DataFrame, decided: DataFrame, arrival: Sequence[Column]) -> DataFrame:
    """(id, duplicate_of, reason): open candidates whose fingerprint a decided posting has.

    candidates (id, fingerprint, status); decided (id, fingerprint, status, company, title, location, pass_reason, and what arrival orders by).
    Of a fingerprint's decided postings one that was applied to counts before others, then the first to arrive. A posting without a place proves nothing.
    """
    again = F.coalesce(F.lower(F.trim("pass_reason")) == "already applied", F.lit(False))
    proof = decided.where(F.col("fingerprint").isNotNull() & (F.col("status").isin(*DECIDED) | again) & ~unreliable_location(F.col("location")))
    best = first_per_key(proof, ["fingerprint"], [(F.col("status") == "applied").desc(), *arrival])
    what = F.array_join(F.filter(F.array(F.trim("title"), F.trim("company")), lambda x: F.coalesce(x, F.lit("")) != ""), " at ")
    tail = F.array_join(F.filter(F.array(what, F.trim("location")), lambda x: F.coalesce(x, F.lit("")) != ""), " — ")
    decision = F.when(again, "applied").otherwise(F.col("status"))
    reason = F.concat(F.lit("Duplicate of a job already "), decision, F.when(tail != "", F.concat(F.lit(": "), tail)).otherwise(""))
    best = best.select("fingerprint", F.col("id").alias("duplicate_of"), reason.alias("reason"))
    still_open = candidates.where(F.col("fingerprint").isNotNull() & ~F.col("status").isin(*DECIDED, *INVISIBLE)).select("id", "fingerprint")
    return still_open.join(best, "fingerprint").where("id <> duplicate_of").select("id", "duplicate_of", "reason")


def with_identity(postings: DataFrame) -> DataFrame:
    """Adds the normal forms that duplicate rules compare. postings: id, title, company, location, description, url, source, source_id."""
    words = text.clean_words(F.col("description"))
    return postings.withColumns(
        {
            "company_key": F.regexp_replace(text.company(F.col("company")), " ", ""),
            "title_key": text.title(F.col("title")),
            "place": text.location(F.col("location")),
            "address": urls.normalize_url("url"),
            "requisition": urls.requisition_key("url"),
            "signature": identity.description_signature(words),
        }
    )


def sure_keys(p: DataFrame) -> Column:
    """Keys that prove two postings the same whatever their labels: source and id there, a posting's own address, a requisition."""
    own = F.when((F.trim("source_id") != "") & F.col("source").isNotNull(), F.concat(F.lit("source|"), F.col("source"), F.lit("|"), F.trim("source_id")))
    strong = F.col("requisition").isNotNull() | F.col("address").rlike(r"(?i)\b(?:jobs?|positions?|requisitions?|openings?)/[^/?]+")
    address = F.when(strong, F.concat(F.lit("url|"), F.col("address")))
    return F.array_compact(F.array(own, address, F.concat(F.lit("req|"), F.col("requisition"))))


def duplicate_links(postings: DataFrame, order: str = "arrived") -> DataFrame:
    """(id, duplicate_of, why): each posting with the earliest earlier one that it repeats, if any.

    Postings with a sure key in common are the same. Otherwise company, title (equal, or one a beginning of the other), place
    (equal, or one unknown) and a long description's words must agree; syndicators' copies need title and description only.
    Compared are classes of equal labels within a company and description, never single postings.
    """
    p = with_identity(postings).select("id", order, "company", "source", "source_id", "company_key", "title_key", "place", "address", "requisition", "signature")
    p = p.persist(StorageLevel.DISK_ONLY)  # the normal forms are worked out once and used by three rules
    first = Window.partitionBy("key").orderBy(order, "id")
    sure = p.select("id", order, F.explode(sure_keys(p)).alias("key")).withColumn("duplicate_of", F.first("id").over(first)).withColumn("at", F.first(order).over(first))
    sure = sure.where("id <> duplicate_of").select("id", "duplicate_of", "at", F.lit("identity").alias("why"))

    labels = ["company_key", "signature", "title_key", "place"]
    classes = p.where("signature is not null and company_key <> ''").groupBy(*labels).agg(F.min(F.struct(order, "id")).alias("first"))
    other = classes.select("company_key", "signature", F.col("title_key").alias("t"), F.col("place").alias("l"), F.col("first").alias("f"))
    begins = lambda a, b: a.startswith(F.concat(b, F.lit(" "))) & (b != "")
    same_title = (F.col("title_key") == F.col("t")) | begins(F.col("title_key"), F.col("t")) | begins(F.col("t"), F.col("title_key"))
    same_place = (F.col("place") == F.col("l")) | (F.col("place") == "unknown") | (F.col("l") == "unknown")
    best = classes.join(other, ["company_key", "signature"]).where(same_title & same_place).groupBy(*labels).agg(F.min("f").alias("best"))
    text_links = p.join(best, labels).where(F.col("best.id") != F.col("id")).select("id", F.col("best.id").alias("duplicate_of"), F.col(f"best.{order}").alias("at"), F.lit("description").alias("why"))

    by_title = p.where("signature is not null and title_key <> ''").withColumn("syndicated", F.coalesce(F.col("company").rlike(SYNDICATORS), F.lit(False)))
    group = Window.partitionBy("title_key", "signature")
    spread = by_title.withColumn("some", F.max("syndicated").over(group)).withColumn("f", F.min(F.struct(order, "id")).over(group))
    copies = spread.where("some").where(F.col("f.id") != F.col("id")).select("id", F.col("f.id").alias("duplicate_of"), F.col(f"f.{order}").alias("at"), F.lit("syndication").alias("why"))
    found = reduce(DataFrame.unionByName, [sure, text_links, copies])
    return first_per_key(found, ["id"], [F.col("at"), F.col("duplicate_of"), F.col("why")]).drop("at")


def board_overlap(boards: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """New boards (slug, titles array<string>) that share at least two titles with known postings of the company (slug, titles)."""
    fresh = boards.join(known.select(F.col("slug").alias("s"), F.col("titles").alias("t")), F.col("slug") == F.col("s"))
    return fresh.where(F.size(F.array_intersect("titles", "t")) >= least).select("slug")


#: Fixed value: how old a held posting may be, in days.
DAYS = 45


def proof_key(kind: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", F.lit(kind), *parts))


def title_beginnings() -> Column:
    """The words of title_key from the first to each of them; the last entry is the title itself. An empty title begins with itself alone."""
    words = F.split("title_key", " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))


def proofs(p: DataFrame, asked: bool) -> Column:
    """array of (key, rank): what a posting is found by (asked: what it looks up). Two postings are proved the same if one looks up a key that the other is found by.

    Sure keys; company, a long description, title (whole or a beginning) and place (any for an unknown one); last, with a
    syndicator on either side, title and description alone.
    """
    entry = lambda key, rank: F.struct(key.alias("key"), F.lit(rank).alias("rank"))
    sure = F.transform("sure", lambda k: entry(proof_key("sure", k), 0))
    nowhere, begun = F.col("place") == "unknown", title_beginnings()
    places = F.when(nowhere, F.array(F.lit("*"))).otherwise(F.array(F.col("place"), F.lit("unknown"))) if asked else F.array_distinct(F.array(F.col("place"), F.lit("*")))
    title = F.array(F.col("title_key"))
    proper = F.slice(begun, 1, F.size(begun) - 1)
    wholes, parts = (begun, title) if asked else (title, proper)
    some = lambda kind, titles: F.flatten(F.transform(titles, lambda t: F.transform(places, lambda l: entry(proof_key(kind, F.col("company_key"), F.col("signature"), t, l), 1))))
    syndicated = F.coalesce(F.col("company").rlike(SYNDICATORS), F.lit(False))
    copy = lambda kind: entry(proof_key(kind, F.col("title_key"), F.col("signature")), 2)
    either, any_, theirs = syndicated, F.array(copy("any")), F.array(copy("syndicator"))
    copies = F.when(either, any_).otherwise(theirs) if asked else F.when(either, F.concat(any_, theirs)).otherwise(any_)
    none = F.array().cast("array<struct<key:string,rank:int>>")
    described = F.when(F.col("signature").isNotNull(), F.concat(some("whole", wholes), some("part", parts), F.when(F.col("title_key") != "", copies).otherwise(none))).otherwise(none)
    return F.concat(sure, described)


def matches_held(incoming: DataFrame, held: DataFrame, now: Column, days: int = DAYS) -> DataFrame:
    """(id, match, why): the newest held posting of the last days that each incoming one repeats, if any.

    Both: id, title, company, location, description, url, source, source_id; held also created_at. The same source and id, own address or
    requisition prove identity, else company, title, place and a long description's words must agree; a syndicator's copy, which
    counts only if nothing else is found, needs title and description alone. Postings meet by what proves them the same, and of
    the held ones that share a key only the newest is kept: no block of postings is compared or cut off. Null places count
    as unknown, null titles and companies as empty, held postings without a time as too old.
    """
    new, old = with_identity(dealt(incoming)), with_identity(dealt(held.where(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))))
    keys = ["company_key", "title_key"]
    new, old = (df.withColumn("sure", sure_keys(df)).fillna("", keys).fillna("unknown", ["place"]) for df in (new, old))
    age = (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age")
    found = old.select(age, F.col("id").alias("match"), F.explode(proofs(old, False)).alias("p"))
    newest = found.groupBy(F.col("p.key").alias("key")).agg(F.min(F.struct("age", "match")).alias("held"))
    asked = new.select("id", F.explode(proofs(new, True)).alias("p")).select("id", "p.key", "p.rank").distinct()
    met = asked.join(newest, "key").select("id", "rank", "held.age", "held.match")
    # Identity and description count alike, the newest first; identity names the reason where both prove the same posting.
    best = met.groupBy("id").agg(F.min(F.struct((F.col("rank") == 2).alias("late"), "age", "match", "rank")).alias("b"))
    why = F.element_at(F.array(F.lit("identity"), F.lit("description"), F.lit("syndication")), F.col("b.rank") + 1)
    return best.select("id", F.col("b.match").alias("match"), why.alias("why"))
