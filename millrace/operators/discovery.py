"""Boards that belong to companies known from other feeds, failure series, and which scores to replay or recover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Company names that say nothing, shared titles that prove a board, failures that repeat for the same input.
JUNK_NAMES = ("name", "unknown company", "unknown", "n/a", "-")
TITLES_NEEDED = 2
SERIES_MOST = 3


def plain_name(c: Column) -> Column:
    """A name's lower-case ASCII letters and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def plain_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def is_junk(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).isin("", *JUNK_NAMES), F.lit(True))


def board_candidates(postings: DataFrame, url: str = "url", company: str = "company", title: str = "title") -> DataFrame:
    """(slug, company, titles): what postings say of each company slug in their addresses; a real name is taken before a junk one."""
    slug = F.lower(F.nullif(F.regexp_extract(url, r"/companies/([^/?#]+)", 1), F.lit("")))
    rows = postings.select(slug.alias("slug"), F.col(company).alias("company"), F.nullif(plain_title(F.col(title)), F.lit("")).alias("t")).where("slug is not null")
    return rows.groupBy("slug").agg(F.min(F.when(~is_junk(F.col("company")), F.col("company"))).alias("company"), F.collect_set("t").alias("titles"))


def verified_boards(candidates: DataFrame, boards: DataFrame, known: DataFrame) -> DataFrame:
    """(platform, slug, board_name, title_matches, evidence, verified): new boards of the candidates' slugs.

    boards (platform, slug, board_name, titles array, text); known (platform, slug) are left out. A board is verified by its name, by two
    shared titles, or by one and the company's name in its postings.
    """
    b = boards.select("platform", F.lower("slug").alias("slug"), "board_name", "text", F.array_distinct(F.transform("titles", plain_title)).alias("theirs"))
    rows = b.join(known.select("platform", F.lower("slug").alias("slug")), ["platform", "slug"], "left_anti").join(candidates, "slug")
    shared = F.size(F.array_intersect("theirs", F.col("titles"))).alias("title_matches")
    slug_name = plain_name(F.col("slug"))
    subject = F.coalesce(F.nullif(plain_name(F.col("company")), F.lit("")), slug_name)
    own = plain_name(F.coalesce("board_name", F.lit("")))
    agrees = lambda x: (own != "") & (x != "") & (own.startswith(x) | x.startswith(own))
    named = (F.length(subject) >= 4) & F.contains(plain_name(F.coalesce("text", F.lit(""))), subject)
    rows = rows.select("platform", "slug", "board_name", shared, agrees(subject).alias("n1"), agrees(slug_name).alias("n2"), named.alias("said"))
    evidence = (
        F.when(F.col("n1") | F.col("n2"), F.concat(F.lit('name "'), F.col("board_name"), F.lit('"')))
        .when(F.col("title_matches") >= TITLES_NEEDED, F.concat(F.col("title_matches").cast("string"), F.lit(" titles")))
        .when((F.col("title_matches") == 1) & F.col("said"), F.lit("1 title + company named in postings"))
    )
    return rows.select("platform", "slug", "board_name", "title_matches", evidence.alias("evidence"), evidence.isNotNull().alias("verified"))


def failure_series(receipts: DataFrame) -> DataFrame:
    """Adds series_ordinal and suppressed to failures (job_id, series_key, at, id, input_bound, forced).

    A failure suppresses further tries if it is bound to its input, if that is asked for, or as the third of its series.
    """
    w = Window.partitionBy("job_id", "series_key").orderBy("at", "id")
    out = receipts.withColumn("series_ordinal", F.row_number().over(w))
    return out.withColumn("suppressed", F.coalesce("input_bound", F.lit(False)) | F.coalesce("forced", F.lit(False)) | (F.col("series_ordinal") >= SERIES_MOST))


def to_replay(jobs: DataFrame, events: DataFrame, version: str) -> DataFrame:
    """Jobs whose newest score isn't a valid one of this version. A stale newest score hides older ones.

    jobs (id, staged, pass_reason); events (id, job_id, created_at, stale_at, version). Staged jobs and those that a person promoted stay.
    """
    w = Window.partitionBy("job_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    newest = events.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    good = newest.where(F.col("stale_at").isNull() & (F.col("version") == version)).select(F.col("job_id").alias("id"))
    promoted = F.coalesce(F.col("pass_reason").rlike("(?i)promoted by user"), F.lit(False))
    return jobs.where(~F.coalesce("staged", F.lit(False)) & ~promoted).join(good, "id", "left_anti")


def to_recover(jobs: DataFrame, events: DataFrame, version: str, since: Column, subject: str, limit: int) -> DataFrame:
    """The `limit` best dismissed jobs (a top-k report) that failed under another version since then and are of the subject or near misses.

    jobs (id, title, aim, req, passes); events as in to_replay, with passed.
    """
    w = Window.partitionBy("job_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    newest = events.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    failed = newest.where(F.col("stale_at").isNull() & ~F.col("passed") & (F.col("version") != version) & (F.col("created_at") >= since)).select(F.col("job_id").alias("id"))
    of = F.coalesce(F.col("title").rlike(f"(?i){subject}"), F.lit(False))
    aim, req = F.coalesce("aim", F.lit(0)), F.coalesce("req", F.lit(0))
    chosen = jobs.where(F.col("passes") & (of | (aim >= 65) | (req >= 70))).join(failed, "id", "left_semi")
    return chosen.orderBy(of.desc(), req.desc(), aim.desc(), "id").limit(limit)
