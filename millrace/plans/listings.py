"""Feeds' records made from the given tables, in each feed's own form, brought into the common one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import identity, text, urls
from millrace.operators import control, dedup
from millrace.plans.postings import nth, nth_sql
from millrace.plans.registry import query
from millrace.sources import feeds, files, listings  # noqa: F401  listings adds its feeds
from millrace.tables import table

def clock() -> Column:
    return F.lit(dt.datetime(2026, 1, 1))


def json_of(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def named(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")


PLACES = ["Remote", "Berlin", "New York, US", None, "Worldwide"]


@query(f"""WITH p AS (SELECT p_partkey, p_name, p_brand, {nth_sql(PLACES, 'p_partkey')} AS place FROM part)
SELECT 'Remotive' AS source, CAST(p_partkey AS VARCHAR) AS source_id, p_name AS title, p_brand AS company, coalesce(place, 'Remote / Location unspecified') AS location, 'https://r.example/' || p_partkey AS url FROM p WHERE place IS NULL OR place <> 'Berlin'
UNION ALL SELECT 'TheMuse', CAST(p_partkey AS VARCHAR), p_name, p_brand, place, CAST(p_partkey AS VARCHAR) FROM p WHERE place IN ('Remote', 'New York, US')
UNION ALL SELECT 'Adzuna', 'u' || p_partkey, 'Unknown Title', 'Unknown Company', coalesce(place, 'Unknown Location'), 'u' || p_partkey FROM p
UNION ALL SELECT 'LinkedIn', CAST(p_partkey AS VARCHAR), p_name, p_brand, coalesce(place, 'Unknown Location'), '' FROM p
UNION ALL SELECT 'Dice', CAST(p_partkey AS VARCHAR), p_name, p_brand, coalesce(place, 'Unknown Location'), 'd' || p_partkey FROM p WHERE p_partkey % 2 = 0""")
def listing_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five feeds that are plain lists: field paths, wanted places, defaults."""
    p = parts(spark, sf_dir).withColumn("place", nth(PLACES, F.col("p_partkey")))
    n, place, title, company = (F.col(c) for c in ("p_partkey", "place", "p_name", "p_brand"))
    made = {
        "remotive": json_of(id=n, title=title, company_name=company, candidate_required_location=place, url=F.concat(F.lit("https://r.example/"), n)),
        "themuse": json_of(id=n, name=title, company=named(name=company), locations=F.array(named(name=place))),
        "adzuna": json_of(redirect_url=F.concat(F.lit("u"), n), location=named(display_name=place)),
        "linkedin": json_of(linkedin_id=n, title=title, organization=company, locations_derived=F.array(place)),
        "dice": json_of(job_id=n, title=title, company=company, location=place, details_page_url=F.when(n % 2 == 0, F.concat(F.lit("d"), n))),
    }
    out = [feeds.normalised(p.select(r.alias("value")), feed, clock()) for feed, r in made.items()]
    whole = out[0]
    for other in out[1:]:
        whole = whole.unionByName(other)
    return whole.select("source", "source_id", "title", "company", "location", "url")


@query("""SELECT 'WeWorkRemotely' AS source, 'g' || p_partkey AS source_id, p_name AS title, p_brand AS company FROM part
UNION ALL SELECT 'Himalayas', 'h' || p_partkey, p_name, p_brand FROM part UNION ALL SELECT 'RemoteOK', CAST(p_partkey AS VARCHAR), p_name, p_brand FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT 'Jobicy', CAST(p_partkey AS VARCHAR), p_name, p_brand FROM part UNION ALL SELECT 'JSearch', CAST(p_partkey AS VARCHAR), p_name, p_brand FROM part UNION ALL SELECT 'CareerOneStop', CAST(p_partkey AS VARCHAR), p_name, p_brand FROM part
UNION ALL SELECT 'Glassdoor (RapidAPI)', CAST(p_partkey AS VARCHAR), p_name, p_brand FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'USAJOBS', CAST(p_partkey AS VARCHAR), p_name, p_brand FROM part
UNION ALL SELECT 'SerpApi', CAST(p_partkey AS VARCHAR), p_name, p_brand FROM part""")
def shaped_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine feeds whose records have forms of their own; legal notices and postings without a company are left out."""
    p = parts(spark, sf_dir)
    n, title, company = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    made = {
        "weworkremotely": json_of(title=F.concat(company, F.lit(": "), title), guid=F.concat(F.lit("g"), n)),
        "himalayas": json_of(guid=F.concat(F.lit("h"), n), title=title, companyName=company, pubDate=F.lit(1_700_000_000)),
        "remoteok": json_of(id=n, position=title, company=company, legal=F.when(n % 4 == 0, "notice")),
        "jobicy": json_of(id=n, jobTitle=title, companyName=company),
        "jsearch": json_of(job_uid=n, job_title=title, employer_name=company, job_city=F.lit("Edina")),
        "careeronestop": json_of(JvId=n, JobTitle=title, Company=company),
        "glassdoor": json_of(jobview=named(job=named(jobTitleText=title, listingId=n), header=named(employer=named(name=F.when(n % 3 != 0, company)), ageInDays=F.lit(2)))),
        "usajobs": json_of(MatchedObjectDescriptor=named(PositionID=n, PositionTitle=title, OrganizationName=company)),
        "serpapi": json_of(job_id=n, title=title, company_name=company, location=F.lit("MN")),
    }
    whole = None
    for feed, r in made.items():
        rows = feeds.normalised(p.select(r.alias("value")), feed, clock()).select("source", "source_id", "title", "company")
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


#: So many parts' postings are listed in a page of their board.
PAGE = 20_000


@query("""SELECT 'ATS-lever' AS source, 'p' || p_partkey AS source_id, p_name AS title, 'Acme Corp' AS company, 'Edina, MN' AS location FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'ATS-greenhouse', CAST(p_partkey AS VARCHAR), p_name, 'Named Board', 'Edina, MN' FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT 'ATS-workday', '/job/' || p_partkey, p_name, 'acme', '2 Locations' FROM part WHERE p_partkey % 3 = 2""")
def board_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of three platforms, a payload for each brand and platform and run of PAGE parts, as boards list their postings in pages."""
    n, title = F.col("p_partkey"), F.col("p_name")
    p = parts(spark, sf_dir).withColumn("platform", nth(["lever", "greenhouse", "workday"], n))
    record = (
        F.when(F.col("platform") == "lever", json_of(id=F.concat(F.lit("p"), n), text=title, categories=named(location=F.lit("Edina, MN"))))
        .when(F.col("platform") == "greenhouse", json_of(id=n, title=title, location=named(name=F.lit("Edina, MN"))))
        .otherwise(json_of(externalPath=F.concat(F.lit("/job/"), n), title=title, locationsText=F.lit("2 Locations")))
    )
    held = p.groupBy("platform", "p_brand", F.floor(n / PAGE)).agg(F.array_join(F.collect_list(record), ",").alias("items"))
    listed = F.concat(F.lit("["), F.col("items"), F.lit("]"))
    body = F.when(F.col("platform") == "lever", listed).when(F.col("platform") == "greenhouse", F.concat(F.lit('{"name":"Named Board","jobs":'), listed, F.lit("}"))).otherwise(F.concat(F.lit('{"jobPostings":'), listed, F.lit("}")))
    slug = F.when(F.col("platform") == "workday", "acme.wd1::site").otherwise("acme-corp")
    boards = held.select("platform", slug.alias("slug"), body.alias("body"))
    return feeds.normalised_boards(boards, clock()).select("source", "source_id", "title", "company", "location")


@query("""SELECT p_partkey % 50 AS id, count(*) AS n FROM part WHERE p_partkey % 50 >= 10 GROUP BY 1""")
def unseen_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings observed again are taken once and those seen before not at all; here with how often each came."""
    p = parts(spark, sf_dir).select(F.lit("feed").alias("source"), (F.col("p_partkey") % 50).cast("string").alias("source_id"))
    seen = spark.range(10).select(F.lit("feed").alias("source"), F.col("id").cast("string").alias("source_id"))
    fresh = feeds.new_only(p, seen)
    return p.join(fresh, ["source", "source_id"]).groupBy(F.col("source_id").cast("long").alias("id")).agg(F.count("*").alias("n"))


@query("""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages WHERE page_id % 3 = 0""")
def postings_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a posting put into them as JSON-LD, and what is read of it."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    posting = F.to_json(F.struct(F.when(F.col("page_id") % 3 == 0, "JobPosting").otherwise("Article").alias("@type"), title.alias("title")))
    marked = p.withColumn("html", F.concat("html", F.lit('<script type="application/ld+json">'), posting, F.lit("</script>")))
    return files.embedded_postings(marked).select("page_id", F.coalesce("title", F.lit("")).alias("title"))


@query("""SELECT lower(regexp_replace(replace(c_mktsegment, '&', ' and '), '[^A-Za-z0-9]+', ' ', 'g')) AS company, 'seller' AS title, 'v4:' || sha256(lower(c_mktsegment) || '|seller|edina mn') AS fingerprint, count(*) AS n FROM customer GROUP BY 1, 2, 3""")
def posting_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of postings whose company is written in five ways."""
    from millrace.functions import identity

    n = F.col("c_custkey")
    written = F.concat(F.col("c_mktsegment"), nth(["", ", Inc.", " LLC", " Corporation", ".wd3"], n))
    c = table(spark, sf_dir, "customer").select(written.alias("company"), nth(["Seller", "Seller - Remote", "seller (Hybrid)"], n).alias("title"))
    made = c.select(text.company(F.col("company")).alias("company"), text.title(F.col("title")).alias("title"), identity.fingerprint(F.col("title"), F.col("company"), F.lit("Edina, Minnesota")).alias("fingerprint"))
    return made.groupBy("company", "title", "fingerprint").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'parked' WHEN 1 THEN 'parked' ELSE 'blacklisted' END AS status, DATE '2026-01-01' + CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 30 END AS next_check FROM supplier""")
def parked_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", control.board_backoff(F.col("s_suppkey") % 3, F.lit(dt.date(2026, 1, 1))).alias("b"))
    return s.select("s_suppkey", "b.status", "b.next_check")


@query("""SELECT o_orderkey AS id, 1000000 + min(c_custkey) AS duplicate_of FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0) o JOIN (SELECT c_custkey, c_custkey % 20 AS k FROM customer WHERE c_custkey % 3 = 0) c ON o_custkey % 40 = c.k GROUP BY 1""")
def suppressed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open postings whose fingerprint a decided one has, with the first decided one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).cast("string").alias("fingerprint"), nth(["inbox", "applied"], F.col("o_orderkey")).alias("status"))
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    decided = c.select((n + 1_000_000).alias("id"), (n % 20).cast("string").alias("fingerprint"), F.when(n % 3 == 0, "passed").otherwise("inbox").alias("status"), F.lit("C").alias("company"), F.lit("T").alias("title"), F.lit("Edina, MN").alias("location"), F.lit(None).cast("string").alias("pass_reason"))
    return dedup.suppression_plan(o, decided, [F.col("id")]).select("id", "duplicate_of")


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '[/?#].*$', '') AS host FROM pages""")
def bare_page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(urls.host(F.col("url")), r"^www\.", "").alias("host"))


HOSTS = {"Jobs.Lever.CO": "Lever", "acme.wd5.MyWorkdayJobs.com": "Workday", "boards.greenhouse.io": "Greenhouse", "Example.ORG": "Unknown", "x.bamboohr.com": "BambooHR"}
#: Addresses made of parts: scheme, host, port, path, parameters and fragment; and the parts that are left of them.
PARTS_SQL = f"""p AS (SELECT event_id AS k, event_id % 2 = 0 AS s, {nth_sql(list(HOSTS), 'event_id // 7')} AS host, {nth_sql(list(HOSTS.values()), 'event_id // 7')} AS named, event_id % 3 AS port, CONCAT('/a/B', event_id % 10) AS path, event_id % 5 AS q FROM events)"""


@query(f"""WITH {PARTS_SQL} SELECT k, concat(CASE WHEN s THEN 'https://' ELSE 'http://' END, lower(host), CASE port WHEN 1 THEN ':8443' WHEN 2 THEN CASE WHEN s THEN ':80' ELSE '' END ELSE '' END, path, CASE q WHEN 1 THEN '?a=1&b=2' WHEN 2 THEN concat('?gh_jid=', k) WHEN 3 THEN '?a=+&b=' ELSE '' END) AS canonical,
'posting:v1:' || sha256(CASE q WHEN 2 THEN concat('requisition|', lower(host), '|', k) ELSE concat('source|my feed|', k) END) AS identity, CASE WHEN q <> 2 THEN named END AS platform FROM p""")
def canonical_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as addresses with letters, ports, closing slashes, trackers, parameters and fragments that don't matter: their plain forms, the postings that they name and whose platform they are on."""
    k = F.col("event_id")
    s = k % 2 == 0
    host, q = nth(list(HOSTS), F.floor(k / 7)), k % 5
    port = F.when(k % 3 == 0, F.when(s, ":443").otherwise(":80")).when(k % 3 == 1, ":8443").otherwise(F.when(s, ":80").otherwise(""))
    params = F.when(q == 1, "?utm_source=x&b=2&a=1").when(q == 2, F.concat(F.lit("?utm_medium=y&gh_jid="), k)).when(q == 3, "?b=&a=%20").when(q == 4, "?utm_campaign=z").otherwise("")
    url = F.concat(F.when(s, "HTTPS://").otherwise("http://"), host, port, F.lit("/a/B"), k % 10, F.when(k % 4 == 0, "/").otherwise(""), params, F.when(k % 11 < 5, "#top").otherwise(""))
    rows = table(spark, sf_dir, "events").select(k.alias("k"), url.alias("url"), q.alias("q"))
    identity_ = identity.posting_identity(F.col("url"), F.lit("My  Feed"), F.col("k").cast("string"))
    return rows.select("k", urls.normalize_url("url").alias("canonical"), identity_.alias("identity"), F.when(F.col("q") != 2, urls.platform(F.col("url"), F.lit("feed"), F.lit(None).cast("string"))).alias("platform"))
