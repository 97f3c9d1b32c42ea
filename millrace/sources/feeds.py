"""Feeds' records in one form: title, company, description, location, url, source, source_id, posted_at.

Each feed is a column expression over its record's JSON text, so a feed file is read with spark.read.text and mapped in
one projection. Records without a title or an id are dropped. The clock stands in for unreadable dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.facts import structured_base_pay
from millrace.functions.text import title_case
from millrace.functions.times import epoch_instant

FIELDS = ("title", "company", "description", "location", "url", "source", "source_id", "posted_at")


def at(record: Column, path: str) -> Column:
    """A trimmed text field; null where it is absent, blank or no scalar. A null in a list reads as `null`."""
    found = F.nullif(F.trim(F.get_json_object(record, f"$.{path}")), F.lit(""))
    return F.nullif(found, F.lit("null")) if "[" in path else found


def when_posted(text: Column, now: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), now.cast("timestamp"))


def row(now: Column, source: str | Column, title: Column, source_id: Column, company: Column, description: Column, location: Column, url: Column, posted: Column) -> Column:
    made = {"title": title, "company": F.coalesce(company, F.lit("Unknown Company")), "description": F.coalesce(description, F.lit("")), "location": F.coalesce(location, F.lit("Unknown Location")), "url": F.coalesce(url, F.lit("")), "source": F.lit(source) if isinstance(source, str) else source, "source_id": source_id, "posted_at": F.coalesce(posted, now.cast("timestamp"))}
    return F.when(title.isNotNull() & source_id.isNotNull(), F.struct(*[made[f].alias(f) for f in FIELDS]))


def himalayas(r: Column, now: Column) -> Column:
    places = F.from_json(F.get_json_object(r, "$.locationRestrictions"), "array<string>")
    names = F.filter(F.transform(places, lambda p: F.coalesce(at(p, "name"), at(p, "alpha2"), F.when(~p.startswith("{"), F.nullif(F.trim(p), F.lit(""))))), lambda p: p.isNotNull())
    joined = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("Remote / Worldwide")
    number = F.expr("try_cast(get_json_object(__r, '$.pubDate') as double)")
    return row(now, "Himalayas", at(r, "title"), at(r, "guid"), at(r, "companyName"), F.get_json_object(r, "$.description"), joined, at(r, "applicationLink"), epoch_instant(number))


def remote_ok(r: Column, now: Column) -> Column:
    place = F.nullif(F.trim(F.regexp_replace(F.coalesce(at(r, "location"), F.lit("")), r",\s*$", "")), F.lit(""))
    title = F.when(F.get_json_object(r, "$.legal").isNull(), at(r, "position"))
    return row(now, "RemoteOK", title, F.coalesce(at(r, "id"), at(r, "slug")), at(r, "company"), F.get_json_object(r, "$.description"), F.coalesce(place, F.lit("Remote")), F.coalesce(at(r, "url"), at(r, "apply_url")), when_posted(at(r, "date"), now))


def jobicy(r: Column, now: Column) -> Column:
    text = F.coalesce(F.get_json_object(r, "$.jobDescription"), F.get_json_object(r, "$.jobExcerpt"))
    return row(now, "Jobicy", at(r, "jobTitle"), at(r, "id"), at(r, "companyName"), text, F.coalesce(at(r, "jobGeo"), F.lit("Remote")), at(r, "url"), when_posted(at(r, "pubDate"), now))


def jsearch(r: Column, now: Column) -> Column:
    place = F.nullif(F.array_join(F.array_compact(F.array(at(r, "job_city"), at(r, "job_state"))), ", "), F.lit(""))
    return row(now, "JSearch", at(r, "job_title"), at(r, "job_uid"), at(r, "employer_name"), F.get_json_object(r, "$.job_description"), place, F.coalesce(at(r, "job_apply_link"), at(r, "job_google_link")), when_posted(at(r, "job_posted_at_datetime_utc"), now))


def careeronestop(r: Column, now: Column) -> Column:
    return row(now, "CareerOneStop", at(r, "JobTitle"), at(r, "JvId"), at(r, "Company"), F.get_json_object(r, "$.DescriptionSnippet"), at(r, "Location"), at(r, "URL"), when_posted(at(r, "AcquisitionDate"), now))


def glassdoor(r: Column, now: Column) -> Column:
    path = at(r, "jobview.header.jobViewUrl")
    url = F.when(path.startswith("/"), F.concat(F.lit("https://www.glassdoor.com"), path)).otherwise(path)
    title = F.coalesce(at(r, "jobview.job.jobTitleText"), at(r, "jobview.header.normalizedJobTitle"))
    company = F.coalesce(at(r, "jobview.header.employer.name"), at(r, "jobview.header.employerNameFromSearch"))
    days = F.expr("try_cast(get_json_object(__r, '$.jobview.header.ageInDays') as int)")
    posted = F.when(days >= 0, now.cast("timestamp") - F.make_dt_interval(days=days))
    ids = F.coalesce(at(r, "jobview.job.listingId"), at(r, "jobview.header.adOrderId"), url)
    return row(now, "Glassdoor (RapidAPI)", F.when(company.isNotNull(), title), ids, company, F.lit(None).cast("string"), at(r, "jobview.header.locationName"), url, posted)


def rss(source: str) -> Callable[[Column, Column], Column]:
    """Feeds whose titles read `company: title`."""

    def one(r: Column, now: Column) -> Column:
        whole = at(r, "title")
        split = F.instr(whole, ": ") > 0
        company = F.when(split, F.substring_index(whole, ": ", 1))
        title = F.when(split, F.trim(F.substring(whole, F.instr(whole, ": ") + 2, F.length(whole)))).otherwise(whole)
        return row(now, source, title, F.coalesce(at(r, "guid"), at(r, "link")), company, F.get_json_object(r, "$.description"), at(r, "region"), at(r, "link"), when_posted(at(r, "pubDate"), now))

    return one


#: Where boards of each platform keep their postings and how addresses are made.
BOARD_PATHS = {"lever": "$", "workday": "$.jobPostings", "smartrecruiters": "$.content", "workable": "$.results", "bamboohr": "$.result", "breezy": "$", "rippling": "$", "teamtailor": "$.items", "pinpoint": "$.data", "recruitee": "$.offers", "greenhouse": "$.jobs", "ashby": "$.jobs"}
BOARD_URLS = {"smartrecruiters": ("https://jobs.smartrecruiters.com/", "/", "id"), "workable": ("https://apply.workable.com/", "/j/", "shortcode"), "personio": ("https://", ".jobs.personio.de/job/", "id"), "bamboohr": ("https://", ".bamboohr.com/careers/", "id")}


def board_postings(boards: DataFrame) -> DataFrame:
    """(platform, slug, body) to a row for each posting in a board's payload: platform, slug, board_name, record."""
    path = F.lit(None).cast("string")
    for name, p in BOARD_PATHS.items():
        path = F.when(F.col("platform") == name, F.col("body") if p == "$" else F.get_json_object("body", p)).otherwise(path)
    items = F.from_json(path, "array<string>")
    # What is told of the whole payload is worked out before its postings are parted: beside explode() each posting would read the payload again.
    whole = F.coalesce(F.get_json_object("body", "$.company.name"), F.get_json_object("body", "$.name"))
    read = boards.select("platform", "slug", whole.alias("board_name"), items.alias("items"))
    return read.select("platform", "slug", "board_name", F.explode("items").alias("record"))


def board_row(r: Column, platform: Column, slug: Column, board_name: Column, now: Column) -> Column:
    """A board's posting in the common form; the platform decides names, addresses and ids."""
    city = lambda *more: F.nullif(F.array_join(F.array_compact(F.array(at(r, "location.city"), *[at(r, m) for m in more])), ", "), F.lit(""))
    text_place = F.when(~F.coalesce(at(r, "location"), F.lit("{")).startswith("{"), at(r, "location"))
    place = (
        F.when(platform == "lever", at(r, "categories.location"))
        .when(platform == "workday", at(r, "locationsText"))
        .when(platform.isin("smartrecruiters", "workable"), city("location.region"))
        .when(platform == "bamboohr", at(r, "location.city"))
        .when(platform == "breezy", city("location.country.name"))
        .when(platform == "pinpoint", F.coalesce(at(r, "location.name"), city("location.province")))
        .when(platform == "recruitee", F.coalesce(text_place, F.nullif(F.array_join(F.array_compact(F.array(at(r, "city"), at(r, "country"))), ", "), F.lit(""))))
        .when(platform == "rippling", at(r, "workLocation.label"))
        .otherwise(F.coalesce(at(r, "location.name"), text_place))
    )
    url = F.coalesce(at(r, "absolute_url"), at(r, "hostedUrl"), at(r, "jobUrl"), at(r, "careers_url"), at(r, "url"))
    for name, (head, mid, field) in BOARD_URLS.items():
        url = F.when(platform == name, F.concat(F.lit(head), slug, F.lit(mid), at(r, field))).otherwise(url)
    parts = F.split(slug, "::")
    url = F.when(platform == "workday", F.concat(F.lit("https://"), parts[0], F.lit(".myworkdayjobs.com/en-US/"), F.try_element_at(parts, F.lit(2)), at(r, "externalPath"))).otherwise(url)
    ids = F.when(platform == "workday", F.coalesce(at(r, "externalPath"), at(r, "id"))).when(platform == "rippling", F.coalesce(at(r, "uuid"), at(r, "id"))).otherwise(at(r, "id"))
    title = F.coalesce(at(r, "text"), at(r, "title"), at(r, "name"), at(r, "jobOpeningName"), F.lit("Unknown Title"))
    company = F.when(platform.isin("greenhouse", "smartrecruiters"), F.coalesce(board_name, slug)).when(platform.isin("workable", "bamboohr"), slug).when(platform == "workday", F.regexp_replace(parts[0], r"\.wd\d+$", "")).otherwise(title_case(slug))
    posted = F.coalesce(*[at(r, f) for f in ("updated_at", "createdAt", "publishedAt", "published_date", "date_published", "created_at")])
    return row(now, F.concat(F.lit("ATS-"), platform), title, ids, company, F.coalesce(at(r, "content"), at(r, "descriptionPlain"), at(r, "description"), at(r, "content_html")), place, url, when_posted(posted, now))


FEEDS: dict[str, Callable[[Column, Column], Column]] = {"himalayas": himalayas, "remoteok": remote_ok, "jobicy": jobicy, "jsearch": jsearch, "careeronestop": careeronestop, "glassdoor": glassdoor, "biospace": rss("BioSpace"), "weworkremotely": rss("WeWorkRemotely")}


def normalised(records: DataFrame, feed: str, now: Column, column: str = "value") -> DataFrame:
    """A feed's records (a JSON text each) as rows in the common form."""
    r = F.col("__r")
    return records.select(F.col(column).alias("__r")).select(FEEDS[feed](r, now).alias("p")).where("p is not null").select("p.*")


def normalised_boards(boards: DataFrame, now: Column) -> DataFrame:
    """All boards' payloads (platform, slug, body) as rows in the common form."""
    rows = board_postings(boards)
    made = board_row(F.col("record"), F.col("platform"), F.col("slug"), F.col("board_name"), now)
    return rows.select(made.alias("p")).where("p is not null").select("p.*")


def new_only(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings whose (source, source_id) hasn't been observed."""
    return postings.dropDuplicates(["source", "source_id"]).join(seen.select("source", "source_id"), ["source", "source_id"], "left_anti")


def board_detail(detail: Column) -> Column:
    """struct<description, company, location, compensation> of a board's posting in detail (JSON): a description in two parts or one, work locations, structured pay."""
    two = F.nullif(F.concat_ws("\n\n", at(detail, "description.company"), at(detail, "description.role")), F.lit(""))
    whole = F.get_json_object(detail, "$.description")
    sites = F.filter(F.from_json(F.get_json_object(detail, "$.workLocations"), "array<string>"), lambda s: F.coalesce(s != "", F.lit(False)))
    ranges = F.from_json(F.get_json_object(detail, "$.payRangeDetails"), "array<struct<currency:string,frequency:string,rangeStart:double,rangeEnd:double>>")
    pay = structured_base_pay(F.transform(ranges, lambda r: F.struct(r["currency"].alias("currency"), r["frequency"].alias("frequency"), r["rangeStart"].alias("range_start"), r["rangeEnd"].alias("range_end"))))
    return F.struct(F.coalesce(two, F.when(~whole.startswith("{"), whole), F.lit("")).alias("description"), at(detail, "companyName").alias("company"), F.nullif(F.array_join(sites, "; "), F.lit("")).alias("location"), pay.alias("compensation"))
