"""Feeds that are plain lists of records: each one a table of field paths, mapped to the common form in one projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import clean_html
from millrace.functions.times import epoch_instant
from millrace.sources.feeds import FEEDS, at, row, when_posted


@dataclass(frozen=True)
class Listing:
    """Paths in the order in which they are tried. place: a pattern that locations must have; subject: one that titles must have."""

    source: str
    title: Sequence[str]
    ids: Sequence[str]
    company: Sequence[str]
    description: Sequence[str]
    location: Sequence[str]
    url: Sequence[str]
    posted: Sequence[str] = ()
    untitled: str | None = None
    nowhere: str = "Unknown Location"
    place: str = ""
    subject: str = ""
    seconds: bool = False
    complete: bool = False


#: Fields of the feeds and the patterns of what is taken from them.
US = r"\b(us|usa|u\.s\.|united states"
LISTINGS = {
    "themuse": Listing("TheMuse", ["name"], ["id"], ["company.name"], ["contents"], ["locations[0].name"], ["refs.landing_page", "id"], ["publication_date"], place=US + r"|remote|flexible)\b|,\s*[A-Z]{2}\b"),
    "remotive": Listing("Remotive", ["title"], ["id"], ["company_name"], ["description"], ["candidate_required_location"], ["url", "id"], ["publication_date"], nowhere="Remote / Location unspecified", place=US + r"|worldwide|anywhere|remote)\b"),
    "arbeitnow": Listing("Arbeitnow", ["title"], ["slug", "url"], ["company_name"], ["description"], ["location"], ["url"], ["created_at"], place=US + r")\b", subject="sales|account executive|district manager|regional manager", seconds=True),
    "adzuna": Listing("Adzuna", ["title"], ["id", "redirect_url"], ["company.display_name"], ["description"], ["location.display_name"], ["redirect_url"], ["created"], untitled="Unknown Title"),
    "indeed": Listing("Indeed", ["title", "job_title"], ["id", "job_id", "guid", "url"], ["company_name"], ["description", "snippet"], ["location"], ["url", "job_url"], ["publication_date"], untitled="Unknown Title"),
    "linkedin": Listing("LinkedIn", ["title"], ["id", "job_id", "linkedin_id"], ["organization", "company.name", "company_name"], ["description_text", "description"], ["locations_derived[0]", "locations[0].address.addressLocality", "location"], ["url", "job_url"], ["date_posted", "posted_date"]),
    "dice": Listing("Dice", ["title"], ["job_id", "guid", "details_page_url"], ["company"], ["summary"], ["location"], ["details_page_url"], ["posted_date"], complete=True),
}
#: Headings of a federal posting and the fields under them.
SECTIONS = {"Job Summary": ("JobSummary",), "Major Duties": ("MajorDuties", "Duties"), "Qualifications": ("Qualifications",), "Requirements": ("Requirements",), "Education": ("Education",), "Evaluation": ("Evaluations",)}
#: Feeds that are switched off but still report a run.
DISABLED = ("Reddit", "HackerNews", "GitHub")


def first_of(r: Column, paths: Sequence[str]) -> Column:
    return F.coalesce(*[at(r, p) for p in paths], F.lit(None).cast("string"))


def mapped(x: Listing) -> Callable[[Column, Column], Column]:
    """The projection of a listing. Rows that miss a wanted place or subject, or where `complete` a company or address, are null."""

    def one(r: Column, now: Column) -> Column:
        title = F.coalesce(first_of(r, x.title), F.lit(x.untitled).cast("string"))
        place = F.coalesce(first_of(r, x.location), F.lit(x.nowhere))
        company, url, when = first_of(r, x.company), first_of(r, x.url), first_of(r, x.posted)
        posted = epoch_instant(when.try_cast("double")) if x.seconds else when_posted(when, now)
        wanted = F.lit(True)
        if x.place:
            wanted = wanted & place.rlike(f"(?i){x.place}")
        if x.subject:
            wanted = wanted & F.coalesce(title.rlike(f"(?i){x.subject}"), F.lit(False))
        if x.complete:
            wanted = wanted & company.isNotNull() & url.isNotNull()
        text = F.coalesce(*[F.nullif(F.get_json_object(r, f"$.{p}"), F.lit("")) for p in x.description], F.lit(""))
        return F.when(wanted, row(now, x.source, title, first_of(r, x.ids), company, text, place, url, posted))

    return one


def component(text: Column) -> Column:
    """A text as a component of an address: spaces as %20, and what addresses allow unescaped left as it is."""
    out = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def google_jobs(r: Column, now: Column) -> Column:
    """Search results of the last day: a result without an apply link gets the address of a search for it."""
    words = F.concat_ws(" ", *[F.coalesce(at(r, f), F.lit("undefined")) for f in ("title", "company_name", "location")], F.lit("jobs"))
    url = F.coalesce(at(r, "apply_options[0].link"), F.concat(F.lit("https://www.google.com/search?q="), component(words)))
    return row(now, "SerpApi", at(r, "title"), at(r, "job_id"), at(r, "company_name"), F.get_json_object(r, "$.description"), at(r, "location"), url, now.cast("timestamp"))


def plain_field(raw: Column) -> Column:
    """Text of a field that is a text, an object with Text, Value or Name, or a list of such, a line each."""

    def item(x: Column) -> Column:
        return F.when(F.ltrim(x).startswith("{"), F.coalesce(F.get_json_object(x, "$.Text"), F.get_json_object(x, "$.Value"), F.get_json_object(x, "$.Name"))).otherwise(x)

    items = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    kept = F.filter(F.transform(items, item), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    return F.array_join(F.transform(kept, F.trim), "\n")


def federal_text(r: Column) -> Column:
    """The sections of a federal posting that say something, each under its heading; markup is left for clean_html."""
    parts = []
    for heading, fields in SECTIONS.items():
        raw = F.coalesce(*[F.get_json_object(r, f"$.MatchedObjectDescriptor.UserArea.Details.{f}") for f in fields])
        text = plain_field(raw)
        parts.append(F.when(text != "", F.concat(F.lit(f"{heading}\n"), text)))
    return F.concat_ws("\n\n", *parts)


def federal(r: Column, now: Column) -> Column:
    d = "MatchedObjectDescriptor."
    names = F.filter(F.from_json(F.get_json_object(r, f"$.{d}PositionLocation[*].LocationName"), "array<string>"), lambda x: F.coalesce(x != "", F.lit(False)))
    single = at(r, f"{d}PositionLocation[0].LocationName")
    place = F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), single)
    title = F.coalesce(at(r, f"{d}PositionTitle"), F.lit("Unknown Title"))
    company = F.coalesce(first_of(r, [f"{d}OrganizationName", f"{d}DepartmentName"]), F.lit("U.S. Government"))
    return row(now, "USAJOBS", title, first_of(r, [f"{d}PositionID", f"{d}PositionURI"]), company, federal_text(r), place, at(r, f"{d}PositionURI"), when_posted(at(r, f"{d}PublicationStartDate"), now))


FEEDS |= {name: mapped(x) for name, x in LISTINGS.items()} | {"serpapi": google_jobs, "usajobs": federal}


def cleaned(postings: DataFrame) -> DataFrame:
    """Postings with their descriptions' markup removed, lines kept."""
    return postings.withColumn("description", clean_html("description"))


def fresh_dataset(records: DataFrame, finished: Column, now: Column, hours: int = 36) -> DataFrame:
    """A scraper's records, none if its last good run is unknown or too old: stale records would look like a healthy run."""
    return records.where(F.coalesce(finished >= now - F.make_dt_interval(hours=F.lit(hours)), F.lit(False)))


def disabled_runs(now: Column, days: DataFrame) -> DataFrame:
    """(source, status, seen, at): a run of nothing for every switched-off feed. days: any one-row table."""
    names = F.explode(F.array(*[F.lit(s) for s in DISABLED]))
    return days.limit(1).select(names.alias("source"), F.lit("disabled").alias("status"), F.lit(0).cast("long").alias("seen"), now.alias("at"))
