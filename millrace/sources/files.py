"""Files in and out: RSS, postings embedded in pages, run logs, evidence tables, hashed exports, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields that feeds' items have.
ITEM = "title string, link string, guid string, description string, region string, pubDate string"


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """A feed's items as JSON texts in a column `value`, ready for normalised()."""
    return spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path).select(F.to_json(F.struct("*")).alias("value"))


def embedded_postings(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """(key, title, company, location, description, posted_at) of job postings that pages carry as JSON-LD."""
    found = F.regexp_extract_all(F.col(markup), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    each = pages.select(key, F.explode(found).alias("j")).where(F.get_json_object("j", "$.@type") == "JobPosting")
    at = lambda p: F.nullif(F.trim(F.get_json_object("j", p)), F.lit(""))
    place = F.array_join(F.array_compact(F.array(at("$.jobLocation.address.addressLocality"), at("$.jobLocation.address.addressRegion"))), ", ")
    return each.select(key, at("$.title").alias("title"), at("$.hiringOrganization.name").alias("company"), F.nullif(place, F.lit("")).alias("location"), at("$.description").alias("description"), F.try_to_timestamp(at("$.datePosted")).alias("posted_at"))


def run_summaries(lines: DataFrame, column: str = "value") -> DataFrame:
    """Counters of scraper logs' `INGESTION_SUMMARY {json}` lines."""
    body = F.regexp_extract(column, r"INGESTION_SUMMARY\s+(\{.*\})", 1)
    schema = "seen long, inserted long, duplicates long, filtered long, errors long"
    return lines.select(F.from_json(F.nullif(body, F.lit("")), schema).alias("s")).where("s is not null").select("s.*")


def markdown_rows(lines: DataFrame, n_columns: int, column: str = "value") -> DataFrame:
    """Cells of a Markdown table's rows; headers' rules and other lines are left out."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(column), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(F.regexp_replace(c, r"\\\|", "|")))
    rows = lines.where(F.col(column).rlike(r"^\s*\|") & ~F.col(column).rlike(r"^[\s|:-]+$")).select(cells.alias("cells"))
    return rows.where(F.size("cells") == n_columns)


def with_hash(df: DataFrame, columns: Sequence[str], name: str = "input_hash") -> DataFrame:
    """Adds the sha256 of the columns as a JSON object with its keys in order."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def export_json(df: DataFrame, folder: str, order: Sequence[Column], columns: Sequence[str], most: int = 30) -> None:
    """A hash-bound export of at most `most` rows with their ordinals, as one JSON Lines file: an export is small by contract."""
    from millrace.operators.ranking import with_ordinal

    top = with_ordinal(df.orderBy(*order).limit(most), [], order)
    with_hash(top, columns).coalesce(1).write.mode("overwrite").json(folder)


def report_lines(gaps: DataFrame) -> DataFrame:
    """A line of Markdown for each concept."""
    return gaps.select("concept", F.format_string("- **%s**: %d required, %d preferred, %d postings", "concept", "n_required", "n_preferred", "jobs").alias("line"))
