"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Records are whole WARC/1.1 records, written by Spark's text sink with the two line ends that close a record as line separator, so
that the files are WARC files on any file system Spark can write to (gzip by the sink's compression). Files are read
back by their Content-Length fields. Derived records keep the response's id as WARC-Refers-To, its target and date,
and, in the metadata block, its HTTP status line, headers and digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html_escapes
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import shared_path, workers_import, written

DATE = "2024-01-01T00:00:00Z"
#: Records a file holds at most, so that files of long pages stay far below the 2 GB that Spark's binary reader takes.
FILE_ROWS = 500
END = "\r\n\r\n"
#: How hard the sink's gzip tries; the files are read once and again by this package, so time counts before size.
GZIP_LEVEL = "BEST_SPEED"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Elements that start a new line.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>",
    re.S | re.I,
)
TITLE = re.compile(r"<title\b[^>]*+>(.*?)</title\s*>", re.S | re.I)
LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACES = re.compile(r"[^\S\n]+")


def plain(markup: str) -> tuple[str, int]:
    """Visible text, a line for each block, and the number of links. The head's title, scripts, styles and comments are left out."""
    body = TITLE.sub("", markup)
    out, at, links = [], 0, 0
    for m in TOKEN.finditer(body):
        out.append(body[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if name in BLOCKS:
            out.append("\n")
        elif name in ("td", "th"):
            out.append(" ")
        elif name == "a" and not m[2] and HREF.search(m[4]):
            links += 1
    out.append(body[at:])
    lines = (SPACES.sub(" ", x).strip() for x in html_escapes.unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), links


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], content_type: str, block: bytes) -> str:
    """A record without the two line ends that close it. A line end within a field value is written as a space."""
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in head)]
    return "\r\n".join(lines) + END + block.decode("utf-8", "replace")


def name_of(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join(parts))}>"


def response(page_id, url: str | None, markup: str | None) -> str:
    payload = (markup or "").encode("utf-8", "replace")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", name_of("response", str(page_id), url or "", digest(payload))), ("WARC-Date", DATE), ("WARC-Target-URI", url or ""), ("WARC-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", digest(payload))]
    return record("response", fields, "application/http; msgtype=response", head + payload)


def parse(raw: bytes) -> list[tuple[dict, bytes]]:
    """(header fields, block) of each record of a WARC file, plain or gzip."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    out, at = [], 0
    while at < len(raw):
        split = raw.index(b"\r\n\r\n", at)
        lines = raw[at:split].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["Content-Length"])
        out.append((fields, raw[split + 4 : split + 4 + n]))
        at = split + 4 + n + len(END)
    return out


def derive(fields: dict, block: bytes) -> tuple[str, str]:
    """The metadata and the conversion record of a response record."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *headers = head.decode("latin-1").split("\r\n")
    markup = payload.decode("utf-8", "replace")
    text, links = plain(markup)
    title, lang = TITLE.search(markup), LANG.search(markup)
    source = fields["WARC-Record-ID"]
    common = [("WARC-Refers-To", source), ("WARC-Date", fields["WARC-Date"]), ("WARC-Target-URI", fields["WARC-Target-URI"]), ("WARC-Page-ID", fields.get("WARC-Page-ID", "")), ("WARC-Refers-To-Digest", fields.get("WARC-Payload-Digest", ""))]
    conversion_id = name_of("conversion", source)
    about = [("source-status", status), *(("source-header", h) for h in headers), ("source-payload-digest", fields.get("WARC-Payload-Digest", "")), ("source-block-digest", fields.get("WARC-Block-Digest", "")), ("source-content-length", fields["Content-Length"]), ("payload-digest-matches", str(digest(payload) == fields.get("WARC-Payload-Digest")).lower()), ("conversion", conversion_id), ("title", html_escapes.unescape(title[1]) if title else ""), ("lang", lang[1] if lang else ""), ("links", str(links))]
    notes = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in about).encode()
    return (
        record("metadata", [("WARC-Record-ID", name_of("metadata", source)), *common], "application/warc-fields", notes),
        record("conversion", [("WARC-Record-ID", conversion_id), *common], "text/plain; charset=utf-8", text.encode("utf-8", "replace")),
    )


def write(records: DataFrame, folder: str) -> None:
    """records: (kind, value) to a folder of gzip WARC files for each kind."""
    records.select("kind", "value").write.partitionBy("kind").option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).option("maxRecordsPerFile", FILE_ROWS).text(folder)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(kind, value): a response record for each page; a null address or markup is empty."""

    def run(batches):
        for batch in batches:
            made = [response(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array(["response"] * len(made)), pa.array(made, pa.string())], names=["kind", "value"])

    workers_import(pages.sparkSession)
    return pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(markup).cast("string")).mapInArrow(run, "kind string, value string")


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def derived(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, value): the metadata and conversion records of all response records in a folder of WARC files."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                parsed = parse(batch.column(0)[i].as_py())
                for a in range(0, len(parsed), 200):
                    made = [r for f, b in parsed[a : a + 200] if f["WARC-Type"] == "response" for r in derive(f, b)]
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(["metadata", "conversion"] * (len(made) // 2)), pa.array(made, pa.string())], names=["kind", "value"])

    workers_import(spark)
    return files(spark, folder).mapInArrow(run, "kind string, value string")


SUMMARY = "page_id long, url string, response_id string, kind string, record_id string, source_digest string, digest string, sound boolean, title string, lang string, n_links long, source_status string, source_header string, text string"


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each derived record in a folder of WARC files. sound: its block has the digest in its header."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                parsed = parse(batch.column(0)[i].as_py())
                for a in range(0, len(parsed), 200):
                    rows = [summary(f, b) for f, b in parsed[a : a + 200] if "WARC-Refers-To" in f]
                    if rows:
                        kinds = [pa.int64(), *[pa.string()] * 6, pa.bool_(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 3]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SUMMARY.split(", ")])

    workers_import(spark)
    return files(spark, folder).mapInArrow(run, SUMMARY)


def summary(f: dict, block: bytes) -> tuple:
    notes: dict[str, str] = {}
    text = None
    if f["WARC-Type"] == "metadata":
        for line in block.decode("utf-8").split("\r\n")[:-1]:
            k, _, v = line.partition(": ")
            notes[k] = f"{notes[k]}; {v}" if k in notes else v
    else:
        text = block.decode("utf-8")
    page = f.get("WARC-Page-ID")
    return (int(page) if page else None, f["WARC-Target-URI"], f["WARC-Refers-To"], f["WARC-Type"], f["WARC-Record-ID"], f["WARC-Refers-To-Digest"], f["WARC-Block-Digest"], digest(block) == f["WARC-Block-Digest"], notes.get("title"), notes.get("lang"), int(notes["links"]) if "links" in notes else None, notes.get("source-status"), notes.get("source-header"), text)


def once_each(pages: DataFrame, key: str, url: str, markup: str, captures: bool) -> DataFrame:
    """Rows without repeats of key, address and markup or, without captures, of key and address, of which the least markup stays.

    Only keys and addresses are shuffled to find repeats, and markup of repeats alone.
    """
    again = written(pages.groupBy(key, url).count().where("count > 1").select(F.col(key).alias("__key"), F.col(url).alias("__url")), "repeated")
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col(url).eqNullSafe(F.col("__url"))
    repeats = pages.join(again, same, "left_semi")
    once = repeats.distinct() if captures else repeats.groupBy(key, url).agg(F.min(markup).alias(markup))
    return pages.join(again, same, "left_anti").unionByName(once)


def derivatives(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html", captures: bool = False) -> DataFrame:
    """A row for each response: its ids and digests, its metadata and its plain text, read back from the written WARC files.

    Null addresses and markup are empty; a null key stays null; an empty table gives no rows; other columns are ignored.
    captures: each different markup of a key and address is a response; else they give one row, of the least markup.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    sent = pages.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (url, markup)])
    once = once_each(sent, key, url, markup, captures)
    if pages.isEmpty():
        rows = spark.createDataFrame([], SUMMARY)
    else:
        write(responses(once, key, url, markup), f"{folder}/source")
        write(derived(spark, f"{folder}/source/kind=response"), f"{folder}/derived")
        rows = summaries(spark, f"{folder}/derived")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return rows.groupBy("response_id").agg(
        F.max("page_id").alias(key), F.max("url").alias(url), F.max("source_digest").alias("source_digest"),
        of("metadata", "record_id").alias("metadata_id"), of("conversion", "record_id").alias("conversion_id"),
        of("metadata", "digest").alias("metadata_digest"), of("conversion", "digest").alias("conversion_digest"),
        F.bool_and("sound").alias("sound"), F.max("title").alias("title"), F.max("lang").alias("declared_lang"), F.max("n_links").alias("n_links"),
        F.max("source_status").alias("source_status"), F.max("source_header").alias("source_headers"), F.max("text").alias("text"),
    )
