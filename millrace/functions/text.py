"""Normal forms of names, titles, places and markup, as column expressions. Python is used only where the JVM has no function: Unicode normal forms and HTML parsing, both in Arrow batches."""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Legal suffixes of company names, and locations that titles carry.
LEGAL_SUFFIXES = "incorporated corporation company limited inc corp llc ltd plc".split()
TITLE_LOCATIONS = ["remote", "hybrid", "minneapolis", "st paul", "saint paul", "twin cities"]
TITLE_SEPARATORS = [" - ", " | ", " (", ", "]
#: What ECMAScript's \s matches.
SPACE = r"[\s   -     　﻿]"


@pandas_udf(StringType())
def decomposed(s: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD)."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKD", x), na_action="ignore")


@pandas_udf(StringType())
def composed(s: pd.Series) -> pd.Series:
    """Canonical composition (NFC)."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x), na_action="ignore")


@pandas_udf(StringType())
def compatible(s: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC)."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")


def ascii_words(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9 parted by single spaces, `&` spelt out; c must be free of accents, or have them decomposed."""
    bare = F.lower(F.regexp_replace(c, r"[̀-ͯ]", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "&", " and "), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    """As ascii_words, for any text; null gives an empty text."""
    return ascii_words(decomposed(F.coalesce(c, F.lit(""))))


def company(c: Column) -> Column:
    """A company's words without a hosting shard (`.wd1`) and legal suffixes."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)\.wd\d+$", "")
    return squeezed(F.regexp_replace(words(bare), rf"(?<![a-z0-9])(?:{'|'.join(LEGAL_SUFFIXES)})(?![a-z0-9])", " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used: an expression that is named within another is put in at every place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def title(c: Column) -> Column:
    """A title's words without one location at its end, set off by one of four separators."""
    text = F.trim(F.coalesce(c, F.lit("")))
    cut = F.lit(None).cast("string")
    for sep in reversed(TITLE_SEPARATORS):
        parts = F.split(text, f"\\Q{sep}\\E", -1)
        tail = F.trim(F.regexp_replace(F.element_at(parts, -1), r"[)|]+$", ""))
        head = F.substring(text, F.lit(1), F.length(text) - F.length(F.element_at(parts, -1)) - len(sep))
        known = F.regexp_replace(F.regexp_replace(F.lower(tail), r"\.", ""), r"\s+", " ").isin(TITLE_LOCATIONS)
        city = tail.rlike(r"^(?i)\s*[a-z .]{1,80}\s*,\s*[a-z]{2}\s*$")
        cut = F.when((F.size(parts) > 1) & (F.length(head) > 0) & (known | city), F.trim(head)).otherwise(cut)
    return words(F.coalesce(cut, text))


def location(c: Column) -> Column:
    """A place's words with common names shortened; `unknown` where there is none, `remote` where there is no place."""
    w = words(c)
    for pattern, short in (("united states of america|united states|u s a|usa", "us"), ("minnesota", "mn"), ("saint paul", "st paul"), ("virtual|work from home|distributed", "remote")):
        w = F.regexp_replace(w, rf"\b(?:{pattern})\b", short)
    w = squeezed(w)
    blank = c.isNull() | (c == "") | c.rlike("(?i)^https?://") | (w == "") | w.rlike("^(?:unknown|not specified|n a|none)$")
    return F.when(blank, "unknown").when(w.rlike("^(?:remote|anywhere|worldwide)$"), "remote").otherwise(w)


def query_family(c: Column) -> Column:
    """A search text as a slug, `all` where there is none."""
    return F.coalesce(F.nullif(F.regexp_replace(words(c), " ", "_"), F.lit("")), F.lit("all"))


def or_default(c: Column, default: str) -> Column:
    """The trimmed text, or a default where it is blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def title_case(slug: Column) -> Column:
    """Words of a slug with their first letters raised; other letters stay as they are."""
    parts = F.filter(F.split(slug, r"[-_\s]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), " ")


def tokens(c: Column, stop: list[str]) -> Column:
    """Distinct lower-case tokens of three or more letters, digits and + # . -, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z][a-z0-9+#.-]{2,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(stop)) if stop else found)


def plain_markdown(c: Column) -> Column:
    """Markdown text without bold marks, with `• ` bullets and at most one blank line in a row."""
    bold = F.regexp_replace(c, r"\*\*([^*]+)\*\*", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(bold, r"(?m)^[ \t]*[*-][ \t]+", "• "), r"\n\s*\n\s*\n+", "\n\n"))


class Visible(HTMLParser):
    """Collects text: a line end after p, div and li and for br, a bullet before li, nothing of scripts, styles and templates."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template"):
            self.hidden += 1
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "li":
            self.parts.append("• ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("p", "div", "li"):
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


TAG_LEFT = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?>", re.I)
EMOJI = re.compile("[‼⁉™ℹ↔-↪⌚-⏿Ⓜ▪-◾☀-➿⤴⤵⬅-⭕〰〽㊗㊙©®\U0001f000-\U0001faff]")


def visible_text(markup: str | None) -> str:
    """Text of markup, cleaned again (three times at most) while what comes out still holds tags, as escaped markup does."""
    text = markup or ""
    for turn in range(3):
        if turn and not TAG_LEFT.search(text):
            break
        parts = [text]
        if "<" in text or "&" in text:  # else there is nothing to parse
            parser = Visible()
            parser.feed(text)
            parser.close()
            parts = parser.parts
        out = EMOJI.sub("", "".join(parts))
        out = re.sub(r"\n\s*\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", out)).strip()
        if out == text:
            break
        text = out
    return text


@pandas_udf(StringType())
def clean_html(s: pd.Series) -> pd.Series:
    return s.map(visible_text)


@pandas_udf(StringType())
def clean_decomposed(s: pd.Series) -> pd.Series:
    """decomposed(clean_html), in one pass of one worker."""

    def one(x: str | None) -> str:
        shown = visible_text(x)
        return shown if shown.isascii() else unicodedata.normalize("NFKD", shown)

    return s.map(one)


def clean_words(c: Column) -> Column:
    """The words of a text whose markup is removed."""
    return ascii_words(clean_decomposed(F.coalesce(c, F.lit(""))))


@pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    return s.map(entities.unescape, na_action="ignore")


def scoring_text(c: Column) -> Column:
    """Composed text with \\n line ends; null where it holds U+0000 or isn't valid UTF-8."""
    return F.when(F.is_valid_utf8(c) & ~F.contains(c, F.lit("\x00")), F.regexp_replace(composed(c), "\r\n?", "\n"))


#: Words that are written short in titles and queries, and legal words of employers' names.
SHORT_TITLES = (("pbm", "partner business manager"), ("mgr", "manager"), ("manger", "manager"), ("csm", "customer success manager"))
SHORT_QUERIES = (("mgr", "manager"), ("pbm", "partner business manager"))
EMPLOYER_WORDS = "incorporated inc llc ltd corp corporation company".split()


def spelt_out(c: Column, short: tuple) -> Column:
    for word, whole in short:
        c = F.regexp_replace(c, rf"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])", whole)
    return c


def role_title(c: Column) -> Column:
    """A title's words in compatibility form, with short words spelt out; + # and - stay."""
    bare = F.regexp_replace(F.lower(compatible(F.coalesce(c, F.lit("")))), "[‐‑‒–—―]", "-")
    return F.trim(F.regexp_replace(spelt_out(bare, SHORT_TITLES), "[^a-z0-9+#-]+", " "))


def query_key(c: Column) -> Column:
    """A search query as words parted by `_`, short ones spelt out; `all` if there is none."""
    bare = F.regexp_replace(decomposed(F.coalesce(c, F.lit(""))), r"[̀-ͯ]", "")
    key = F.regexp_replace(F.regexp_replace(spelt_out(F.lower(bare), SHORT_QUERIES), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("all"))


def employer(c: Column) -> Column:
    """An employer's words in any script, without legal ones."""
    said = F.split(F.regexp_replace(F.regexp_replace(F.lower(composed(F.coalesce(c, F.lit("")))), "&", " and "), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_join(F.filter(said, lambda w: (w != "") & ~w.isin(EMPLOYER_WORDS)), " ")


def employer_text(name: str) -> str:
    """As employer, for a name at hand."""
    bare = re.sub(r"[\W_]+", " ", unicodedata.normalize("NFC", name).lower().replace("&", " and "))
    return " ".join(w for w in bare.split() if w not in EMPLOYER_WORDS)


def company_stem(c: Column) -> Column:
    """A company's ASCII words without one legal word at the end."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "&", " and "), "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(bare, r"\s+(?:incorporated|inc|llc|ltd|corporation|corp)$", ""))


def in_reading_order(c: Column) -> Column:
    """A key that sorts names as readers do, whatever their case and accents."""
    return F.collate(c, "UNICODE_CI_AI")
