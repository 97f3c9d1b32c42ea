"""Requirements that a description states, one row each, by a table function in a lateral join.

A first pass gives every line the section that it stands in, by a table of headings; a second takes from each line its clauses, or, outside of
sections of requirements, its sentences that demand something. Places are counted in code points.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple

import regex
from pyspark.sql import DataFrame
from pyspark.sql.functions import lit, udtf

from millrace.tables import dealt

MOST, LONGEST = 32, 500
SCHEMA = "requirement_id string, text string, original string, classification string, section string, source string, start int, end int, mandatory boolean, fault string"

# Headings, language and marks of lists.
MANDATORY_HEADING = r"(?i)^(?:required experience|required qualifications?|required skills?|minimum qualifications?|basic qualifications?|minimum requirements?|requirements?|qualifications?|role-defining qualifications?|what you(?:'|’)ll bring|what you will bring|what you bring|what we(?:'|’)re looking for|who you are|skills and experience|abilities)\s*:?[\s]*$"
PREFERRED_HEADING = r"(?i)^(?:preferred(?: experience| qualifications?| skills?)?|desired(?: experience| qualifications?| skills?)?|nice to have|bonus(?: points)?|ideal candidate)\s*:?[\s]*$"
HEADING_LEAK = r"(?i)^(?:what|who|why|how)\b[^.!?]{0,100}(?:\?\s*$|stand out|nice to haves?\)|nonessential skills)"
CREDENTIAL_HEADING = r"(?i)^role-defining qualifications?\s*:?\s*$"
STOP_HEADING = r"(?i)^(?:(?:responsibilities(?: include)?|ai\s*&\s*hiring integrity|benefits(?:\s*&\s*perks| and perks)?|equal opportunity|working at|why|our)\b|(?:what you(?:'|’)ll do|what you will do|the role|role overview|about(?: us| the role)?|compensation|salary|perks)\s*:?[\s]*$)"
PACKET_IGNORED_HEADING = r"(?i)^(?:work location and travel|compensation)\s*:?[\s]*$"
MANDATORY_LANGUAGE = r"(?i)\b(?:must|requires?|required|required experience|required qualifications?|minimum qualifications?|minimum of|at least|\d+(?:\.\d+)?\+?\s+years?|bachelor(?:'s|’s)?(?: degree)?|ability to travel|willing(?:ness)? to travel)\b"
PREFERENCE_LANGUAGE = r"(?i)\b(?:preferred|ideally|nice to have|bonus|a plus|as many of the following as possible)\b"
NON_MANDATORY_LANGUAGE = r"(?i)\b(?:not required|is optional|are optional|no [^.]{0,60} required)\b"
OPTIONAL_LIST_INTRODUCTION = r"(?i)\b(?:as many of the following as possible|ideal candidate.{0,80}(?:following|competitive)|candidates? strong on \w+ of (?:the )?\w+|preferred (?:skills|experience|qualifications?).{0,40}(?:include|are|following))\b"
CLAUSE_END = r"(?i)\s*;\s*|\s*,\s+(?=(?:and\s+)?(?:\d|experience\b|knowledge\b|proficien|fluency\b|ability\b|willingness\b|track\b|valid\b|active\b|current\b|a\s+(?:valid|active|current)\b|an\s+(?:active|current)\b))"
LICENCE = r"(?i)\b(?:driver(?:'s)? licen[cs]e|driving record|work authori[sz]ation)\b"
AFTER_LICENCE = r"(?i)\s*,\s+and\s+(?=(?:customer relations|b2b sales|sales experience)\b)"
SENTENCE = r"[^.!?\n]+(?:[.!?]+|$)"
MARKS, NUMBER = r"^[\s\-*•‣▪◦]+", r"^\d+[.)]\s*"
CAPITALS, TITLED = r"^[A-Z][A-Z\s&/–—-]{2,}$", r"^(?:[A-Z][\p{L}&/–—-]+\s*){1,6}$"
VERIFICATION, PREFERRED_ITEM = r"(?i)^(?:required|preferred) verification item\s*:\s*", r"(?i)^(?:preferred verification item|preferred)\s*:"

#: What a line does to the section: the first rule that it meets, where the rule holds in any section or in the one named.
HEADINGS = (("ignored", PACKET_IGNORED_HEADING, None), ("credential", CREDENTIAL_HEADING, None), ("mandatory", MANDATORY_HEADING, None), ("preferred", PREFERRED_HEADING, None), ("preferred", OPTIONAL_LIST_INTRODUCTION, "mandatory"), ("other", STOP_HEADING, None))
#: Sections whose lines are requirements: their name in the result, what they are, and the language with which a line is judged by its sentences instead.
STATED = {
    "mandatory": ("REQUIRED EXPERIENCE", "required", (PREFERENCE_LANGUAGE, NON_MANDATORY_LANGUAGE)),
    "preferred": ("PREFERRED EXPERIENCE", "preferred", (NON_MANDATORY_LANGUAGE,)),
    "credential": ("ROLE-DEFINING QUALIFICATIONS", "required", (NON_MANDATORY_LANGUAGE,)),
}


class Line(NamedTuple):
    start: int
    raw: str

    def span(self) -> tuple[int, int]:
        """Where the line stands without the blanks around it."""
        text = self.raw.strip()
        at = self.start + (len(self.raw) - len(self.raw.lstrip()))
        return at, at + len(text)


class Stated(NamedTuple):
    text: str
    original: str
    classification: str
    section: str
    source: str
    span: tuple[int, int]


#: Looking a pattern up in the module's own cache costs more than most searches.
compiled = cache(regex.compile)
BLANKS, MARKED, NUMBERED, ENDING, AND, DEMAND = map(re.compile, (r"\s+", MARKS, NUMBER, r"[.;:,]+$", r"(?i)^and\s+", SENTENCE))
CLAUSE_ENDS, LICENCE_ENDS = re.compile(CLAUSE_END), re.compile(AFTER_LICENCE)


def has(pattern: str, text: str) -> bool:
    return compiled(pattern).search(text) is not None


def clean(text: str) -> str:
    """Without list marks and numbers at the beginning, blanks as single spaces."""
    return BLANKS.sub(" ", NUMBERED.sub("", MARKED.sub("", text))).strip()


def normal(text: str) -> str:
    return ENDING.sub("", clean(unicodedata.normalize("NFKC", text))).lower()


def requirement_id(text: str, classification: str) -> str:
    return "req-" + hashlib.sha256(f"{classification}\0{normal(text)}".encode()).hexdigest()[:24]


def is_heading(line: str) -> bool:
    if not 0 < len(line) <= 100:
        return False
    return line.endswith(":") or has(CAPITALS, line) or (has(TITLED, line) and line[-1] not in ".!?")


def clauses(text: str) -> list[str]:
    """The parts of a line that can be judged one by one; the whole if it is one."""
    whole = clean(text)
    parts = [x for part in CLAUSE_ENDS.split(whole) for x in (LICENCE_ENDS.split(part) if has(LICENCE, part) else [part])]
    parts = [x for x in (AND.sub("", clean(part)) for part in parts) if x]
    return parts if len(parts) > 1 else [whole]


def demands(line: Line) -> Iterator[tuple[str, tuple[int, int]]]:
    """A line's sentences that demand something, and where they stand."""
    for m in DEMAND.finditer(line.raw):
        text = clean(m[0])
        if text and has(MANDATORY_LANGUAGE, text) and not has(PREFERENCE_LANGUAGE, text) and not has(NON_MANDATORY_LANGUAGE, text):
            yield text, Line(line.start + m.start(), m[0]).span()


def in_sections(description: str) -> Iterator[tuple[str, Line]]:
    """Lines that are neither blank nor headings, each with its section."""
    section, at = "other", 0
    for raw in description.split("\n"):
        line, at = Line(at, raw), at + len(raw) + 1
        text = raw.strip()
        if not text:
            continue
        turn = next((name for name, pattern, inside in HEADINGS if inside in (None, section) and has(pattern, text)), None)
        if turn is None and section == "other" and is_heading(text):
            continue
        if turn:
            section = turn
        elif section != "ignored":
            yield section, line


def stated(section: str, line: Line) -> Iterator[Stated]:
    """What one line states."""
    text = line.raw.strip()
    name, classification, unless = STATED.get(section, ("OTHER", "required", ()))
    if section not in STATED or any(has(p, text) for p in unless):
        for sentence, span in demands(line):
            yield from (Stated(c, sentence, "required", "OTHER", "mandatory_language", span) for c in clauses(sentence))
        return
    if section == "credential" and has(PREFERRED_ITEM, text):
        classification = "preferred"
    body = re.sub(VERIFICATION, "", text) if section == "credential" else text
    yield from (Stated(c, text, classification, name, "explicit_section", line.span()) for c in clauses(body))


def leaks(s: Stated, screens: Sequence[str]) -> bool:
    """Labels of sections, and boilerplate by the caller's patterns, which are held against the whole line too, as a clause may not show it."""
    text, original = clean(s.text), clean(s.original)
    labels = (HEADING_LEAK, MANDATORY_HEADING, PREFERRED_HEADING, CREDENTIAL_HEADING)
    return any(has(p, text) for p in labels) or any(has(p, x) for p in screens for x in (original, text))


def requirements(description: str | None, title: str | None, screens: Sequence[str] = ()) -> list[tuple]:
    """Rows of SCHEMA, in order of place. A description that states none gives one row for the title's core function; one that breaks a limit gives one row that names the fault, and nothing is cut off."""
    found: dict[tuple[str, str], Stated] = {}
    for section, line in in_sections(description or ""):
        for s in stated(section, line):
            identity = (s.classification, normal(s.text))
            if identity[1] in ("", "not stated") or identity in found or leaks(s, screens):
                continue
            if len(clean(s.text)) > LONGEST:
                return [(None,) * 9 + ("too_long",)]
            found[identity] = s
    if len(found) > MOST:
        return [(None,) * 9 + ("too_many",)]
    rows = [(requirement_id(clean(s.text), s.classification), clean(s.text), clean(s.original), s.classification, s.section, s.source, *s.span, s.section == "OTHER" or s.classification == "required", None) for s in found.values()]
    if not rows:
        core = f"Primary core function of the {clean(title or '') or 'assigned role'}"
        return [(requirement_id(core, "required"), core, core, "required", "OTHER", "core_function", 0, 0, False, None)]
    return sorted(rows, key=lambda r: r[6:8])


@udtf(returnType=SCHEMA)
class RequirementRows:
    """requirement_rows(description, title, screens): one call a text, one state machine in it."""

    def eval(self, description: str, title: str, screens: list):
        yield from requirements(description, title, screens)


def requirement_rows(df: DataFrame, description: str, title: str, screens: Sequence[str] = ()) -> DataFrame:
    """df with a row for each requirement that a description states; see requirements(). Null descriptions state none.

    Texts are dealt over all cores first: the table function works through a partition in one process.
    """
    from pyspark.sql.functions import array, col

    given = array(*map(lit, screens)) if screens else array().cast("array<string>")
    return dealt(df).lateralJoin(RequirementRows(col(description).outer(), col(title).outer(), given))
