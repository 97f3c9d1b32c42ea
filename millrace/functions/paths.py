"""Places named by the path of a posting's address, such as `/job/Dallas-TX/Engineer_1`. What can't be read as one place gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.places import STATE_CODES, STATE_NAMES

#: Words that end a city's field without being part of it, and fields that are no city.
LABELS = "office site location hq headquarters corporate branch plant facility campus store remote".split()
NO_CITY = ("usa", "us", "u s", "united states", "united states of america", "uk", "united kingdom")
CODES = [*STATE_CODES, "MN"]
NAMES = [*STATE_NAMES.split("|"), "minnesota"]
CITY_AND_STATE = r"^[A-Za-z][A-Za-z.' -]*,\s[A-Za-z]+(?:\s[A-Za-z]+){0,3}$"


def counts_places(location: Column) -> Column:
    """Whether a location only says how many there are (`2 Locations`)."""
    return F.coalesce(F.trim(location).rlike(r"(?i)^\d+\s+locations?$"), F.lit(False))


def tokens_of(field: Column) -> Column:
    return F.filter(F.split(field, "-"), lambda t: t != "")


def city(name: Column) -> Column:
    return F.when((name != "") & ~F.lower(F.trim(name)).isin(*NO_CITY), name)


def named(where: Column, state: Column) -> Column:
    c = city(where)
    return F.when(c.isNotNull(), F.concat(c, F.lit(", "), state))


def field_place(field: Column) -> Column:
    """One field of words joined by hyphens: City-ST, City-label, ST-City, City-State name or a plain name."""
    t = tokens_of(field)
    n, last, first = F.size(t), F.element_at(t, -1), F.element_at(t, 1)
    join = lambda a, k: F.array_join(F.slice(t, a, F.greatest(k, F.lit(0))), " ")
    address = F.exists(t, lambda x: x.rlike(r"(?i)^\d+(?:st|nd|rd|th)?$"))
    out = F.when((n == 0) | address, None).when((n > 1) & last.isin(CODES), named(join(1, n - 1), last)).when((n > 1) & F.lower(last).isin(LABELS), join(1, n - 1)).when((n > 1) & first.isin(CODES), named(join(2, n - 1), first))
    for k in (3, 2, 1):
        state = F.array_join(F.slice(t, F.greatest(n - k + 1, F.lit(1)), k), " ")
        out = out.when((n > k) & F.lower(state).isin(NAMES), named(join(1, n - k), state))
    return out.otherwise(join(1, n))


def segment_place(segment: Column) -> Column:
    """One or two fields, parted by two hyphens or more; the second must be a state's name."""
    parts = F.filter(F.split(F.trim(segment), "-{2,}"), lambda p: p != "")
    first, second = F.element_at(parts, 1), F.regexp_replace(F.element_at(parts, 2), "-", " ")
    t = tokens_of(first)
    address = F.exists(t, lambda x: x.rlike(r"(?i)^\d+(?:st|nd|rd|th)?$"))
    return F.when(F.size(parts) == 1, field_place(first)).when((F.size(parts) == 2) & F.lower(second).isin(NAMES) & (F.size(t) > 0) & ~address, named(F.array_join(t, " "), second))


def path_place(path: Column) -> Column:
    segment = F.nullif(F.regexp_extract(F.regexp_replace(path, r"\+", "%2B"), r"/job/([^/]+)(?:/|$)", 1), F.lit(""))
    return segment_place(F.try_url_decode(segment))


def with_count(primary: Column, counted: Column) -> Column:
    """`Dallas, TX; 3 Locations`: a clean city and state before the count; null otherwise."""
    p = F.trim(primary)
    return F.when(counts_places(counted) & p.rlike(CITY_AND_STATE), F.concat(p, F.lit("; "), F.trim(counted)))


def sites(primary: Column, others: Column) -> Column:
    """A posting's sites: the primary one, then the others in order, each once whatever its case."""
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), "[‐‑‒–—―]", "-"), r"\s+", " ")
    good = lambda c: F.when((c != "") & ~counts_places(c) & ~F.lower(c).rlike(r"^(?:unknown(?: location)?|n/?a|not specified|-)$"), c)
    first = good(tidy(primary))
    rest = F.array_sort(F.filter(F.transform(F.coalesce(others, F.array().cast("array<string>")), lambda o, i: F.struct(F.lower(good(tidy(o))).alias("k"), i.alias("i"), good(tidy(o)).alias("v"))), lambda o: o["k"].isNotNull() & ~o["k"].eqNullSafe(F.lower(first))))
    once = F.aggregate(rest, F.array().cast("array<struct<k:string,i:int,v:string>>"), lambda a, o: F.when(F.exists(a, lambda x: x["k"] == o["k"]), a).otherwise(F.concat(a, F.array(o))))
    every = F.concat(F.when(first.isNotNull(), F.array(first)).otherwise(F.array().cast("array<string>")), F.transform(once, lambda o: o["v"]))
    return F.nullif(F.array_join(every, "; "), F.lit(""))
