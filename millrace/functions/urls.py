"""Canonical addresses, hosts and the platforms behind them."""

from __future__ import annotations

from urllib.parse import parse_qsl, unquote, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Parameters that only track, ports that go without saying.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "ref", "source")
PORTS = {"https": 443, "http": 80}
#: Hosts of each platform.
PLATFORM_HOSTS = {
    "Workday": ("myworkdayjobs.com", "workday.com"),
    "ADP": ("adp.com",),
    "Greenhouse": ("greenhouse.io",),
    "Lever": ("lever.co",),
    "Ashby": ("ashbyhq.com",),
    "Comeet": ("comeet.com", "comeet.co"),
    "Taleo": ("taleo.net",),
    "iCIMS": ("icims.com",),
    "SmartRecruiters": ("smartrecruiters.com",),
    "BambooHR": ("bamboohr.com",),
    "Workable": ("workable.com",),
    "Breezy": ("breezy.hr",),
    "Recruitee": ("recruitee.com",),
    "Pinpoint": ("pinpointhq.com",),
    "Oracle Cloud": ("oraclecloud.com",),
    "Sage HR": ("sage.hr",),
    "BrassRing": ("brassring.com",),
    "UKG": ("ultipro.com", "ukg.com", "saashr.com"),
    "Paylocity": ("paylocity.com",),
    "Paycom": ("paycomonline.net",),
    "Avature": ("avature.net", "apply.deloitte.com"),
    "Dayforce": ("dayforce.com", "dayforcehcm.com"),
    "SuccessFactors": ("jobs.stepan.com", "successfactors.com", "sapsf.com", "sapsf.eu"),
    "Rippling": ("rippling.com", "rippling-ats.com"),
    "DZConneX": ("dzconnex.com",),
    "Talemetry": ("ttcportals.com",),
    "Phenom": ("phenom.com", "phenompeople.com"),
}
#: Parameters that name a posting, path words before its id.
ID_PARAMETERS = frozenset(("jobid", "ghjid", "requisitionid", "reqid", "postingid", "positionid"))
ID_MARKERS = ("job", "jobs", "j", "position", "positions", "requisition", "requisitions", "opening", "openings")


def canonical(url: str | None) -> str:
    """An address without fragment, tracking parameters, usual port and closing slashes, its parameters in order; what is no address stays as it is."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url
    if not u.scheme or not host:
        return url
    path = u.path or "/"
    if len(path) > 1:
        path = path.rstrip("/") or "/"
    query = sorted(((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k not in TRACKING), key=lambda kv: kv[0])
    login = u.netloc.rpartition("@")[0]
    net = (f"{login}@" if login else "") + host + (f":{port}" if port and PORTS.get(u.scheme.lower()) != port else "")
    return urlunsplit((u.scheme.lower(), net, path, urlencode(query), ""))


@pandas_udf(StringType())
def normalize_url(s: pd.Series) -> pd.Series:
    return s.map(canonical)


def host(url: Column) -> Column:
    """Lower-cased host of an address, null where it can't be parsed."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def host_matches(host_name: Column, *domains: str) -> Column:
    """The host is one of the domains or lies under one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host_name == d) | host_name.endswith(f".{d}")
    return F.coalesce(out, F.lit(False))


def has_parameter(url: Column, name: str) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY")).rlike(rf"(^|&){name}(=|&|$)"), F.lit(False))


def platform(url: Column, source: Column, manual: Column) -> Column:
    """Hiring platform: one set by hand, else one in the source's tag, else by host and parameters, else Unknown."""
    tag = F.element_at(F.split(F.lower(source), "-"), 2)
    by_tag = F.initcap(tag)
    names = {p.lower(): p for p in PLATFORM_HOSTS}
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    out = F.lit("Unknown")
    h, path = host(url), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    for name, domains in reversed(PLATFORM_HOSTS.items()):
        test = host_matches(h, *domains)
        if name == "Workday":
            test = test | path.rlike("(?i)/job/[a-f0-9]{32}(?:/|$)")
        elif name == "Greenhouse":
            test = test | has_parameter(url, "gh_jid")
        elif name == "Phenom":
            test = test | has_parameter(url, "jobseqno")
        out = F.when(test, name).otherwise(out)
    out = F.when(F.lower(source).startswith("ats-"), F.coalesce(F.try_element_at(lookup, tag), by_tag)).otherwise(out)
    return F.when(F.coalesce(F.trim(manual) != "", F.lit(False)) & ~F.trim(manual).rlike(r"(?i)^unknown(?:\s+ats)?$"), manual).otherwise(out)


def requisition(url: str | None) -> tuple[str, str] | None:
    """(host, key) of the posting that an address names. On Workday the tenant and requisition count, whatever the host."""
    if not url:
        return None
    try:
        u = urlsplit(url.strip())
        name = (u.hostname or "").lower()
    except ValueError:
        return None
    if not name:
        return None
    steps = [p for p in u.path.split("/") if p]
    lower = [unquote(p).lower() for p in steps]
    tenant = workday_tenant(name, lower)
    if tenant and "job" in lower[:-1]:
        rest = lower[lower.index("job") + 1 :]
        last = rest[-1].rpartition("_")
        code = last[2] if last[1] else ""
        plain = code.replace("-", "")
        if len(code) >= 3 and plain.isalnum() and code.isascii() and code[0] != "-" and any(c.isdigit() for c in code):
            return f"workday:{tenant}", f"requisition:{code}"
        return f"workday:{tenant}", "path:" + "/".join(rest)
    for k, v in parse_qsl(u.query, keep_blank_values=True):
        if "".join(c for c in k.lower() if c.isascii() and c.isalnum()) in ID_PARAMETERS and v.strip():
            return name, v.strip().lower()
    for a, b in zip(steps, steps[1:]):
        if a.lower() in ID_MARKERS and unquote(b).strip():
            return name, unquote(b).strip().lower()
    named = lambda p: len(p) >= 4 and p.isascii() and p.replace("-", "").replace("_", "").isalnum() and any(c.isdigit() for c in p)
    found = next((p for p in reversed(steps) if named(p)), None)
    return (name, found.lower()) if found else None


def workday_tenant(name: str, steps: list[str]) -> str | None:
    first, _, rest = name.partition(".")
    shard, _, tail = rest.partition(".")
    sharded = shard[:2] == "wd" and shard[2:].isdigit()
    if rest == "myworkdayjobs.com" or (sharded and tail == "myworkdayjobs.com"):
        return first
    if name == "myworkdaysite.com" or name.endswith(".myworkdaysite.com"):
        if "recruiting" in steps[:-1]:
            tenant = "".join(c for c in steps[steps.index("recruiting") + 1] if c.isascii() and (c.isalnum() or c == "-"))
            if tenant:
                return tenant
        return first if sharded and tail == "myworkdaysite.com" else None
    return None


@pandas_udf(StringType())
def requisition_key(s: pd.Series) -> pd.Series:
    """host|key, null where an address names no posting."""
    return s.map(lambda x: "|".join(r) if (r := requisition(x)) else None)


def page_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.select("*", host(F.col(url)).alias("host"))
