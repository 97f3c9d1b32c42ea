"""Assessments of postings from answered questions and quoted evidence, as joins and groupings.

answers:  job_id, question, answer (yes, no, unsupported), evidence array<string> of evidence ids
evidence: job_id, evidence_id, quote, source, occurrences array<struct<start int, end int>> in code points
jobs:     job_id, jd, company, title, location
Numbers that a policy sets are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from millrace.functions import places, text
from millrace.tables import dealt, kept

#: Pay components by question: (question, component, cash, recurring, inclusion).
COMPONENTS = [
    ("S2.CP.Q01", "fixed_base", True, True, "included"),
    ("S2.CP.Q02", "fixed_periodic", True, True, "included"),
    ("S2.CP.Q03", "unlabeled_annual_pay", True, True, "included"),
    ("S2.CP.Q04", "ote", True, True, "included"),
    ("S2.CP.Q05", "total_cash", True, True, "included"),
    ("S2.CP.Q06", "other_total_compensation", False, True, "unknown"),
    ("S2.CP.Q07", "commission", True, True, "included"),
    ("S2.CP.Q08", "variable", True, True, "included"),
    ("S2.CP.Q09", "bonus", True, True, "included"),
    ("S2.CP.Q12", "draw", True, True, "unknown"),
    ("S2.CP.Q13", "sign_on", True, False, "excluded"),
    ("S2.CP.Q14", "equity", False, False, "excluded"),
    ("S2.CP.Q15", "profit_sharing", True, True, "unknown"),
]
#: Patterns of pay and travel statements.
AMOUNT = r"(?<![\p{L}\p{N}.])(?:USD\s*|US\$\s*|\$\s*)?((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?\s*[kK]?)(?!\s*%)(?![\p{L}\p{N}])"
DOLLARS = r"(?i)\bUSD\b|US\$"
PERIODS = {"annual": r"(?i)\b(?:annual|annually|per\s+year|yearly|p\.a\.)(?![\w])|/\s*year\b", "monthly_fixed": r"(?i)\b(?:monthly|per\s+month)\b|/\s*month\b", "weekly_fixed": r"(?i)\b(?:weekly|per\s+week)\b|/\s*week\b", "hourly_fixed": r"(?i)\b(?:hourly|per\s+hour)\b|/\s*(?:hour|hr)\b"}
PAY_SAID = r"(?i)(?:\b(?:salary|pay|compensation|base|ote|on-target earnings|commission|bonus|variable|hourly|equity|stock)\b[^.\n]{0,100}?(?:USD|US\$|\$)\s*\d|(?:USD|US\$|\$)\s*\d[^.\n]{0,100}?\b(?:salary|pay|compensation|base|ote|commission|bonus|variable|hourly)\b)"
CASH_ONLY = r"(?i)\b(?:cash|excluding\s+(?:equity|stock|benefits)|does not include\s+(?:equity|stock|benefits))\b"
CAPPED = r"(?i)\b(?:maximum|capped|cap\s+of|not\s+to\s+exceed|cannot\s+exceed)\b"
ALL_CASH = r"(?i)\b(?:comprise|comprises|composed\s+of|consists?\s+of|constitute|constitutes|make\s+up|makes\s+up)\b.{0,100}\b(?:all|entire|total)\b.{0,60}\b(?:recurring\s+)?cash(?:\s+compensation)?\b|\bno\s+other\s+recurring\s+cash\b"
TRAVEL_SAID = r"(?i)(?:\btravel(?:s|ing|led|ling)?\b[^.\n]{0,100}?\b\d+(?:\.\d+)?\s*(?:%|percent)(?![^\W\d_])|\b\d+(?:\.\d+)?\s*(?:%|percent)(?![^\W\d_])[^.\n]{0,100}?\btravel(?:s|ing|led|ling)?\b)"
NO_TRAVEL_SAID = r"(?i)\b(?:no\s+travel|travel\s+(?:is\s+)?(?:not\s+required|required\s*[:=-]?\s*0\s*(?:%|percent)|0\s*(?:%|percent)))\b"
VAGUE = r"(?i)\b(?:about|approximately|approx\.?|around|roughly|typically|usually|generally|expected|anticipated)\b[^.\n]{0,40}\b\d{1,3}\s*(?:%|percent)"
CONDITIONAL = r"(?i)\b(?:depending\s+on|varies?\s+by|based\s+on|by\s+(?:region|location|season|territory|purpose)|during\s+(?:peak|busy|holiday|summer|winter|spring|fall)|if|when)\b"
#: Points of the widest stated reach and of the closest field work, by question.
REACH = [("S2.TR.Q09", 15), ("S2.TR.Q08", 12), ("S2.TR.Q07", 10), ("S2.TR.Q06", 7), ("S2.TR.Q05", 4)]
FIELD = [("S2.TR.Q10", 5), ("S2.TR.Q11", 4), ("S2.TR.Q12", 3), ("S2.TR.Q13", 2)]
MOST_TRAVEL_POINTS = 30
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
CLAUSES = ArrayType(StructType([StructField("lower", IntegerType()), StructField("upper", IntegerType()), StructField("lower_explicit", BooleanType()), StructField("upper_explicit", BooleanType())]))


@dataclass(frozen=True)
class Policy:
    """floor and tiers in cents: (least reference, points) from the highest; travel tiers: (minimum, maximum, points); bands: (code, label, minimum, maximum); aliases: trigger code to company names, in trigger order; kills: questions whose yes ends it."""

    floor_cents: int = 0
    pay_tiers: Sequence[tuple[int, int]] = ()
    lower_tiers: Sequence[tuple[int, int, int]] = ()
    upper_tiers: Sequence[tuple[int, int, int]] = ()
    lexemes: Mapping[str, int] | None = None
    other_travel: int = 0
    lower_words: Sequence[str] = ("at least", "minimum of", "minimum", "more than", "over")
    upper_words: Sequence[str] = ("up to", "maximum of", "maximum", "no more than", "less than", "under")
    separators: Sequence[str] = ("-", "–", "to")
    bands: Sequence[tuple[str, str, int, int]] = ()
    aliases: Mapping[str, Sequence[str]] | None = None
    kills: Sequence[str] = ()
    agency_words: Sequence[str] = ()
    local_words: Sequence[str] = ()
    weak_agency_words: Sequence[str] = ()
    agency_aliases: Sequence[str] = ()
    base_question: str = "S1.Q03"
    agency_question: str = "S1.Q06"


def spans_of(pattern: str):
    """Where a pattern matches, in code points."""
    found = re.compile(pattern)

    @pandas_udf(SPANS)
    def spans(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": m.start(), "end": m.end()} for m in found.finditer(t or "")])

    return spans


def quotes(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(job_id, question, answer, pos, evidence_id, quote, source, occurrences): a row for each cited piece of evidence that exists."""
    cited = answers.select("job_id", "question", "answer", F.posexplode("evidence").alias("pos", "evidence_id"))
    return cited.join(evidence.select("job_id", "evidence_id", "quote", "source", "occurrences"), ["job_id", "evidence_id"])


def cited_quotes(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """quotes(), written once, as several sums are taken of them."""
    return kept(dealt(quotes(answers, evidence), "job_id"), "quotes")


def told_spans(questions: Column) -> Column:
    """An aggregate of quotes(): where evidence for the questions occurs in the posting."""
    return F.flatten(F.collect_list(F.when(questions & (F.col("source") == "original_jd"), F.col("occurrences"))))


def covered(said: Column, told: Column) -> Column:
    """Whether every span of said lies in one of told; null if there is none."""
    inside = lambda s: F.exists(F.coalesce(told, F.array().cast(SPANS)), lambda o: F.coalesce((o["start"] <= s["start"]) & (o["end"] >= s["end"]), F.lit(False)))
    return F.when(F.size(said) > 0, F.forall(said, inside))


def with_spans(jobs: DataFrame, **patterns: str) -> DataFrame:
    """(job_id, spans of each pattern in jd), by all cores and dealt by job_id, so that what is joined to it by job_id finds it in place."""
    return dealt(jobs.select("job_id", "jd"), "job_id").select("job_id", *[spans_of(p)(F.col("jd")).alias(name) for name, p in patterns.items()])


def yes_questions(answers: DataFrame) -> DataFrame:
    return answers.where("answer = 'yes'").groupBy("job_id").agg(F.collect_set("question").alias("yes"))


def cents(amount: Column) -> Column:
    """Cents of a written amount such as `1,200.50` or `90k`; null beyond 15 digits."""
    number = F.regexp_replace(amount, r"[,\skK]", "")
    value = F.when(F.length(number) <= 15, (number.cast("decimal(18,2)") * 100).cast("decimal(38,0)")) * F.when(amount.rlike("[kK]"), 1000).otherwise(1)
    return F.when(value <= (1 << 53) - 1, value.cast("long"))


def period_of(quote: Column) -> Column:
    return F.coalesce(*[F.when(quote.rlike(p), name) for name, p in PERIODS.items()])


def yearly(value: Column, period: Column, quote: Column) -> Column:
    """Cents a year; hourly pay needs stated hours or full time."""
    stated = F.nullif(F.regexp_extract(quote, r"(?i)\b(\d{3,4})\s+(?:scheduled\s+)?hours?\s+(?:per\s+year|annually)\b", 1), F.lit("")).cast("long")
    weekly = F.nullif(F.regexp_extract(quote, r"(?i)\b(\d{1,2})\s+hours?\s+(?:per\s+week|weekly)\b", 1), F.lit("")).cast("long") * 52
    hours = F.coalesce(stated, weekly, F.when(quote.rlike(r"(?i)\bfull[- ]time\b"), 2080))
    return F.when(period == "annual", value).when(period == "monthly_fixed", value * 12).when(period == "weekly_fixed", value * 52).when(period == "hourly_fixed", value * hours)


def geography(quote: Column, location: Column, by_place: Column) -> Column:
    """To which of the posting's places a pay statement applies."""
    low, where = F.lower(quote), F.lower(F.coalesce(location, F.lit("")))
    city = F.trim(F.split(where, ",")[0])
    home = r"(?i)\b(?:minnesota|mn)\b"
    return (
        F.when(~by_place, "unqualified_role_wide")
        .when(((where != "") & F.contains(low, where)) | ((F.length(city) >= 3) & F.contains(low, city)), "exact_role_city_state")
        .when(quote.rlike(home) & where.rlike(home), "minnesota")
        .when(quote.rlike(r"(?i)\b(?:nationwide|united states|u\.s\.|usa)(?!\w)"), "nationwide_united_states")
        .otherwise("not_deterministically_applicable")
    )


RANKS = {"exact_role_city_state": 4, "minnesota": 3, "nationwide_united_states": 2, "unqualified_role_wide": 1}


def pay_records(jobs: DataFrame, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each quote of a pay component: its amounts in cents, currency, period, yearly bounds, geography and how it counts. unsafe: amounts that can't be read."""
    return records_of(jobs, answers, cited_quotes(answers, evidence))


def records_of(jobs: DataFrame, answers: DataFrame, cited: DataFrame) -> DataFrame:
    """pay_records() of a written table of quotes."""
    table = jobs.sparkSession.createDataFrame(COMPONENTS, "question string, component string, cash boolean, recurring boolean, inclusion string")
    whole = cited.groupBy("job_id").agg(
        F.concat_ws("\n", F.collect_list(F.when(F.col("question") == "S2.CP.Q18", F.col("quote")))).alias("all_currency"),
        F.concat_ws("\n", F.collect_list(F.when(F.col("question") == "S2.CP.Q19", F.col("quote")))).alias("all_period"),
        F.lower(F.concat_ws("\n", F.collect_list(F.when(F.col("question") == "S2.CP.Q17", F.col("quote"))))).alias("inclusions"),
    )
    said = cited.where("answer = 'yes'").join(F.broadcast(table), "question").join(whole, "job_id").join(yes_questions(answers), "job_id").join(jobs.select("job_id", "location"), "job_id")
    q = F.col("quote")
    read = F.transform(F.regexp_extract_all(q, F.lit(AMOUNT), F.lit(1)), cents)
    said = said.withColumn("read", read).withColumn("amounts", F.array_distinct(F.filter("read", lambda c: (c >= 100) | q.rlike(r"USD|US\$|\$"))))
    said = said.withColumn("unsafe", F.exists("read", lambda c: c.isNull()) | (F.size("amounts") > 2))
    currency = F.when(q.rlike(DOLLARS), "USD").otherwise(F.when(F.col("all_currency").rlike(DOLLARS), "USD"))
    said = said.withColumn("currency", currency).withColumn("period", F.coalesce(period_of(q), period_of(F.col("all_period"))))
    other, draw = F.col("component") == "other_total_compensation", F.col("component") == "draw"
    cash = F.when(other, q.rlike(CASH_ONLY)).otherwise(F.col("cash"))
    counted = F.when(other, F.when(q.rlike(CASH_ONLY), "included").otherwise("unknown")).when(draw, F.when(q.rlike(r"(?i)\bnon[- ]?recoverable\b"), "included").otherwise("excluded")).otherwise(F.col("inclusion"))
    left_out = F.contains("inclusions", F.lit("exclude")) & F.contains(F.col("inclusions"), F.regexp_replace("component", "^([^_]*)_", "$1 "))
    some = ~F.col("unsafe") & (F.size("amounts") > 0)
    said = said.withColumn("cash", F.when(some, cash).otherwise(F.col("cash"))).withColumn("inclusion", F.when(some & left_out, "excluded").when(some, counted).otherwise(F.col("inclusion")))
    said = said.withColumn("lower", F.when(some, F.array_min("amounts"))).withColumn("upper", F.when(some, F.array_max("amounts")))
    dollars = F.coalesce(F.col("currency") == "USD", F.lit(False))
    said = said.withColumn("applies", geography(q, F.col("location"), F.array_contains("yes", "S2.CP.Q16")))
    rank = F.coalesce(*[F.when(F.col("applies") == k, r) for k, r in RANKS.items()], F.lit(0))
    reason = F.when(F.col("unsafe"), "unsafe").when(~some, "unquantified_component").when(~dollars, "currency_not_explicit_usd").when(F.col("period").isNull(), "period_not_explicit").otherwise("parsed")
    return said.select(
        "job_id", "question", "evidence_id", "component", "quote", "cash", "recurring", "inclusion", "lower", "upper", F.when(some, F.col("currency")).alias("currency"), F.when(some, F.col("period")).alias("period"),
        F.when(some & dollars, yearly(F.col("lower"), F.col("period"), q)).alias("year_lower"), F.when(some & dollars, yearly(F.col("upper"), F.col("period"), q)).alias("year_upper"),
        "applies", rank.alias("rank"), "unsafe", reason.alias("reason"),
    )


def compensation(jobs: DataFrame, answers: DataFrame, evidence: DataFrame, policy: Policy) -> DataFrame:
    """(job_id, state, lower_cents, upper_cents, total_upper_cents, reference_cents, proven_cents, floor_outcome, points, reason): a row for each job."""
    cited = cited_quotes(answers, evidence)
    safe = ~F.col("unsafe")
    records = records_of(jobs, answers, cited).withColumn("top", F.max(F.when(safe, F.col("rank"))).over(Window.partitionBy("job_id")))
    # What is comparable is told within the sums: as a filter it would be pushed below the columns that it reads, which would be worked out again.
    at = safe & (F.col("rank") == F.col("top")) & (F.col("top") > 0) & F.col("year_lower").isNotNull() & F.col("year_upper").isNotNull()
    steady = F.col("cash") & F.col("recurring") & (F.col("inclusion") == "included")
    is_in = lambda *names: F.col("component").isin(*names)
    composed = is_in("fixed_base", "fixed_periodic", "commission", "variable", "bonus", "draw") & steady
    of = lambda what, c: F.when(at & what, F.col(c))
    every = F.lit(True)
    kinds, bounds = F.collect_set(of(every, "component")), F.collect_set(F.when(at, F.struct("component", "year_lower", "year_upper")))
    sums = records.groupBy("job_id").agg(
        F.min(of(every, "year_lower")).alias("lower_cents"), F.max(of(every, "year_upper")).alias("upper_cents"),
        F.max(of(steady, "year_upper")).alias("reference_cents"),
        F.max(of(steady & is_in("fixed_base", "fixed_periodic", "unlabeled_annual_pay", "draw"), "year_lower")).alias("proven_cents"),
        F.max(of((steady & is_in("total_cash", "other_total_compensation")) | (is_in("ote") & F.col("quote").rlike(CAPPED)), "year_upper")).alias("stated_total"),
        F.sum(of(composed, "year_upper")).alias("composed_total"),
        F.bool_or(at & composed & is_in("fixed_base", "fixed_periodic")).alias("has_fixed"),
        F.bool_or(at & composed & is_in("commission", "variable", "bonus", "draw")).alias("has_variable"),
        F.max(of(is_in("fixed_base"), "year_lower")).alias("highest_base"), F.min(of(is_in("ote"), "year_upper")).alias("lowest_ote"),
        (F.size(bounds) > F.size(kinds)).alias("disagree"), F.bool_or("unsafe").alias("unsafe"), F.count_if(safe).alias("n_records"),
    )
    told = cited.groupBy("job_id").agg(told_spans(F.col("question").startswith("S2.CP.")).alias("told"), F.bool_or((F.col("question") == "S2.CP.Q17") & F.col("quote").rlike(ALL_CASH)).alias("exhaustive"))
    row = reduce(lambda a, b: a.join(b, "job_id", "left"), [sums, told, yes_questions(answers)], with_spans(jobs, said=PAY_SAID)).withColumn("covered", covered(F.col("said"), F.col("told")))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    conflict = no("disagree") | F.coalesce(F.col("highest_base") > F.col("lowest_ote"), F.lit(False))
    uncovered = ~F.coalesce(F.col("covered"), F.lit(True))
    n = F.coalesce(F.col("n_records"), F.lit(0))
    state = F.when(conflict, "conflicting").when(uncovered | no("unsafe") | ((n > 0) & F.col("lower_cents").isNull()), "non_comparable").when(n == 0, "missing").otherwise("comparable")
    open_ended = F.coalesce(F.array_contains("yes", "S2.CP.Q11"), F.lit(False))
    whole = F.when(no("exhaustive") & no("has_fixed") & no("has_variable"), F.col("composed_total"))
    row = row.withColumn("state", state).withColumn("total_upper_cents", F.when(~open_ended, F.greatest("stated_total", whole)))
    floor = F.when((F.col("state") == "comparable") & F.col("total_upper_cents").isNotNull(), F.when(F.col("total_upper_cents") < policy.floor_cents, "below").otherwise("at_or_above")).otherwise("fail_open")
    best = F.greatest("reference_cents", "proven_cents")
    points = F.coalesce(*[F.when((F.col("state") == "comparable") & (best >= least), p) for least, p in policy.pay_tiers], F.lit(0))
    reason = F.when(conflict, "conflicting_disclosures").when(uncovered, "coverage_ambiguous").when(floor == "below", "complete_total_cash_below_floor").otherwise(F.col("state"))
    return row.select("job_id", "state", "lower_cents", "upper_cents", "total_upper_cents", "reference_cents", "proven_cents", floor.alias("floor_outcome"), points.alias("points"), reason.alias("reason"))


def clauses_of(policy: Policy):
    """Percentages that a quote states, as bounds; null where one is out of range, reversed or a decimal."""
    some = lambda words: "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
    pair = re.compile(rf"\b(\d{{1,3}})\s*(?:%|percent)?\s*(?:{some(policy.separators)})\s*(\d{{1,3}})\s*(?:%|percent)(?![^\W\d_])", re.I)
    one = re.compile(rf"(?:(?P<lower>{some(policy.lower_words)})|(?P<upper>{some(policy.upper_words)}))?\s*(?<!\d)(\d{{1,3}})\s*(?:%|percent)(?![^\W\d_])", re.I)
    decimal = re.compile(r"\b\d+\.\d+\s*(?:%|percent)(?![^\W\d_])", re.I)

    def read(t):
        if not t or decimal.search(t):
            return None if t else []
        out, taken = [], []
        for m in pair.finditer(t):
            low, high = int(m[1]), int(m[2])
            if low > high or high > 100:
                return None
            out.append({"lower": low, "upper": high, "lower_explicit": True, "upper_explicit": True})
            taken.append(m.span())
        for m in one.finditer(t):
            if any(a <= m.start() and m.end() <= b for a, b in taken):
                continue
            n = int(m[3])
            if n > 100:
                return None
            out.append({"lower": 0 if m["upper"] else n, "upper": 100 if m["lower"] else n, "lower_explicit": not m["upper"], "upper_explicit": not m["lower"]})
        return out

    @pandas_udf(CLAUSES)
    def clauses(s: pd.Series) -> pd.Series:
        return s.map(read)

    return clauses


def tier(value: Column, tiers: Sequence[tuple[int, int, int]]) -> Column:
    return F.coalesce(*[F.when(value.between(a, b), p) for a, b, p in tiers], F.lit(0))


def travel(jobs: DataFrame, answers: DataFrame, evidence: DataFrame, policy: Policy) -> DataFrame:
    """(job_id, state, positive, lower, upper, term, reach, intensity, field, points, reason): a row for each job.

    Stated percentages are bounds whose intersection counts; statements of no travel beside travel conflict; vague, conditional or uncited numbers are ambiguous and give no points.
    """
    cited = quotes(answers, evidence)
    is_q = lambda n: F.col("question") == f"S2.TR.Q{n:02d}"
    one = cited.withColumn("c", clauses_of(policy)(F.when(is_q(1), F.col("quote"))))
    told = one.groupBy("job_id").agg(
        F.flatten(F.collect_list(F.when(is_q(1), F.col("c")))).alias("clauses"), F.bool_or(is_q(1) & F.col("c").isNull()).alias("unread"),
        F.bool_or(is_q(1) & (F.col("quote").rlike(VAGUE) | F.col("quote").rlike(CONDITIONAL))).alias("vague"),
        F.lower(F.concat_ws("\n", F.collect_list(F.when(is_q(3), F.col("quote"))))).alias("words"), told_spans(is_q(1)).alias("told"), told_spans(is_q(2)).alias("told_none"))
    row = reduce(lambda a, b: a.join(b, "job_id", "left"), [told, yes_questions(answers)], with_spans(jobs, said=TRAVEL_SAID, said_none=NO_TRAVEL_SAID))
    row = row.withColumns({"covered": covered(F.col("said"), F.col("told")), "covered_none": covered(F.col("said_none"), F.col("told_none"))})
    row = row.withColumn("yes", F.coalesce("yes", F.array().cast("array<string>"))).withColumn("clauses", F.coalesce("clauses", F.array().cast(CLAUSES)))
    said = lambda q: F.array_contains("yes", q)
    lower, upper = F.array_max(F.transform("clauses", lambda c: c["lower"])), F.array_min(F.transform("clauses", lambda c: c["upper"]))
    row = row.withColumn("lo", lower).withColumn("hi", upper)
    row = row.withColumn("lo_said", F.exists("clauses", lambda c: c["lower_explicit"] & (c["lower"] == F.col("lo")))).withColumn("hi_said", F.exists("clauses", lambda c: c["upper_explicit"] & (c["upper"] == F.col("hi"))))
    lexemes = sorted((policy.lexemes or {}).items(), key=lambda kv: -kv[1])
    term = F.coalesce(*[F.when(F.contains(F.coalesce("words", F.lit("")), F.lit(w.lower())), w) for w, _ in lexemes], F.lit(None).cast("string"))
    stated = F.col("lo").isNotNull() & (F.col("lo") <= F.col("hi"))
    others = F.arrays_overlap("yes", F.array(*[F.lit(f"S2.TR.Q{n:02d}") for n in range(3, 14)]))
    row = row.withColumn("term", term).withColumn("stated", F.coalesce(stated, F.lit(False)))
    positive = others | (F.col("stated") & ((F.col("lo_said") & (F.col("lo") > 0)) | (F.col("hi_said") & (F.col("hi") > 0))))
    row = row.withColumn("positive", positive)
    zero = F.col("stated") & (F.col("lo") == 0) & (F.col("hi") == 0)
    ambiguous = ~F.coalesce("covered", F.lit(True)) | ~F.coalesce("covered_none", F.lit(True)) | F.coalesce("unread", F.lit(False)) | F.coalesce("vague", F.lit(False)) | (F.size("clauses") > 2)
    conflict = F.coalesce(F.col("lo") > F.col("hi"), F.lit(False)) | (said("S2.TR.Q02") & F.col("positive")) | (zero & others)
    state = F.when(ambiguous, "ambiguous").when(conflict, "conflicting").when(F.col("stated"), "comparable").when(F.col("term").isNotNull(), "qualitative").otherwise("missing")
    row = row.withColumn("state", state).withColumn("scored", ~F.col("state").isin("ambiguous", "conflicting"))
    first = lambda tiers, rest: F.coalesce(*[F.when(said(q), p) for q, p in tiers], F.when(F.col("positive"), rest).otherwise(0))
    bound = F.greatest(F.when(F.col("lo_said"), tier(F.col("lo"), policy.lower_tiers)).otherwise(0), F.when(F.col("hi_said"), tier(F.col("hi"), policy.upper_tiers)).otherwise(0))
    by_word = F.coalesce(*[F.when(F.col("term") == w, p) for w, p in lexemes], F.lit(0))
    intensity = F.when(F.col("stated"), bound).when(F.col("term").isNotNull(), by_word).when(F.col("positive"), policy.other_travel).otherwise(0)
    only = lambda c: F.when(F.col("scored"), c).otherwise(0)
    row = row.withColumn("reach", only(first(REACH, 2))).withColumn("field", only(first(FIELD, 1))).withColumn("intensity", only(intensity))
    reason = F.when(F.col("state") == "ambiguous", "travel_coverage_or_numeric_ambiguous").when(F.col("state") == "conflicting", "travel_source_conflict").when(F.col("positive"), "travel_scored").when(said("S2.TR.Q02") | zero, "explicit_zero_travel").otherwise("travel_not_supported")
    shown = F.col("stated") & (F.col("state") != "ambiguous")
    return row.select("job_id", "state", (F.col("scored") & F.col("positive")).alias("positive"), F.when(shown, F.col("lo")).alias("lower"), F.when(shown, F.col("hi")).alias("upper"), "term", "reach", "intensity", "field", F.least(F.lit(MOST_TRAVEL_POINTS), F.col("reach") + F.col("intensity") + F.col("field")).alias("points"), reason.alias("reason"))


def local_triggers(company: Column, policy: Policy) -> Column:
    """Codes of the triggers whose company names the employer has, in trigger order."""
    name = text.employer(company)
    tests = [F.when(name.isin([text.employer_text(a) for a in names]), F.lit(code)) for code, names in (policy.aliases or {}).items()]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def has_any(t: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(w.lower())) for w in words], F.lit(False))


def agency_state(quoted: Column, company: Column, location: Column, policy: Policy) -> Column:
    """local_agency, not_local_or_not_agency or unknown, by quotes in lower case and the employer."""
    local = has_any(quoted, policy.local_words) | places.any_kind(quoted, ["near"])
    known = text.employer(company).isin([text.employer_text(a) for a in policy.agency_aliases] or [""]) & F.coalesce(places.any_kind(location, ["near"]), F.lit(False))
    wide = quoted.rlike(r"\b(?:national|nationwide|multi-state|global)\b")
    weak = F.when(has_any(quoted, policy.weak_agency_words), "not_local_or_not_agency").otherwise("unknown")
    return F.when(~has_any(quoted, policy.agency_words), weak).when(local | known, "local_agency").when(wide, "not_local_or_not_agency").otherwise("unknown")


def screened(jobs: DataFrame, answers: DataFrame, evidence: DataFrame, policy: Policy) -> DataFrame:
    """(job_id, local_codes, questions, location_state, agency_state): what a first screen finds in the answers, questions in the order of policy.kills and then the agency's."""
    quoted = quotes(answers, evidence).where(F.col("question") == policy.agency_question).groupBy("job_id").agg(F.lower(F.concat_ws("\n", F.collect_list("quote"))).alias("quoted"))
    row = jobs.join(yes_questions(answers), "job_id", "left").join(quoted, "job_id", "left").withColumn("yes", F.coalesce("yes", F.array().cast("array<string>")))
    agency = F.when(F.array_contains("yes", policy.agency_question), agency_state(F.coalesce("quoted", F.lit("")), F.col("company"), F.col("location"), policy))
    row = row.withColumn("agency_state", agency)
    found = F.array_compact(F.array(*[F.when(F.array_contains("yes", q), F.lit(q)) for q in policy.kills], F.when(F.col("agency_state") == "local_agency", F.lit(policy.agency_question))))
    return row.select("job_id", local_triggers(F.col("company"), policy).alias("local_codes"), found.alias("questions"), F.when(F.array_contains("yes", policy.base_question), "incompatible").alias("location_state"), "agency_state")


def results(jobs: DataFrame, answers: DataFrame, evidence: DataFrame, holistic: DataFrame, policy: Policy, final: bool = True) -> DataFrame:
    """(job_id, variant, decision, codes, score, band, rationale): a row for each job.

    A local trigger ends it, then a factual screen; a final pass gives the rest the holistic score (job_id, score, rationale) and its band, and fails to `no_score` or `no_band` without. A pass that isn't final only lets them continue.
    """
    row = screened(jobs, answers, evidence, policy).join(holistic.select("job_id", F.col("score").alias("s"), "rationale"), "job_id", "left")
    band = F.coalesce(*[F.when(F.col("s").between(low, high), F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"))) for code, label, low, high in policy.bands], F.lit(None).cast("struct<code:string,label:string>"))
    row = row.withColumn("b", band)
    rest = F.when(F.lit(not final), "continue_to_complete").when(F.col("s").isNull(), "no_score").when(F.col("b").isNull(), "no_band").otherwise("scored_survivor")
    variant = F.when(F.size("local_codes") > 0, "local_policy_kill").when(F.size("questions") > 0, "factual_screen_kill").otherwise(rest)
    row = row.withColumn("variant", variant)
    decision = F.when(F.col("variant") == "local_policy_kill", "killed_local_policy").when(F.col("variant") == "factual_screen_kill", "killed_by_factual_screen").otherwise(F.col("variant"))
    codes = F.when(F.col("variant") == "local_policy_kill", F.col("local_codes")).when(F.col("variant") == "factual_screen_kill", F.col("questions"))
    good = F.col("variant") == "scored_survivor"
    return row.select("job_id", "variant", decision.alias("decision"), codes.alias("codes"), F.when(good, F.col("s")).alias("score"), F.when(good, F.col("b")).alias("band"), F.when(good, F.col("rationale")).alias("rationale"))


#: A whole life cycle's fact also answers its two ends.
WHOLE_CYCLE, LATE_END, EARLY_ENDS = "S2.CML.Q15", "S2.CML.Q14", ("S2.CML.Q02", "S2.CML.Q06")


def projected(answers: DataFrame, crosswalk: DataFrame, kept_prefix: str = "S1.") -> DataFrame:
    """(job_id, question, answer, evidence): answers of the first stage as they are, and derived facts: yes if any source question is, with the sources' evidence once each in order.

    crosswalk: (pos, source, target). A job's fact without a yes is `unsupported`.
    """
    jobs = answers.select("job_id").distinct()
    facts = crosswalk.groupBy("target").agg(F.min("pos").alias("pos"))
    yes = answers.where("answer = 'yes'").join(F.broadcast(crosswalk), F.col("question") == F.col("source"))
    told = yes.groupBy("job_id", "target").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "evidence"))), lambda x: x["evidence"])).alias("e"))
    every = jobs.select("job_id", F.explode(F.array(*[F.lit(r.target) for r in facts.select("target").orderBy("target").collect()])).alias("target"))
    made = every.join(told, ["job_id", "target"], "left").select("job_id", F.col("target").alias("question"), F.when(F.col("e").isNotNull(), "yes").otherwise("unsupported").alias("answer"), F.array_distinct(F.coalesce("e", F.array().cast("array<string>"))).alias("evidence"))
    cycle = told.where(F.col("target") == WHOLE_CYCLE).select("job_id", F.array_distinct("e").alias("whole"))
    early = told.where(F.col("target").isin(*EARLY_ENDS)).select("job_id").distinct().withColumn("has_early", F.lit(True))
    closed = made.join(cycle, "job_id", "left").join(early, "job_id", "left")
    takes = F.col("whole").isNotNull() & (F.col("answer") != "yes") & ((F.col("question") == LATE_END) | ((F.col("question") == EARLY_ENDS[0]) & F.col("has_early").isNull()))
    derived = closed.select("job_id", "question", F.when(takes, "yes").otherwise(F.col("answer")).alias("answer"), F.when(takes, F.col("whole")).otherwise(F.col("evidence")).alias("evidence"))
    return answers.where(F.col("question").startswith(kept_prefix)).select("job_id", "question", "answer", "evidence").unionByName(derived)


def dollars(amount: Column, currency: Column) -> Column:
    shown = F.format_number(amount, 0)
    return F.when(currency == "USD", F.concat(F.lit("$"), shown)).when(F.coalesce(currency, F.lit("")) != "", F.concat_ws(" ", currency, shown)).otherwise(shown)


def range_of(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.when(low == high, low).otherwise(F.concat_ws("–", low, high))).otherwise(F.coalesce(low, high))


def pay_label(state: Column, lower_cents: Column, upper_cents: Column, currency: Column, reason: Column) -> Column:
    """What a reader sees of an assessed pay: its yearly range, or why there is none."""
    shown = range_of(dollars(lower_cents / 100, currency), dollars(upper_cents / 100, currency))
    why = F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit("Compensation stated · "), F.regexp_replace(reason, "_", " "))).otherwise("Compensation stated")
    return F.when(shown.isNotNull(), F.concat(shown, F.lit("/annual"))).when(state == "missing", None).otherwise(why)


def travel_label(state: Column, lower: Column, upper: Column, lower_said: Column, upper_said: Column, term: Column) -> Column:
    """struct<kind, minimum, maximum, label> of an assessed travel."""
    kind = F.when(state == "missing", "none").when(lower == upper, "point").when(~lower_said & upper_said, "maximum").when(lower_said & ~upper_said, "minimum").when(lower.isNotNull() & upper.isNotNull(), "range").when(F.coalesce(term, F.lit("")) != "", "qualitative")
    percent = lambda *c: F.concat(*c, F.lit("%"))
    label = F.when(kind == "none", "Not stated").when(kind == "point", percent(lower.cast("string"))).when(kind == "maximum", percent(F.lit("Up to "), upper.cast("string"))).when(kind == "minimum", percent(F.lit("At least "), lower.cast("string"))).when(kind == "range", percent(lower.cast("string"), F.lit("–"), upper.cast("string"))).when(kind == "qualitative", term)
    least = F.when(kind.isin("none", "maximum", "qualitative"), 0).otherwise(lower)
    most = F.when(kind.isin("none", "qualitative"), 0).when(kind == "minimum", 100).otherwise(upper)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), least.alias("minimum"), most.alias("maximum"), label.alias("label")))
