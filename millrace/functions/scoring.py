"""Score arithmetic over arrays of criteria and tables of signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.rates import half_up


def criterion_score(criteria: Column) -> Column:
    """struct<uncapped, score, cap, label> of array<struct<classification, outcome, neutral>>.

    Required criteria weigh 80, preferred ones 20 (100 without preferred ones); the worst required outcome caps the score.
    """
    value = lambda c: F.when(c["outcome"] == "direct", 1.0).when(c["outcome"] == "partial", 0.5).otherwise(0.0)
    counted = F.filter(criteria, lambda c: ~F.coalesce(c["neutral"], F.lit(False)) & (c["outcome"] != "excluded"))
    of = lambda kind: F.filter(counted, lambda c: c["classification"] == kind)
    ratio = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, c: a + value(c)) / F.size(xs)).otherwise(0.0)
    required, preferred = of("required"), of("preferred")
    raw = F.when(F.size(counted) == 0, F.lit(100.0)).when(F.size(preferred) == 0, ratio(required) * 100).otherwise(ratio(required) * 80 + ratio(preferred) * 20)
    uncapped = F.greatest(F.lit(0), F.least(F.lit(100), half_up(raw))).cast("int")
    worst = lambda o: F.exists(required, lambda c: c["outcome"] == o)
    cap = F.when(worst("does_not_meet"), 59).when(worst("cannot_evaluate"), 69).when(worst("partial"), 79)
    label = F.when(worst("does_not_meet"), "Does not meet").when(worst("cannot_evaluate"), "Verification needed").when(worst("partial"), "Partially qualified").otherwise("Fully qualified")
    return F.struct(uncapped.alias("uncapped"), F.least(uncapped, cap).alias("score"), cap.alias("cap"), label.alias("label"))


def compound_outcome(operator: Column, outcomes: Column) -> Column:
    """Outcome of a criterion from its parts: the best of them for `any`, the worst for `all` and `single`."""
    order = ("direct", "partial", "cannot_evaluate", "does_not_meet")
    has = lambda o: F.array_contains(outcomes, o)
    best = F.coalesce(*[F.when(has(o), o) for o in order])
    worst = F.coalesce(*[F.when(has(o), o) for o in reversed(order)])
    return F.when(operator == "any", best).otherwise(worst)


def preferred_points(outcomes: Column) -> Column:
    """Up to 20 points for preferred criteria, halves rounded up, in whole numbers."""
    n = F.size(outcomes)
    units = F.aggregate(outcomes, F.lit(0), lambda a, o: a + F.when(o == "direct", 2).when(o == "partial", 1).otherwise(0))
    return F.when(n <= 0, 0).otherwise(F.floor((20 * units + n) / (2 * n))).cast("int")


def experience_decision(criteria: Column) -> Column:
    """struct<decision, score, points> of array<struct<classification, category, outcome>>: any required one that isn't direct blocks."""
    active = F.filter(criteria, lambda c: ~c["category"].isin("administrative", "subjective_boilerplate"))
    blocked = F.exists(active, lambda c: (c["classification"] == "required") & (c["outcome"] != "direct"))
    points = preferred_points(F.transform(F.filter(active, lambda c: c["classification"] == "preferred"), lambda c: c["outcome"]))
    return F.struct(F.when(blocked, "hard_requirement_not_fully_supported").otherwise("qualified").alias("decision"), F.when(~blocked, points + 80).alias("score"), F.when(~blocked, points).alias("points"))


def signal_points(text: Column, signals: Sequence[tuple[str, str, int, int]], most: int) -> Column:
    """struct<points, kinds, hits>: for (name, pattern, weight, count at most), matches up to the count times the weight, in all at most `most`."""
    counts = [F.regexp_count(text, F.lit(f"(?i){p}")) for _, p, _, _ in signals]
    points = sum((F.least(n, F.lit(top)) * w for n, (_, _, w, top) in zip(counts, signals)), F.lit(0))
    kinds = sum((F.when(n > 0, 1).otherwise(0) for n in counts), F.lit(0))
    hits = sum(counts, F.lit(0))
    return F.struct(F.least(points, F.lit(most)).alias("points"), kinds.alias("kinds"), hits.alias("hits"))


def resume_points(job_tokens: Column, resume_tokens: Column, most: int = 24) -> Column:
    """Points for the share of a posting's tokens (at most 200 count) that a resume has."""
    shared = F.size(F.array_intersect(job_tokens, resume_tokens))
    return half_up(F.least(F.lit(float(most)), 100.0 * shared / F.greatest(F.lit(1), F.least(F.size(job_tokens), F.lit(200))))).cast("int")


def heuristic_score(base: int, plus: Sequence[Column], minus: Sequence[Column], cap: Column | None = None) -> Column:
    """Base plus and minus parts, held within 0 and 100 and under a cap where there is one."""
    raw = sum(plus, F.lit(base)) - sum(minus, F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), raw, cap if cap is not None else F.lit(100))).cast("int")


def banded(df: DataFrame, score: str, bands: Sequence[tuple[int, str]], name: str = "band") -> DataFrame:
    """Adds the name of the highest band whose floor the score reaches."""
    tests = [F.when(F.col(score) >= floor, label) for floor, label in sorted(bands, reverse=True)]
    return df.withColumn(name, F.coalesce(*tests))
