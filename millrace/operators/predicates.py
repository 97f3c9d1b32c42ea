"""Row predicates of the posting views, as columns."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_text(a: Column, b: Column | str) -> Column:
    """Case-insensitive equality of trimmed texts."""
    b = F.lit(b) if isinstance(b, str) else b
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def terms_of(query: str, most: int = 8, shortest: int = 2) -> list[str]:
    """A query's words, at most eight; a query of under two letters has none."""
    return query.lower().split()[:most] if len(query.strip()) >= shortest else []


def matches_all(query: str, columns: list[str]) -> Column:
    """Every word of the query is found in some column, whatever its case; an empty query finds nothing."""
    words = terms_of(query)
    if not words:
        return F.lit(False)
    return reduce(and_, [reduce(or_, [F.coalesce(F.lower(c).contains(w), F.lit(False)) for c in columns]) for w in words])


def not_containing(column: str, text: str) -> Column:
    """A null is kept: a text that isn't there doesn't contain anything."""
    return F.col(column).isNull() | ~F.lower(column).contains(text.lower())


def json_flag(column: str, name: str) -> Column:
    """Whether a JSON object has the field with the boolean true; the string "true", other values and bad JSON don't count."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(column), f"$.{name}", "boolean") & (F.schema_of_variant(F.try_variant_get(F.try_parse_json(column), f"$.{name}", "variant")) == "BOOLEAN"), F.lit(False))


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def having(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows with a match on the other side."""
    return df.join(other.select(key), key, "left_semi")


def lacking(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows without one."""
    return df.join(other.select(key), key, "left_anti")


#: The statuses of each view.
DECIDED = ("applied", "passed", "cooldown", "interviewing")
VIEWS = ("inbox", "applied", "interviewing", "passed", "bookmarked", "cooldown", "expired", "dismissed", "archived", "pending_af")


def view(name: str) -> Column:
    """The rows of a named view over (status, scoring_status, fit_score)."""
    status, scoring, score = F.col("status"), F.col("scoring_status"), F.col("fit_score")
    rules = {
        "needs_jd": (status == "pending_af") & (scoring == "needs_jd"),
        "local_scoring": (status == "pending_af") & scoring.isin("queued", "scoring"),
        "action_needed": (status == "pending_af") & (scoring == "failed"),
        "aim_fit": (status == "pending_af") & (scoring == "scored") & score.isNull(),
        "experience_fit": (status == "pending_af") & (scoring == "scored") & score.isNotNull(),
        "scored_inbox": (status == "inbox") & score.isNotNull(),
    }
    return rules[name] if name in rules else status == name


def priority_order() -> list[Column]:
    """Best score first, unscored last, then newest, then id."""
    return [F.col("fit_score").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id").asc()]
