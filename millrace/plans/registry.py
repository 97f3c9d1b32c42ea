"""Where queries are registered, each with the SQL that says what it returns, if SQL can."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from millrace.tables import let_workers_import

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, which no other query may have."""

    def keep(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            let_workers_import(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep
