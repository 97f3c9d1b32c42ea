"""Queries whose main path is a stream: events arrive in turns, each worked off by a run that starts from the last one's checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import query
from millrace.plans.statistics import events
from millrace.streaming import leases, ledger
from millrace.tables import shared_path

LEASE, REST, LATE = 300, 180, "1 hour"
TURNS = 3


def stamp(c: str) -> Column:
    """Streams take instants alone."""
    return F.col(c).cast("timestamp")


def plain(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def in_turns(rows: DataFrame, at: str, folder: str, work: Callable[[DataFrame], None], turns: int = TURNS, overlap: Column | None = None) -> None:
    """Writes rows to the folder in turns of their time, the rows of `overlap` in the next turn again, and calls work with a stream over the folder after each."""
    spark = rows.sparkSession
    bounds = rows.agg(F.percentile_approx(at, [k / turns for k in range(1, turns)], 1000)).first()[0] or []
    for k, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
        turn = F.lit(True)
        if low is not None:
            again = F.lit(False) if overlap is None else overlap & (F.col(at) > F.lit(low) - F.expr("INTERVAL 1 HOUR"))
            turn &= (F.col(at) > low) | again
        if high is not None:
            turn &= F.col(at) <= high
        rows.where(turn).write.parquet(f"{folder}/turn={k}")
        work(ledger.folder_stream(spark, f"{folder}/*", rows.schema))


LOG_SQL = "SELECT user_id AS task, ts AS stamp, event_id AS id, CASE event_type WHEN 'click' THEN 'renew' WHEN 'purchase' THEN 'complete' ELSE 'claim' END AS kind, 'w' || (event_id % 2) AS token FROM events"
#: One step of the log after the other for every task.
LEASES_SQL = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY stamp, id) AS n FROM ({LOG_SQL})),
f AS (SELECT DISTINCT task, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS token, CAST(NULL AS TIMESTAMP) AS started, CAST(NULL AS TIMESTAMP) AS expires, TIMESTAMP '1970-01-01' AS due, CAST(NULL AS VARCHAR) AS x_token, CAST(NULL AS TIMESTAMP) AS x_started, CAST(NULL AS TIMESTAMP) AS x_ended, CAST(NULL AS VARCHAR) AS x_why FROM e
UNION ALL SELECT task, n, CASE WHEN take THEN new WHEN done THEN NULL ELSE token END, CASE WHEN take OR (renewed AND NOT alive) THEN stamp WHEN done THEN NULL ELSE started END,
  CASE WHEN take OR renewed THEN stamp + INTERVAL {LEASE} MINUTE WHEN done THEN NULL ELSE expires END, CASE WHEN done THEN stamp + INTERVAL {REST} MINUTE ELSE due END,
  CASE WHEN ends THEN token END, CASE WHEN ends THEN started END, CASE WHEN ends THEN CASE WHEN done AND alive THEN stamp ELSE expires END END, CASE WHEN ends THEN CASE WHEN done AND alive THEN 'completed' ELSE 'expired' END END
FROM (SELECT *, (take AND token IS NOT NULL) OR (renewed AND NOT alive) OR done AS ends FROM (SELECT *, kind = 'claim' AND stamp >= due AND NOT alive AS take, kind = 'renew' AND mine AS renewed, kind = 'complete' AND mine AS done
  FROM (SELECT e.task, e.n, e.stamp, e.kind, e.token AS new, f.token, f.started, f.expires, f.due, coalesce(f.expires > e.stamp, false) AS alive, coalesce(f.token = e.token, false) AS mine FROM f JOIN e ON e.task = f.task AND e.n = f.n + 1)))),
o AS (SELECT task, x_token AS token, x_started AS started, x_ended AS ended, x_why AS why FROM f WHERE x_why IS NOT NULL
UNION ALL SELECT task, token, started, expires, 'last' FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC) AS r FROM f) WHERE r = 1 AND token IS NOT NULL)"""


def lease_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: users are tasks, clicks renew, purchases complete, all else claims, for one of two tokens."""
    kind = F.when(F.col("event_type") == "click", "renew").when(F.col("event_type") == "purchase", "complete").otherwise("claim")
    return events(spark, sf_dir).select(F.col("user_id").alias("task"), stamp("ts").alias("at"), F.col("event_id").alias("id"), kind.alias("kind"), F.concat(F.lit("w"), F.col("event_id") % 2).alias("token"))


@query(f"{LEASES_SQL} SELECT task, token, started, ended, CASE WHEN why <> 'last' THEN why WHEN ended <= TIMESTAMP '2024-01-30' THEN 'expired' ELSE 'open' END AS why FROM o")
def lease_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(leases.lease_history(lease_log(spark, sf_dir), LEASE, REST, "2024-01-30"), "started", "ended")


@query(f"{LEASES_SQL} SELECT task, token, started, ended, CASE why WHEN 'last' THEN 'expired' ELSE why END AS why FROM o WHERE why <> 'last' OR date_trunc('millisecond', ended + INTERVAL 999 MICROSECOND) <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)")
def lease_history_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that is stopped and started again: leases that have ended, and those whose end the watermark has passed."""
    folder, out, progress = (shared_path(spark, f"lease-{k}") for k in ("log", "ends", "progress"))

    def work(log: DataFrame) -> None:
        made = leases.lease_stream(log, LEASE, REST, LATE)
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    in_turns(lease_log(spark, sf_dir), "at", folder, work)
    return plain(spark.read.schema(leases.schema_of(lease_log(spark, sf_dir))).parquet(out), "started", "ended")


@query("SELECT event_id, user_id, event_type, ts FROM events")
def streamed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in turns, the last hour's purchases and errors again in the next turn; then the whole input once more from the beginning. The ledger has each once."""
    folder, out, progress, again = (shared_path(spark, f"ledger-{k}") for k in ("in", "out", "progress", "again"))
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", stamp("ts").alias("ts"))
    sink = ledger.append_new(out, "event_id", "ts")
    in_turns(rows, "ts", folder, lambda s: ledger.run_available(ledger.once_per_key(s, "event_id", "ts"), sink, progress), overlap=F.col("event_type").isin("purchase", "error"))
    ledger.run_available(ledger.folder_stream(spark, f"{folder}/*", rows.schema), sink, again)
    return plain(spark.read.parquet(out).select(rows.columns), "ts")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT * FROM h WHERE "end" <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOURS FROM events)""")
def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events that arrive in turns, of the hours that the watermark has closed."""
    folder, out, progress = (shared_path(spark, f"counts-{k}") for k in ("in", "out", "progress"))
    rows = events(spark, sf_dir).select("event_id", "event_type", stamp("ts").alias("ts"))

    def work(stream: DataFrame) -> None:
        ledger.windowed_counts(stream, "ts", "event_type").writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    in_turns(rows, "ts", folder, work)
    return plain(spark.read.schema("start timestamp, end timestamp, event_type string, n long").parquet(out), "start", "end")
