"""What edits of jobs make stale, ledger by ledger."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ledgers whose rows depend on a job, and the fields of which one must have changed (none: whatever changed); a user's decisions.
DEPENDS: dict[str, tuple[str, ...]] = {"event": (), "artifact": (), "extraction": ("description", "title", "company", "location")}
DECISIONS = ("user_promote", "user_reject", "user_lifecycle")


def reason(fields: Column) -> Column:
    """What changed, by name; a change without fields is a forced one."""
    named = F.array_join(F.array_sort(F.array_distinct(fields)), ",")
    return F.concat(F.lit("job-input-edited:"), F.coalesce(F.nullif(named, F.lit("")), F.lit("forced_rescore")))


def cascade(changes: DataFrame, ledgers: Mapping[str, DataFrame], items: DataFrame, batches: DataFrame, jobs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(ledger, id, job_id, action, reason): what follows from changes (job_id, fields; one row a job), each with the job that caused it.

    ledgers: the tables of DEPENDS (id, job_id, stale_at); `event` also created_at and projection. Their rows that are still valid become `stale`. items
    (batch_id, job_id, status) and batches (id, status): exported batches with a leased item of a changed job are `superseded`, by the least such job.
    jobs (id, status, staged) and decisions (job_id, event_type): a job that stands where its newest valid event put it, not staged and not decided by
    a user, is `requeued`. Marked rows are valid no more, so that the same changes again give nothing for them. Ids come as text.
    """
    caused = changes.select("job_id", F.coalesce("fields", F.array().cast("array<string>")).alias("fields")).withColumn("reason", reason(F.col("fields")))
    row = lambda df, ledger, id_, action: df.select(F.lit(ledger).alias("ledger"), F.col(id_).cast("string").alias("id"), "job_id", F.lit(action).alias("action"), "reason")
    out = []
    for ledger, fields in DEPENDS.items():
        touched = caused.where(F.arrays_overlap("fields", F.array(*map(F.lit, fields)))) if fields else caused
        out.append(row(ledgers[ledger].where("stale_at IS NULL").select("id", "job_id").join(touched, "job_id"), ledger, "id", "stale"))
    held = items.where("status = 'leased'").join(batches.where("status = 'exported'").select(F.col("id").alias("batch_id")), "batch_id").join(caused, "job_id")
    first = held.groupBy("batch_id").agg(F.min(F.struct("job_id", "reason")).alias("c")).select("batch_id", "c.job_id", "c.reason")
    out.append(row(first, "batch", "batch_id", "superseded"))
    newest = ledgers["event"].where("stale_at IS NULL").groupBy("job_id").agg(F.max(F.struct("created_at", "id", "projection")).alias("e"))
    put = jobs.where(~F.coalesce("staged", F.lit(False))).select(F.col("id").alias("job_id"), "status").join(caused, "job_id").join(newest, "job_id").where(F.col("status") == F.col("e.projection"))
    put = put.join(decisions.where(F.col("event_type").isin(*DECISIONS)).select("job_id").distinct(), "job_id", "left_anti")
    out.append(row(put.withColumn("own", F.col("job_id")), "job", "own", "requeued"))
    return reduce(DataFrame.unionByName, out)
