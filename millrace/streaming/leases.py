"""Leases told from a log of claims, renewals and completions: who held a task, from when until when, and how that ended.

A claim is granted where the task is due and nobody holds it. A lease lasts so many minutes after its claim or its last renewal. A renewal counts if
its token is the last one granted, also after the lease has run out, if nobody else has claimed since: the task is then held anew from
there. A completion by that token ends the lease, and the task is due again so many minutes later. All else is refused and leaves no trace.
Stream and batch take the same steps, one event after the other in time and order of the log's ids, and hold one state a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "token string, started long, expires long, due long, told boolean"
HELD = "token string, started timestamp, ended timestamp, why string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000_000


@dataclass
class Lease:
    """A task's state; times are microseconds. told: that the lease ran out has been reported."""

    token: str | None = None
    started: int = 0
    expires: int = 0
    due: int = -(1 << 62)
    told: bool = False

    def step(self, at: int, kind: str, token: str, lease: int, rest: int) -> tuple | None:
        """Takes an event; what it ends: (token, started, ended, why)."""
        alive, mine = self.token is not None and self.expires > at, self.token is not None and self.token == token
        ran_out = (self.token, self.started, self.expires, "expired") if self.token is not None and not alive and not self.told else None
        if kind == "claim" and at >= self.due and not alive:
            self.token, self.started, self.expires, self.told = token, at, at + lease, False
            return ran_out
        if kind == "renew" and mine:
            self.expires = at + lease
            if alive:
                return None
            self.started, self.told = at, False
            return ran_out
        if kind == "complete" and mine:
            ended = (self.token, self.started, at, "completed") if alive else ran_out
            self.token, self.due, self.told = None, at + rest, False
            return ended
        return None

    def run_out(self, now: int) -> tuple | None:
        """The lease, if it has run out by now and that has not been told."""
        if self.token is None or self.told or self.expires > now:
            return None
        self.told = True
        return self.token, self.started, self.expires, "expired"


def frame(task, rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["token", "started", "ended", "why"])
    for c in ("started", "ended"):
        made[c] = pd.to_datetime(made[c], unit="us")
    made.insert(0, "task", task)
    return made


def micros(at: pd.Series) -> list[int]:
    return at.astype("datetime64[us]").astype("int64").tolist()


def schema_of(log: DataFrame) -> T.StructType:
    return T.StructType([log.schema["task"], *T.StructType.fromDDL(HELD)])


def lease_history(log: DataFrame, lease_minutes: int, rest_minutes: int, until: Any = None) -> DataFrame:
    """(task, token, started, ended, why) of a whole log (task, at, id, kind, token): completed and expired leases; those that run on after `until` (default: never) are open, to their present end.

    A task's events come one by one in sorted order, so that a task's log is never held. Rows without task, time, kind or token are left out.
    """
    schema = schema_of(log)
    last = None if until is None else int(pd.Timestamp(until).value // 1000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, state = None, Lease()

        def close(rows: dict) -> None:
            if state.token is not None and not state.told:
                why = "expired" if last is None or state.expires <= last else "open"
                rows.setdefault(task, []).append((state.token, state.started, state.expires, why))

        for batch in batches:
            rows: dict = {}
            for t, at, kind, token in zip(batch.task.tolist(), micros(batch["at"]), batch.kind.tolist(), batch.token.tolist()):
                if t != task:
                    close(rows)
                    task, state = t, Lease()
                ended = state.step(at, kind, token, lease_minutes * MINUTE, rest_minutes * MINUTE)
                if ended:
                    rows.setdefault(t, []).append(ended)
            yield from (frame(t, found) for t, found in rows.items())
        rows = {}
        close(rows)
        yield from (frame(t, found) for t, found in rows.items())

    sent = log.dropna(subset=["task", "at", "kind", "token"]).select("task", "at", "id", "kind", "token")
    return sent.repartition("task").sortWithinPartitions("task", "at", "id").drop("id").mapInPandas(run, schema)


class Replay(StatefulProcessor):
    """The same steps on a stream; a timer at a lease's end reports it when the watermark has passed."""

    def __init__(self, lease_minutes: int, rest_minutes: int):
        self.lease, self.rest = lease_minutes * MINUTE, rest_minutes * MINUTE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", STATE)

    def load(self) -> Lease:
        return Lease(*self.state.get()) if self.state.exists() else Lease()

    def keep(self, lease: Lease) -> None:
        self.state.update((lease.token, lease.started, lease.expires, lease.due, lease.told))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        lease, out = self.load(), []
        for at, kind, token in zip(micros(events["at"]), events.kind.tolist(), events.token.tolist()):
            ended = lease.step(at, kind, token, self.lease, self.rest)
            if ended:
                out.append(ended)
        self.keep(lease)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if lease.token is not None and not lease.told:
            self.handle.registerTimer(-(-lease.expires // 1000))
        if out:  # a frame takes longer than all steps of most keys
            yield frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        lease = self.load()
        ended = lease.run_out(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self.keep(lease)
        if ended:
            yield frame(key[0], [ended])

    def close(self) -> None:
        pass


def lease_stream(log: DataFrame, lease_minutes: int, rest_minutes: int, late: str = "1 hour") -> DataFrame:
    """lease_history() as a stream: leases come out when they end or the watermark, `late` behind the newest event, passes their end. Events later than that are dropped."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    sent = log.dropna(subset=["task", "at", "kind", "token"]).select("task", "at", "id", "kind", "token").withWatermark("at", late)
    return sent.groupBy("task").transformWithStateInPandas(Replay(lease_minutes, rest_minutes), schema_of(log), "Append", "EventTime")
