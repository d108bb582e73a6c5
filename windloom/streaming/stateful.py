"""Keyed state with timers: staged imports and login locks that leave the state store when they have run out.

Time is event time. A timer fires when the watermark has passed it, so a state is cleared only when no row that could still
meet it may come; rows later than the watermark are dropped by Spark. State is kept by the state store provider (RocksDB),
not in memory, so the number of keys isn't bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from windloom.streaming.lockout import WINDOW_MS, transition
from windloom.streaming.staging import STAGED_US

#: transformWithState needs this provider: ``spark.conf.set(*STATE_STORE)``.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """A key's rows of one batch by time, then id."""
    return pd.concat(list(rows)).sort_values(columns[:2])[columns].itertuples(index=False)  # of one key and batch


class StagedImports(StatefulProcessor):
    """The latest staged import of a handle, until it is committed or 30 minutes have passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.staged = handle.getValueState("staged", "at long, project long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        staged, results = self.staged.get(), []
        for at, row, project, stages in _in_order(rows, ["at", "id", "project", "staged"]):
            if stages:
                staged = (int(at), int(project))
                continue
            live = staged is not None and at - staged[0] <= STAGED_US
            result = "EXPIRED" if not live else "OTHER_PROJECT" if project != staged[1] else "COMMITTED"
            staged = None if result == "COMMITTED" else staged
            results.append((key[0], int(row), int(at), result))
        if staged is None:
            self.staged.clear()
        else:
            self.staged.update(tuple(staged))
            self.handle.registerTimer(_last_ms(staged[0]) + 1)
        yield pd.DataFrame(results, columns=["handle", "id", "at", "result"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        staged = self.staged.get()
        if staged is not None and _last_ms(staged[0]) < expiredTimerInfo.getExpiryTimeInMs():  # not one staged since
            self.staged.clear()
        return iter(())


def _last_ms(at: int) -> int:
    return (at + STAGED_US) // 1000


def staged_commits(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Commits and their results, as ``staging.settle`` gives them, of a stream (handle, at in microseconds, id, project, staged)."""
    rows = stream.withColumn("time", F.timestamp_micros("at")).withWatermark("time", late)
    return rows.groupBy("handle").transformWithStateInPandas(StagedImports(), "handle long, id long, at long, result string", "append", "EventTime")


class LoginLocks(StatefulProcessor):
    """The failures of a user and the end of the lock, until both have run out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lock = handle.getValueState("lock", "failures array<long>, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.lock.get()
        failures, until, refused = (list(held[0]), held[1], []) if held is not None else ([], 0, [])
        for at, event, failed in _in_order(rows, ["at", "event_id", "failed"]):
            failures, until, no = transition(failures, until, int(at), bool(failed))
            if no:
                refused.append((key[0], int(event), int(at)))
        if failures or until:
            self.lock.update((failures, until))
            self.handle.registerTimer(_runs_out(failures, until))
        else:
            self.lock.clear()
        yield pd.DataFrame(refused, columns=["user_id", "event_id", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.lock.get()
        if held is not None and _runs_out(list(held[0]), held[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.lock.clear()
        return iter(())


def _runs_out(failures: list[int], until: int) -> int:
    return max([until, *(t + WINDOW_MS for t in failures)])


def locked_attempts(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Attempts refused under a lock, as ``lockout.refused_attempts`` gives them, of a stream (user_id, at in milliseconds, failed, event_id)."""
    rows = stream.withColumn("time", F.timestamp_millis("at")).withWatermark("time", late)
    return rows.groupBy("user_id").transformWithStateInPandas(LoginLocks(), "user_id long, event_id long, at long", "append", "EventTime")
