"""Stateful streams: failed-login lockout and the latest state of each job."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Failures that lock, the window they must fall into and the lock's duration, in milliseconds.
MAX_FAILURES, WINDOW_MS, LOCK_MS = 5, 900_000, 900_000


def transition(failures: list[int], locked_until: int, at: int, failed: bool) -> tuple[list[int], int, bool]:
    """One attempt against a key's state: (failures kept, end of the lock, whether this attempt was refused)."""
    if at < locked_until:
        return failures, locked_until, True
    if not failed:
        return [], 0, False
    failures = [*(t for t in failures if t > at - WINDOW_MS), at]
    if len(failures) >= MAX_FAILURES:
        return [], at + LOCK_MS, False
    return failures, 0, False


#: Events that count as failed and as successful attempts; all others are none.
FAILURES, SUCCESSES = ("error", "click", "view"), ("purchase",)
#: The test binding lets time pass faster, as a month's events of a user are hours apart.
SPEED = 500


def attempts(events: DataFrame, speed: int = 1) -> DataFrame:
    """user_id, at (milliseconds), failed and event_id of the events that are attempts."""
    at = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / speed)
    rows = events.where(F.col("event_type").isin(*FAILURES, *SUCCESSES))
    return rows.select("user_id", at.alias("at"), F.col("event_type").isin(*FAILURES).alias("failed"), "event_id")


def lockouts(stream: DataFrame) -> DataFrame:
    """Attempts refused under a lock, by arbitrary state for each user; works on streams and keeps state over batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        failures, until = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        refused = []
        for frame in frames:
            for at, event, failed in frame.sort_values(["at", "event_id"])[["at", "event_id", "failed"]].itertuples(index=False):
                failures, until, no = transition(failures, until, int(at), bool(failed))
                if no:
                    refused.append((key[0], int(event), int(at)))
        state.update((failures, until))
        yield pd.DataFrame(refused, columns=["user_id", "event_id", "at"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, at long", "failures array<long>, locked_until long", "append", GroupStateTimeout.NoTimeout)


def refused_attempts(rows: DataFrame) -> DataFrame:
    """The same transition over a table: each partition is passed once in the order of users and time, with one user's state in hand."""

    def run(frames):
        user, failures, until = None, [], 0
        for frame in frames:
            refused = []
            for key, at, event, failed in frame[["user_id", "at", "event_id", "failed"]].itertuples(index=False):
                if key != user:
                    user, failures, until = key, [], 0
                failures, until, no = transition(failures, until, int(at), bool(failed))
                if no:
                    refused.append((int(key), int(event), int(at)))
            yield pd.DataFrame(refused, columns=["user_id", "event_id", "at"])

    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return ordered.mapInPandas(run, "user_id long, event_id long, at long")


def lockout_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windloom.sources.bindings import table

    return refused_attempts(attempts(table(spark, sf_dir, "events"), SPEED))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "15 minutes") -> DataFrame:
    """Events and errors in tumbling windows of event time, with a watermark for late rows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from windloom.sources.bindings import table

    return windowed_counts(table(spark, sf_dir, "events"))


def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user: its type, and how many there were."""
    from windloom.sources.bindings import table

    last = F.max(F.struct("ts", "event_id", "event_type")).alias("last")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), last).select("user_id", "n", F.col("last.event_id").alias("event_id"), F.col("last.event_type").alias("event_type"))


QUERIES = (lockout_batch, event_windows, latest_per_user)
_REFUSED, _LATER = 'a."at" < s.until', f'list_append(list_filter(s.f, lambda t: t > a."at" - {WINDOW_MS}), a."at")'
SQL = {
    "lockout_batch": f"""WITH RECURSIVE a AS (SELECT user_id, event_id, "at", failed, row_number() OVER (PARTITION BY user_id ORDER BY "at", event_id) AS n
        FROM (SELECT user_id, event_id, epoch_us(ts) // {1000 * SPEED} AS "at", event_type <> 'purchase' AS failed FROM events WHERE event_type IN ('error', 'click', 'view', 'purchase'))),
      s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS f, CAST(0 AS BIGINT) AS until, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS "at", FALSE AS refused FROM a
        UNION ALL SELECT a.user_id, a.n, CASE WHEN {_REFUSED} THEN s.f WHEN NOT a.failed OR len({_LATER}) >= {MAX_FAILURES} THEN [] ELSE {_LATER} END,
          CASE WHEN {_REFUSED} THEN s.until WHEN a.failed AND len({_LATER}) >= {MAX_FAILURES} THEN a."at" + {LOCK_MS} ELSE 0 END, a.event_id, a."at", {_REFUSED} FROM s JOIN a ON a.user_id = s.user_id AND a.n = s.n + 1)
      SELECT user_id, event_id, "at" FROM s WHERE refused""",
    "event_windows": "SELECT CAST(epoch(time_bucket(INTERVAL 15 MINUTE, ts)) AS BIGINT) AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "latest_per_user": "SELECT user_id, count(*) AS n, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
}
