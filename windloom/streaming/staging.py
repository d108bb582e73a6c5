"""Import staging and progress sessions over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.sources.bindings import table

#: How long a staged import can be committed, and how long a progress stream stays open without an event.
STAGED_US, SILENCE = 30 * 60 * 1_000_000, "5 minutes"


def settle(rows: DataFrame) -> DataFrame:
    """Commits (handle, at, id, project) and their result, from ``rows`` with staged: whether a row stages or commits.

    A commit takes the handle's latest staged import: of the same project, no older than 30 minutes, and not taken before.
    """
    by = Window.partitionBy("handle").orderBy("at", "id")
    staged = F.when(F.col("staged"), F.struct("at", "project", "id"))
    rows = rows.withColumn("s", F.last(staged, ignorenulls=True).over(by)).where("not staged")
    live = F.coalesce(F.col("at") - F.col("s.at") <= STAGED_US, F.lit(False))
    rows = rows.withColumn("live", live).withColumn("fits", F.col("live") & (F.col("project") == F.col("s.project")))
    taken = F.coalesce(F.max(F.col("fits")).over(Window.partitionBy("handle", "s.id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    result = F.when(~F.col("live") | taken, "EXPIRED").when(~F.col("fits"), "OTHER_PROJECT").otherwise("COMMITTED")
    return rows.select("handle", "id", "at", result.alias("result"))


def import_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit and whether a staged import was there for it."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").where(kind.isin("view", "click", "signup", "purchase", "error"))
    return settle(rows.select(F.col("user_id").alias("handle"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), (F.col("event_id") % 2).alias("project"), kind.isin("view", "click", "signup").alias("staged")))


def sessions(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Progress streams: events of a user without five minutes of silence between them; for tables and streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    found = rows.groupBy("user_id", F.session_window("ts", SILENCE).alias("w")).agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    return found.select("user_id", F.unix_micros("w.start").alias("start_us"), "n", F.unix_micros("last.ts").alias("last_us"), F.col("last.event_type").alias("last_type"))


def progress_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))


QUERIES = (import_commits, progress_sessions)
SQL = {
    "import_commits": f"""WITH rows AS (SELECT user_id AS handle, epoch_us(ts) AS us, event_id AS id, event_id % 2 AS project, event_type IN ('view', 'click', 'signup') AS staged FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase', 'error')),
  met AS (SELECT *, last_value(CASE WHEN staged THEN id END IGNORE NULLS) OVER w AS sid, last_value(CASE WHEN staged THEN us END IGNORE NULLS) OVER w AS sat, last_value(CASE WHEN staged THEN project END IGNORE NULLS) OVER w AS sp FROM rows WINDOW w AS (PARTITION BY handle ORDER BY us, id ROWS UNBOUNDED PRECEDING)),
  judged AS (SELECT *, coalesce(us - sat <= {STAGED_US}, FALSE) AS live, coalesce(us - sat <= {STAGED_US}, FALSE) AND project = sp AS fits FROM met WHERE NOT staged),
  seen AS (SELECT *, coalesce(bool_or(fits) OVER (PARTITION BY handle, sid ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS taken FROM judged)
  SELECT handle, id, us AS "at", CASE WHEN NOT live OR taken THEN 'EXPIRED' WHEN NOT fits THEN 'OTHER_PROJECT' ELSE 'COMMITTED' END AS result FROM seen""",
    "progress_sessions": """WITH gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
  parts AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM gaps)
  SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, epoch_us(max(ts)) AS last_us, arg_max(event_type, (ts, event_id)) AS last_type FROM parts GROUP BY user_id, part""",
}
