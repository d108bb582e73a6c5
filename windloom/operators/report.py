"""Bill-of-materials roll-ups, job history and scenario comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.sources import bindings


def latest_by(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def percent_delta(value: Column, base: Column) -> Column:
    """Change against a base in percent to one decimal, half up towards plus infinity; NULL for a missing or zero base."""
    return F.when(base != 0, F.floor((value - base).cast("double") / base.cast("double") * 1000 + 0.5) / 10)


def rollup_feeders(segments: DataFrame) -> DataFrame:
    """Segments, length, money (NULL only if none is known) and losses (zero-based) of each feeder; no feeder: Unassigned."""
    return segments.groupBy(F.coalesce(F.col("feeder").cast("string"), F.lit("Unassigned")).alias("feeder")).agg(
        F.count("*").alias("n_segments"),
        F.round(F.sum("length_m") / 1000, 3).cast("decimal(18,3)").alias("length_km"),
        F.sum("cost").cast("decimal(20,2)").alias("cost"),
        F.coalesce(F.sum("loss_w"), F.lit(0)).alias("loss_w"),
    )


def feeder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_feeders(bindings.segments(spark, sf_dir))


def conductor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, length and greatest utilisation of each conductor; cable 0 stands for one that isn't reported."""
    name = F.when(F.col("cable") == 0, "Not reported").otherwise(F.concat(F.lit("cable-"), F.col("cable").cast("string")))
    return bindings.segments(spark, sf_dir).groupBy(name.alias("conductor")).agg(F.count("*").alias("n_segments"), F.sum("length_m").cast("decimal(20,2)").alias("length_m"), F.max("util_milli").alias("max_util_milli")).orderBy(F.desc("length_m"), "conductor")


def _pole_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poles and the one or two segments that each one carries."""
    own = F.col("segment_id")
    previous = F.concat_ws("-", F.col("l_orderkey").cast("string"), (F.col("l_linenumber") - 1).cast("string"))
    return bindings.segments(spark, sf_dir).select(F.concat(F.lit("POLE-"), own).alias("pole_id"), "l_linestatus", F.when(F.col("l_linenumber") > 1, F.array(own, previous)).otherwise(F.array(own)).alias("route_ids"))


def poles_per_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poles on each segment, through membership in the poles' segment lists."""
    return _pole_rows(spark, sf_dir).select(F.explode("route_ids").alias("segment_id")).groupBy("segment_id").agg(F.count("*").alias("n_poles"))


def count_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poles by role; blank roles aren't counted."""
    role = F.when(F.col("l_linestatus") == "O", "terminal").otherwise("")
    role = F.when(F.size("route_ids") > 1, "junction").otherwise(role)
    return _pole_rows(spark, sf_dir).select(role.alias("role")).where(F.trim("role") != "").groupBy("role").agg(F.count("*").alias("n"))


def network_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network sums; poles are counted once each, not once for each segment."""
    sums = bindings.segments(spark, sf_dir).agg(F.count("*").alias("n_segments"), F.count_distinct("feeder").alias("n_feeders"), F.sum("length_m").cast("decimal(20,2)").alias("length_m"), F.sum("cost").cast("decimal(20,2)").alias("cost"), F.sum(F.col("cost").isNull().cast("int")).alias("n_unpriced"))
    poles = _pole_rows(spark, sf_dir).agg(F.count_distinct("pole_id").alias("n_poles"), F.sum(F.size("route_ids")).alias("n_pole_places"))
    return sums.crossJoin(poles)  # one row each


def latest_completed_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bindings.jobs(spark, sf_dir).where("status = 'COMPLETED'")
    return latest_by(done, ["project", "scenario"], F.desc("created"), F.desc("job_id")).select("project", "scenario", "job_id", "capex")


def scenario_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest completed job of each scenario against the project's 3-MEDIUM one, else against its newest."""
    latest = latest_by(bindings.jobs(spark, sf_dir).where("status = 'COMPLETED'"), ["project", "scenario"], F.desc("created"), F.desc("job_id"))
    base = latest_by(latest, ["project"], F.desc(F.col("scenario") == "3-MEDIUM"), F.desc("created"), F.desc("job_id")).select("project", F.col("scenario").alias("base_scenario"), F.col("capex").alias("base_capex"))
    return latest.join(base, "project").select("project", "scenario", "capex", "base_scenario", percent_delta(F.col("capex"), F.col("base_capex")).alias("delta_pct"))


def pending_or_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.jobs(spark, sf_dir).groupBy("project").agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "RUNNING").alias("running"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "COMPLETED").alias("completed"))


def audit_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest events."""
    return bindings.table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


def route_pole_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poles of each route; where no pole names it, an estimate from its length, marked as such."""
    routes = bindings.segments(spark, sf_dir)
    counted = _pole_rows(spark, sf_dir).where("size(route_ids) > 1").select(F.explode("route_ids").alias("segment_id")).groupBy("segment_id").agg(F.count("*").alias("counted"))
    estimate = F.greatest(F.lit(2), F.ceil(F.col("length_m") / 150).cast("int") + 1)
    joined = routes.join(counted, "segment_id", "left")
    return joined.groupBy(F.col("counted").isNull().alias("is_estimated")).agg(F.count("*").alias("n_routes"), F.sum(F.coalesce("counted", estimate)).cast("long").alias("n_poles"))


QUERIES = (feeder_rollup, conductor_totals, poles_per_segment, count_by_role, network_totals, latest_completed_job, scenario_compare, pending_or_running, audit_top50, route_pole_estimates)
