"""Decision reports: standing of each candidate, comparisons with the winner, factors, rejections, distinct scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.operators.decide import reasons, scored
from windloom.sources import bindings

#: Compared metrics, all better if smaller, and their significance; differences up to EPSILON are none.
COMPARED = {"length_m": "primary", "cost": "primary", "parcels": "secondary", "losses_kw": "secondary", "crossings": "secondary"}
EPSILON = 1e-9
#: Scenarios that a project asks for.
REQUESTED = 12


def _place() -> Column:
    return F.struct((-F.col("total")).alias("minus_total"), "length_m", "losses_kw", "candidate_id")


def winners(good: DataFrame) -> DataFrame:
    """cohort and winner: the first by total, length, losses and id."""
    return good.groupBy("cohort").agg(F.min_by("candidate_id", _place()).alias("winner"))


def decision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing of each candidate; rejected ones with their first failure and all of them."""
    rows = bindings.candidates(spark, sf_dir)
    judged = reasons(rows).join(winners(scored(rows)), "cohort", "left")
    standing = F.when(~F.col("eligible"), "REJECTED").when(F.col("candidate_id") == F.col("winner"), "RECOMMENDED").otherwise("FEASIBLE")
    return judged.select("cohort", "candidate_id", standing.alias("standing"), F.get("reasons", F.lit(0)).alias("failure_code"), F.array_join("reasons", ",").alias("codes"))


def compare(own: DataFrame, others: DataFrame) -> DataFrame:
    """A row for each other candidate and compared metric: the winner's value less the other's, relative to it, and the outcome."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(s).alias("significance"), F.col(m).cast("decimal(18,2)").alias("value")) for m, s in COMPARED.items()])
    own = own.select("cohort", F.explode(values).alias("o")).select("cohort", "o.metric", F.col("o.value").alias("own"))
    long = others.select("cohort", "candidate_id", F.explode(values).alias("o")).select("cohort", "candidate_id", "o.*")
    delta = F.col("own") - F.col("value")
    relative = F.when(F.abs("value") > EPSILON, F.round(delta.cast("double") / F.col("value").cast("double"), 6))
    outcome = F.when(delta < 0, "BETTER").when(delta > 0, "WORSE").when(delta == 0, "EQUAL")
    return long.join(own, ["cohort", "metric"]).select("cohort", "candidate_id", "metric", "significance", delta.cast("decimal(19,2)").alias("delta"), relative.alias("relative"), outcome.alias("outcome"))


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The winners' rows and the eligible others."""
    good = scored(bindings.candidates(spark, sf_dir))
    marked = good.join(winners(good), "cohort")
    return marked.where("candidate_id = winner"), marked.where("candidate_id <> winner")


def report_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner against every eligible alternative."""
    return compare(*_parts(spark, sf_dir))


def report_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for and against the winner, compared with the second."""
    own, others = _parts(spark, sf_dir)
    second = others.groupBy("cohort").agg(F.min_by(F.struct("candidate_id", *COMPARED), _place()).alias("s")).select("cohort", "s.*")
    side = F.when(F.col("outcome") == "BETTER", "ADVANTAGE").otherwise("DISADVANTAGE")
    return compare(own, second).where("outcome <> 'EQUAL'").select("cohort", F.col("candidate_id").alias("second"), "metric", "significance", side.alias("side"), "delta")


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each cohort by standing, and the recommended one."""
    count = lambda s: F.count_if(F.col("standing") == s)
    rows = decision_report(spark, sf_dir).groupBy("cohort")
    return rows.agg(F.count("*").alias("n"), (count("FEASIBLE") + count("RECOMMENDED")).alias("n_feasible"), count("REJECTED").alias("n_rejected"), F.max(F.when(F.col("standing") == "RECOMMENDED", F.col("candidate_id"))).alias("recommended"))


def report_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected candidates by first failure."""
    return decision_report(spark, sf_dir).where("standing = 'REJECTED'").groupBy("cohort", "failure_code").agg(F.count("*").alias("n"), F.min("candidate_id").alias("first_id"))


def distinct_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios in the order of the schedule, equal designs only once, up to the number that was asked for."""
    design = F.sha2(F.concat_ws("|", F.col("parcels").cast("string"), F.col("crossings").cast("string")), 256)
    first = bindings.candidates(spark, sf_dir).groupBy("cohort", design.alias("fingerprint")).agg(F.min("candidate_id").alias("candidate_id"), F.count("*").alias("n_equal"))
    place = F.row_number().over(Window.partitionBy("cohort").orderBy("candidate_id"))
    return first.withColumn("place", place).where(F.col("place") <= REQUESTED)


def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a restart: what was pending or running has failed."""
    stale = F.col("status").isin("PENDING", "RUNNING")
    return bindings.jobs(spark, sf_dir).select("job_id", "project", F.when(stale, "FAILED").otherwise(F.col("status")).alias("status"), stale.alias("swept"))


QUERIES = (decision_report, report_comparisons, report_factors, report_summary, report_rejections, distinct_scenarios, stale_jobs)
