"""Scoring, ranking, eligibility, cost and land decisions of candidate designs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.sources import bindings
from windloom.sources.bindings import METRICS

#: Weights of the metrics in a design's total.
WEIGHTS = {"length_m": 0.30, "losses_kw": 0.15, "poles": 0.15, "parcels": 0.18, "crossings": 0.12, "voltage_margin": 0.10}
#: Blend of engineering score and cost, lifecycle parameters and fallback land rates.
ENGINEERING_WEIGHT, COST_WEIGHT = 0.7, 0.3
YEARS, HOURS, LOSS_LOAD, PRICE_MWH, DISCOUNT = 25, 8760, 0.35, 3500, 0.08
LAND_FIXED, LAND_PER_M = 25000, 400


def annuity(rate: float, years: int) -> float:
    """Present value of one a year; the number of years at rate zero."""
    return float(years) if rate == 0 else (1 - (1 + rate) ** -years) / rate


def with_limits(rows: DataFrame, metrics) -> DataFrame:
    """With the least and the greatest value of each metric in the cohort, from one aggregation, so that no cohort is sorted."""
    limits = [f(m).alias(f"{name}_{m}") for m in metrics for name, f in (("lo", F.min), ("hi", F.max))]
    return rows.join(rows.groupBy("cohort").agg(*limits), "cohort")


def benefit(metric: str, larger_is_better: bool) -> Column:
    """Min-max normalised between ``lo_`` and ``hi_``, 1 at its best; 0 for a metric that is the same for all."""
    v, lo, hi = F.col(metric), F.col(f"lo_{metric}"), F.col(f"hi_{metric}")
    return F.when(hi > lo, ((v - lo) if larger_is_better else (hi - v)) / (hi - lo)).otherwise(0.0)


def reasons(rows: DataFrame) -> DataFrame:
    """Every failed clause of eligibility, in fixed order."""
    failed = F.array(F.when(~F.col("converged"), "NOT_CONVERGED"), F.when(F.col("violations") > 0, "LIMIT_VIOLATION"), F.when(F.col("hard_violation"), "HARD_CONSTRAINT"), F.when(F.col("cost").isNull(), "INCOMPLETE_COST"))
    return rows.withColumn("reasons", F.array_compact(failed)).withColumn("eligible", F.size("reasons") == 0)


def scored(rows: DataFrame) -> DataFrame:
    """Eligible candidates with their benefits, rounded to nine decimals, and weighted total, rounded half up to six in whole numbers."""
    good = with_limits(reasons(rows).where("eligible"), METRICS)
    good = good.select("*", *[F.round(benefit(m, up), 9).alias(f"b_{m}") for m, up in METRICS.items()])
    total = sum(F.round(F.col(f"b_{m}") * 1_000_000_000).cast("long") * round(w * 100) for m, w in WEIGHTS.items())
    return good.withColumn("total", F.floor((total + 50_000) / 100_000) / 1_000_000)


def normalise_benefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(bindings.candidates(spark, sf_dir)).select("candidate_id", *[f"b_{m}" for m in METRICS])


def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(bindings.candidates(spark, sf_dir)).select("candidate_id", "eligible", F.array_join("reasons", ",").alias("reasons"))


def cohort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by total, then length, losses and id; ineligible candidates carry no rank."""
    order = Window.partitionBy("cohort").orderBy(F.desc("total"), "length_m", "losses_kw", "candidate_id")
    ranked = scored(bindings.candidates(spark, sf_dir)).withColumn("rank", F.row_number().over(order)).select("cohort", "candidate_id", "total", "rank")
    left_out = reasons(bindings.candidates(spark, sf_dir)).where("not eligible").select("cohort", "candidate_id", F.lit(None).cast("double").alias("total"), F.lit(None).cast("int").alias("rank"))
    return ranked.unionByName(left_out)


def cost_aware_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total blended with the normalised cost advantage; rank by blend, total, cost, length, losses, id.

    Rounded half up in whole numbers: the advantage in billionths, the blend in millionths, so that no tie is left to doubles.
    """
    saved = F.when(F.col("hi_cost") > F.col("lo_cost"), F.expr("(2000000000 * (hi_cost - cost) + (hi_cost - lo_cost)) div (2 * (hi_cost - lo_cost))")).otherwise(0)
    total = F.round(F.col("total") * 1_000_000).cast("long")
    blend = F.floor((round(ENGINEERING_WEIGHT * 10) * 1000 * total + round(COST_WEIGHT * 10) * saved + 5000) / 10_000)
    order = Window.partitionBy("cohort").orderBy(F.desc("final"), F.desc("total"), "cost", "length_m", "losses_kw", "candidate_id")
    return with_limits(scored(bindings.candidates(spark, sf_dir)), ["cost"]).withColumn("final", blend / 1_000_000).withColumn("rank", F.row_number().over(order)).select("cohort", "candidate_id", "final", "rank")


def runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner and second of each cohort, and the distance between them."""
    order = Window.partitionBy("cohort").orderBy(F.desc("total"), "length_m", "losses_kw", "candidate_id")
    top = scored(bindings.candidates(spark, sf_dir)).withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    return top.groupBy("cohort").agg(at(1, "candidate_id").alias("winner"), at(2, "candidate_id").alias("second"), F.round(at(1, "total") - at(2, "total"), 6).alias("lead"))


def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner's losses and length against the best baseline design of its cohort."""
    order = Window.partitionBy("cohort").orderBy(F.desc("total"), "length_m", "losses_kw", "candidate_id")
    rows = scored(bindings.candidates(spark, sf_dir))
    first = rows.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    base = rows.where("strategy = 'BASELINE'").withColumn("rank", F.row_number().over(order)).where("rank = 1")
    base = base.select("cohort", F.col("candidate_id").alias("baseline"), F.col("length_m").alias("base_length"), F.col("losses_kw").alias("base_losses"))
    better = F.when(F.col("losses_kw") < F.col("base_losses"), "BETTER").when(F.col("losses_kw") > F.col("base_losses"), "WORSE").otherwise("EQUAL")
    return first.join(base, "cohort", "left").select("cohort", F.col("candidate_id").alias("winner"), "baseline", (F.col("length_m") - F.col("base_length")).alias("length_delta"), (F.col("losses_kw") - F.col("base_losses")).alias("losses_delta"), better.alias("losses_verdict"))


def score_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric's share of the summed weighted benefits of a cohort, in percent."""
    rows = scored(bindings.candidates(spark, sf_dir)).groupBy("cohort").agg(*[F.sum(F.round(F.col(f"b_{m}") * w * 1_000_000).cast("long")).alias(m) for m, w in WEIGHTS.items()])
    long = rows.unpivot("cohort", list(WEIGHTS), "metric", "points")
    whole = F.sum("points").over(Window.partitionBy("cohort"))
    return long.select("cohort", "metric", F.round(F.when(whole > 0, F.col("points") * 100.0 / whole).otherwise(0.0), 6).alias("share_pct"))


def rates(spark: SparkSession) -> DataFrame:
    """Installed cost per km of each cable; cable 7 has none."""
    return spark.createDataFrame([(k, 400000 + 50000 * k) for k in range(1, 7)], "cable int, rate int")


def conductor_capex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAPEX of each feeder's conductors; one segment without a rate makes it unknown, and is counted."""
    rows = bindings.segments(spark, sf_dir).join(F.broadcast(rates(spark)), "cable", "left")  # a fixed catalogue
    money = F.sum((F.col("length_m") * F.col("rate") / 1000).cast("decimal(20,2)")).cast("decimal(24,2)")
    gaps = F.sum(F.col("rate").isNull().cast("int"))
    return rows.groupBy("feeder").agg(F.when(gaps == 0, money).alias("capex"), gaps.alias("n_without_rate"))


def land_option_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present value of each parcel's purchase, lease and easement; infeasible ones have none."""
    k = F.col("p_partkey")
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(up).alias("up"), F.lit(year).alias("yearly"), F.lit(term).alias("term")) for m, up, year, term in (("EASEMENT", 20, 3, 20), ("LEASE", 0, 9, 30), ("PURCHASE", 100, 0, 0))])
    rows = bindings.table(spark, sf_dir, "part").select(k.alias("parcel_id"), F.round("p_retailprice").cast("long").alias("price"), (k % 11 == 0).alias("unavailable"), F.explode(modes).alias("o"))
    years = F.least("o.term", F.lit(YEARS))
    factor = F.when(years == 20, round(annuity(DISCOUNT, 20), 6)).when(years == 25, round(annuity(DISCOUNT, 25), 6)).otherwise(0.0)
    priced = (F.col("parcel_id") + F.length("o.mode")) % 7 != 0
    value = F.round(F.col("price") * F.col("o.up") + F.col("price") * F.col("o.yearly") * factor, 2)
    return rows.select("parcel_id", F.col("o.mode").alias("mode"), "unavailable", F.when(priced & ~F.col("unavailable"), value).alias("present_value"))


def land_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest feasible option of each parcel; none for unavailable parcels."""
    options = land_option_value(spark, sf_dir)
    best = F.min(F.when(F.col("present_value").isNotNull(), F.struct("present_value", "mode")))
    out = options.groupBy("parcel_id").agg(best.alias("best"), F.max("unavailable").alias("unavailable"))
    status = F.when(F.col("unavailable"), "UNAVAILABLE").when(F.col("best").isNull(), "UNPRICED").otherwise("DECIDED")
    return out.select("parcel_id", status.alias("status"), F.col("best.mode").alias("mode"), F.col("best.present_value").alias("present_value"))


def loss_opex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly losses, their cost and its present value over the analysis period."""
    mwh = F.col("losses_kw") * HOURS * LOSS_LOAD / 1000
    return bindings.candidates(spark, sf_dir).select("candidate_id", F.round(mwh, 4).alias("mwh"), F.round(mwh * PRICE_MWH, 2).alias("cost_per_year"), F.round(mwh * PRICE_MWH * round(annuity(DISCOUNT, YEARS), 6), 2).alias("present_value"))


def lifecycle_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAPEX plus present loss cost plus fallback land; unknown CAPEX leaves the total unknown."""
    opex = F.col("losses_kw") * HOURS * LOSS_LOAD / 1000 * PRICE_MWH * round(annuity(DISCOUNT, YEARS), 6)
    land = F.col("parcels") * LAND_FIXED + F.col("parcels") * 10 * LAND_PER_M
    total = F.col("cost").cast("double") + opex + land
    return bindings.candidates(spark, sf_dir).select("candidate_id", land.alias("land"), F.round(total, 2).alias("lifecycle_cost"))


QUERIES = (normalise_benefit, eligibility_reasons, cohort_rank, cost_aware_rank, runner_up, baseline_delta, score_share, conductor_capex, land_option_value, land_decision, loss_opex, lifecycle_total)
