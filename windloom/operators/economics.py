"""Pole cost, parcels touched, land roll-up, route scoring, group trade-offs and metric deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.operators.decide import LAND_FIXED, LAND_PER_M, land_decision, reasons, scored, with_limits
from windloom.sources import bindings

#: Installed cost of a pole by class; angle poles have none in this catalogue.
POLE_RATES = {"terminal": 15000, "intermediate": 12000, "junction": 20000}
#: Weights of the groups, and of the metrics inside their group.
GROUP_WEIGHTS = {"PHYSICAL": 0.30, "SPATIAL": 0.30, "INFRA": 0.15, "ELECTRICAL": 0.25}
GROUPS = {"PHYSICAL": {"length_m": 1.0}, "SPATIAL": {"parcels": 0.6, "crossings": 0.4}, "INFRA": {"poles": 1.0}, "ELECTRICAL": {"losses_kw": 0.7, "voltage_margin": 0.3}}
#: Weights of a route's score without electrical results; the least total is best.
ROUTE_WEIGHTS = {"length_m": 0.4, "poles": 0.25, "parcels": 0.2, "crossings": 0.15}
COMPENSATION_PER_M2 = 12.5
TOLERANCE = 1e-9


def pole_class() -> Column:
    return F.when(F.col("l_linenumber") > 1, "junction").when(F.col("l_linestatus") == "O", "terminal").when(F.col("l_returnflag") == "R", "angle").otherwise("intermediate")


def pole_capex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of a network's poles, unknown if one class has no rate; and how many poles lack one."""
    rate = F.lit(None).cast("int")
    for kind, value in POLE_RATES.items():
        rate = F.when(pole_class() == kind, value).otherwise(rate)
    rows = bindings.segments(spark, sf_dir).select(F.col("l_orderkey").alias("network"), rate.alias("rate"))
    return rows.groupBy("network").agg(F.when(F.count_if(F.col("rate").isNull()) == 0, F.sum("rate")).alias("capex"), F.count_if(F.col("rate").isNull()).alias("n_unpriced"))


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario, parcel and metres of corridor on it (a corridor may meet a parcel more than once)."""
    return bindings.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("scenario"), F.col("l_partkey").alias("parcel_id"), F.col("l_quantity").cast("long").alias("overlap_m"))


def parcel_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under each parcel's corridor and its compensation, to two decimals."""
    area = F.sum("overlap_m") * 18
    return exposures(spark, sf_dir).groupBy("parcel_id").agg(area.alias("area_m2"), F.round((area * COMPENSATION_PER_M2).cast("decimal(20,4)"), 2).alias("compensation"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = exposures(spark, sf_dir).groupBy("scenario", "parcel_id").agg(F.sum("overlap_m").alias("overlap_m"))
    owners = bindings.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("parcel_id"), F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("owner"), F.when(F.col("p_size") % 3 == 0, "QUOTED").otherwise("ESTIMATED").alias("basis"))
    return touched.join(owners, "parcel_id", "left").join(land_decision(spark, sf_dir), "parcel_id", "left")


def cost_basis(basis: Column) -> Column:
    """QUOTED or ESTIMATED if all are, MIXED if both occur, UNKNOWN if none does."""
    quoted, estimated = F.count_if(basis == "QUOTED"), F.count_if(basis == "ESTIMATED")
    return F.when((quoted > 0) & (estimated > 0), "MIXED").when(quoted > 0, "QUOTED").when(estimated > 0, "ESTIMATED").otherwise("UNKNOWN")


def land_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land of each scenario: parcels, owners to talk to, value (unknown if a parcel has none), feasibility and basis."""
    unknown = F.count_if(F.col("present_value").isNull())
    return _decided(spark, sf_dir).groupBy("scenario").agg(
        F.count("*").alias("n_parcels"),
        (F.count_distinct("owner") + F.count_if(F.col("owner").isNull())).alias("n_owner_interactions"),
        F.bool_and(F.col("owner").isNotNull()).alias("owners_known"),
        F.when(unknown == 0, F.sum(F.round(F.col("present_value") * 100).cast("long"))).alias("value_cents"),
        F.sum(F.round(F.col("present_value") * 100).cast("long")).alias("known_cents"),
        (~F.bool_or(F.coalesce(F.col("status"), F.lit("UNKNOWN")) == "UNAVAILABLE")).alias("feasible"),
        cost_basis(F.when(F.col("present_value").isNotNull(), F.col("basis"))).alias("basis"),
    )


def fallback_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy price of the parcels of each scenario that no option prices."""
    rows = _decided(spark, sf_dir).where("present_value is null")
    return rows.groupBy("scenario").agg(F.count("*").alias("n_parcels"), (F.count("*") * LAND_FIXED + F.sum("overlap_m") * LAND_PER_M).alias("cost"))


def legacy_route_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by weighted min-max drawback (0 is best), then length, then id; all of a cohort take part."""
    rows = with_limits(bindings.candidates(spark, sf_dir), ROUTE_WEIGHTS)
    total = F.lit(0.0)
    for m, w in ROUTE_WEIGHTS.items():
        lo, hi = F.col(f"lo_{m}"), F.col(f"hi_{m}")
        total = total + F.when(hi > lo, F.round((F.col(m) - lo) / (hi - lo), 9)).otherwise(0.0) * w
    ranked = rows.withColumn("total", F.round(total, 6))
    order = Window.partitionBy("cohort").orderBy("total", "length_m", "candidate_id")
    return ranked.withColumn("rank", F.row_number().over(order)).select("cohort", "candidate_id", "total", "rank")


def grouped(rows: DataFrame) -> DataFrame:
    """Score of each group of metrics (in units of 1e-10) and their weighted total (1e-12): whole numbers, so that ties are ties."""
    for g, inside in GROUPS.items():
        rows = rows.withColumn(f"g_{g}", sum(F.round(F.col(f"b_{m}") * 1e9).cast("long") * round(w * 10) for m, w in inside.items()))
    return rows.withColumn("unified", sum(F.col(f"g_{g}") * round(w * 100) for g, w in GROUP_WEIGHTS.items()))


def unified_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by unified total, then the groups' scores, length, losses, id."""
    order = Window.partitionBy("cohort").orderBy(F.desc("unified"), F.desc("g_ELECTRICAL"), F.desc("g_SPATIAL"), F.desc("g_INFRA"), "length_m", "losses_kw", "candidate_id")
    return grouped(scored(bindings.candidates(spark, sf_dir))).withColumn("rank", F.row_number().over(order)).select("cohort", "candidate_id", (F.col("unified") / 1e12).alias("unified"), "rank")


def group_tradeoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each group of metrics the rival that beats the winner by most; no row if none does."""
    order = Window.partitionBy("cohort").orderBy(F.desc("unified"), F.desc("g_ELECTRICAL"), F.desc("g_SPATIAL"), F.desc("g_INFRA"), "length_m", "losses_kw", "candidate_id")
    rows = grouped(scored(bindings.candidates(spark, sf_dir))).withColumn("rank", F.row_number().over(order))
    long = rows.select("cohort", "candidate_id", "rank", *[F.col(f"g_{g}").alias(g) for g in GROUPS]).unpivot(["cohort", "candidate_id", "rank"], list(GROUPS), "metric_group", "score")
    best = long.groupBy("cohort", "metric_group").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("own"), F.max(F.when(F.col("rank") > 1, F.struct("score", (-F.col("candidate_id")).alias("id")))).alias("top"))
    return best.where(F.col("top.score") > F.col("own")).select("cohort", "metric_group", (-F.col("top.id")).alias("rival"), ((F.col("top.score") - F.col("own")) / 1e10).alias("lead"))


def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's length, losses and margin against the cohort's cheapest: absolute, percent (NULL at base 0) and verdict."""
    base = bindings.candidates(spark, sf_dir).where("cost is not null").groupBy("cohort").agg(F.min(F.struct("cost", "candidate_id", "length_m", "losses_kw", "voltage_margin")).alias("b"))
    rows = bindings.candidates(spark, sf_dir).join(base, "cohort")  # one base a cohort
    out = ["cohort", "candidate_id"]
    for m, up in (("length_m", False), ("losses_kw", False), ("voltage_margin", True)):
        d = F.col(m) - F.col(f"b.{m}")
        good = F.when(F.abs(d) <= TOLERANCE, "EQUAL").when((d > 0) == up, "BETTER").otherwise("WORSE")
        out += [d.alias(f"{m}_delta"), F.round(F.when(F.abs(F.col(f"b.{m}")) > TOLERANCE, d * 100.0 / F.col(f"b.{m}")), 6).alias(f"{m}_pct"), good.alias(f"{m}_verdict")]
    return rows.select(*out)


def engineering_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best design and the cheapest design of each cohort, found apart."""
    rows = scored(bindings.candidates(spark, sf_dir))
    return rows.groupBy("cohort").agg(
        F.min_by("candidate_id", F.struct((-F.col("total")).alias("t"), "length_m", "losses_kw", "candidate_id")).alias("best"),
        F.min_by("candidate_id", F.struct("cost", (-F.col("total")).alias("t"), "length_m", "losses_kw", "candidate_id")).alias("cheapest"),
    )


def workflow_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each cohort's run: none converged, none eligible, some or all eligible."""
    rows = reasons(bindings.candidates(spark, sf_dir)).groupBy("cohort").agg(F.count("*").alias("n"), F.count_if("converged").alias("n_converged"), F.count_if("eligible").alias("n_eligible"))
    state = F.when(F.col("n_converged") == 0, "FAILED").when(F.col("n_eligible") == 0, "NO_FEASIBLE").when(F.col("n_eligible") < F.col("n"), "PARTIAL").otherwise("SUCCESS")
    return rows.select("*", state.alias("state"))


QUERIES = (pole_capex, parcel_impact, land_rollup, fallback_land, legacy_route_rank, unified_rank, group_tradeoffs, metric_deltas, engineering_best, workflow_status)
