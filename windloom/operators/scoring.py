"""Full engineering and route scoring, decimal money, and rows for training a search model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.operators.decide import DISCOUNT, HOURS, LAND_FIXED, PRICE_MWH, YEARS, annuity, with_limits
from windloom.sources import bindings

#: Metric -> group, hundredths of weight within the group, larger is better.
ENGINEERING = {
    "length_m": ("physical", 100, False),
    "traversal": ("spatial", 40, False),
    "parcels": ("spatial", 30, False),
    "crossings": ("spatial", 20, False),
    "overlap_m": ("spatial", 10, False),
    "owners": ("spatial", 0, False),
    "poles": ("infra", 100, False),
    "losses_kw": ("electrical", 45, False),
    "loading": ("electrical", 35, False),
    "voltage_margin": ("electrical", 20, True),
}
#: Hundredths of weight of the groups.
GROUPS = {"physical": 30, "spatial": 30, "infra": 15, "electrical": 25}
#: Hundredths of weight of the seven route criteria, all lower is better.
ROUTE = {"length_m": 30, "traversal": 20, "overlap_m": 15, "parcels": 10, "crossings": 10, "poles": 10, "owners": 5}
#: Benefits are whole numbers of a thousand-millionth, so that sums don't depend on their order.
SCALE = 10**9
#: Millionths of the present value of one a year.
FACTOR = round(annuity(DISCOUNT, YEARS) * 10**6)


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with all ten metrics (test binding)."""
    k = F.col("candidate_id")
    more = {"traversal": F.col("length_m") * 3 + k * 71 % 5000, "overlap_m": k * 37 % 400, "owners": k * 11 % 7, "loading": 40 + k * 53 % 60}
    return bindings.candidates(spark, sf_dir).withColumns(more)


def normalised(rows: DataFrame, metrics) -> DataFrame:
    """Whole-number benefits ``n_<metric>`` between 0 (least) and SCALE (greatest) of the cohort; 0 for a metric that is the same for all."""
    out = with_limits(rows, metrics)
    v = lambda m: F.when(F.col(f"hi_{m}") > F.col(f"lo_{m}"), F.round((F.col(m) - F.col(f"lo_{m}")) / (F.col(f"hi_{m}") - F.col(f"lo_{m}")) * SCALE)).otherwise(0).cast("long")
    return out.withColumns({f"n_{m}": v(m) for m in metrics})


def unified(rows: DataFrame) -> DataFrame:
    """Group scores and the total of a cohort's candidates."""
    out = normalised(rows, ENGINEERING)
    best = lambda m: F.col(f"n_{m}") if ENGINEERING[m][2] else F.when(F.col(f"hi_{m}") > F.col(f"lo_{m}"), SCALE - F.col(f"n_{m}")).otherwise(0)
    groups = {f"g_{g}": sum((best(m) * w for m, (of, w, _) in ENGINEERING.items() if of == g), F.lit(0).cast("long")) for g in GROUPS}
    out = out.withColumns(groups)
    return out.withColumn("total", sum((F.col(f"g_{g}") * w for g, w in GROUPS.items()), F.lit(0).cast("long")))


def unified_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the converged candidates by total, electrical, spatial and infrastructure score, length, losses and id; the others have none."""
    rows = measured(spark, sf_dir)
    order = Window.partitionBy("cohort").orderBy(F.desc("total"), F.desc("g_electrical"), F.desc("g_spatial"), F.desc("g_infra"), "length_m", "losses_kw", "candidate_id")
    good = unified(rows.where("converged and violations = 0 and not hard_violation")).withColumn("rank", F.row_number().over(order)).select("cohort", "candidate_id", *[f"g_{g}" for g in GROUPS], "total", "rank")
    rest = rows.where("not (converged and violations = 0 and not hard_violation)").select("cohort", "candidate_id", *[F.lit(None).cast("long").alias(c) for c in (*(f"g_{g}" for g in GROUPS), "total")], F.lit(None).cast("int").alias("rank"))
    return good.unionByName(rest)


def route_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven route criteria, a lower total is better; rank by total, length and id; routes through a hard layer are rejected."""
    rows = measured(spark, sf_dir)
    out = normalised(rows.where("not hard_violation"), ROUTE)
    total = sum((F.col(f"n_{m}") * w for m, w in ROUTE.items()), F.lit(0).cast("long"))
    order = Window.partitionBy("cohort").orderBy("total", "length_m", "candidate_id")
    good = out.withColumn("total", total).withColumn("rank", F.row_number().over(order)).select("cohort", "candidate_id", "total", "rank", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(rows.where("hard_violation").select("cohort", "candidate_id", F.lit(None).cast("long").alias("total"), F.lit(None).cast("int").alias("rank"), F.lit("HARD_CONSTRAINT").alias("reason")))


def money(amount: Column) -> Column:
    """Half to even at two digits."""
    return F.bround(amount, 2).cast("decimal(20,2)")


def _decimal(c: Column | int | str, digits: int = 20, scale: int = 0) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast(f"decimal({digits},{scale})")


def opex_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly lost energy, its price and its present value in exact decimals; a state instead where they have no value."""
    k = F.col("candidate_id")
    rows = bindings.candidates(spark, sf_dir).withColumn("loss", F.when(k % 47 == 0, None).when(k % 53 == 0, -F.col("losses_kw")).otherwise(F.col("losses_kw")))
    state = F.when(~F.col("converged"), "NOT_CONVERGED").when(F.col("loss").isNull(), "LOSS_MISSING").when(F.col("loss") < 0, "LOSS_NEGATIVE").otherwise("OK")
    mwh = _decimal(F.col("loss") * HOURS * 35, 18) / _decimal(100_000, 6)
    yearly = F.col("mwh") * _decimal(PRICE_MWH, 5)
    value = F.col("mwh") * _decimal(PRICE_MWH * FACTOR, 12) / _decimal(10**6, 7)
    rows = rows.withColumn("state", state).withColumn("mwh", F.when(F.col("state") == "OK", mwh.cast("decimal(20,5)")))
    return rows.select("candidate_id", "state", "mwh", money(yearly).alias("cost_per_year"), money(value).alias("present_value"))


def lifecycle_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAPEX, present value of losses and of land, and their sum, which is published only if all three are known."""
    land = F.when(F.col("parcels") < 8, _decimal(F.col("parcels") * LAND_FIXED, 20, 2))
    joined = bindings.candidates(spark, sf_dir).select("cohort", "candidate_id", F.col("cost").alias("capex"), land.alias("land")).join(opex_states(spark, sf_dir).select("candidate_id", "present_value"), "candidate_id")
    return joined.select("cohort", "candidate_id", "capex", F.col("present_value").alias("opex"), "land", (F.col("capex") + F.col("present_value") + F.col("land")).cast("decimal(20,2)").alias("lifecycle_cost"))


def cost_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that can't be ranked by cost: no complete cost, or a cohort of several economic contexts."""
    contexts = F.count_distinct((F.col("candidate_id") % 400 == 0)).alias("n_contexts")
    rows = lifecycle_costs(spark, sf_dir)
    each = rows.join(rows.groupBy("cohort").agg(contexts), "cohort")
    found = F.array(F.when(F.col("lifecycle_cost").isNull(), "INCOMPLETE_LIFECYCLE_COST"), F.when(F.col("n_contexts") > 1, "ECONOMIC_CONTEXT_MISMATCH"))
    return each.select("cohort", "candidate_id", F.array_join(F.array_compact(found), ",").alias("reasons")).where("reasons <> ''")


def mutation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training row for moving each feeder's last turbine to the next feeder: moved capacity, spreads of both feeders after in millimetres (summed), squared length of the new link."""
    t = bindings.turbines(spark, sf_dir)
    last = t.groupBy("project", "feeder").agg(F.max_by(F.struct("turbine_id", "x", "y", "kw"), "k").alias("m"), F.max("k").alias("k"))
    moves = last.join(last.select("project", F.col("feeder").alias("to")), "project").where(F.col("to") == F.col("feeder") + 1).select("project", F.col("feeder").alias("from"), "to", "k", "m")
    stay = t.join(moves.select("project", F.col("from").alias("feeder"), F.col("k").alias("gone")), ["project", "feeder"]).where("k <> gone").select("project", F.col("feeder").alias("move"), F.lit("from").alias("side"), "x", "y", "kw")
    here = t.join(moves.select("project", F.col("to").alias("feeder"), F.col("from").alias("move")), ["project", "feeder"]).select("project", "move", F.lit("to").alias("side"), "x", "y", "kw")
    moved = moves.select("project", F.col("from").alias("move"), F.lit("to").alias("side"), "m.x", "m.y", "m.kw")
    after = stay.unionByName(here).unionByName(moved)
    centre = after.groupBy("project", "move", "side").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("n"), F.sum("kw").alias("side_kw"))
    away = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    spread = after.join(centre, ["project", "move", "side"]).groupBy("project", "move", "side").agg(F.round(F.coalesce(F.stddev_samp(away), F.lit(0.0)) * 1000).cast("long").alias("spread"), F.first("side_kw").alias("side_kw"))
    sides = spread.groupBy("project", "move").agg(F.sum("spread").alias("spread_mm"), F.sum(F.when(F.col("side") == "to", F.col("side_kw")).otherwise(-F.col("side_kw"))).alias("kw_difference"))
    near = moves.join(t.select("project", F.col("feeder").alias("to"), "x", "y"), ["project", "to"]).groupBy("project", F.col("from").alias("move")).agg(F.min((F.col("m.x") - F.col("x")) * (F.col("m.x") - F.col("x")) + (F.col("m.y") - F.col("y")) * (F.col("m.y") - F.col("y"))).alias("link_sq"), F.first("m.turbine_id").alias("turbine_id"), F.first("m.kw").alias("kw"))
    return near.join(sides, ["project", "move"]).select("project", F.col("move").alias("feeder"), F.lit("reassign").alias("mutation"), "turbine_id", "kw", "link_sq", "spread_mm", "kw_difference")


QUERIES = (unified_scoring, route_scoring, opex_states, lifecycle_costs, cost_context, mutation_features)
