"""Planning relations derived from the supplied tables by integer arithmetic (test bindings, not domain rules)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cable segments: feeder (NULL if unassigned), length, cost (NULL if unpriced), cable number, utilisation."""
    feeder = F.when(F.col("l_suppkey") % 11 != 0, F.col("l_suppkey") % 7)
    return table(spark, sf_dir, "lineitem").select(
        feeder.alias("feeder"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("segment_id"),
        (F.col("l_quantity") * 37).cast("decimal(12,2)").alias("length_m"),
        F.when(~(F.coalesce(feeder == 3, F.lit(False)) & (F.col("l_returnflag") == "N")), F.col("l_extendedprice").cast("decimal(14,2)")).alias("cost"),
        (F.col("l_linenumber") % 8).alias("cable"),
        F.round(F.col("l_discount") * 1000 + 0.0, 0).cast("int").alias("util_milli"),
        F.round(F.col("l_tax") * 1000 + 0.0, 0).cast("int").alias("loss_w"),
        "l_linestatus",
        "l_returnflag",
        "l_orderkey",
        "l_linenumber",
    )


def turbines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turbines of each project with metric coordinates, capacity, feeder and place in a branching feeder tree."""
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        c.alias("turbine_id"),
        F.col("c_nationkey").alias("project"),
        (c * 7919 % 20000).alias("x"),
        (c * 104729 % 20000).alias("y"),
        (2000 + 100 * (c % 30)).alias("kw"),
        F.when(F.col("c_mktsegment") == "BUILDING", "APPROVED").when(F.col("c_mktsegment") == "MACHINERY", "REGISTRATION").when(F.col("c_mktsegment") == "FURNITURE", "PROPOSED").otherwise("REJECTED").alias("status"),
    )
    i = F.row_number().over(Window.partitionBy("project").orderBy("x", "y", "turbine_id")) - 1
    return rows.withColumn("i", i).select("*", F.floor(F.col("i") / 10).cast("int").alias("feeder"), (F.col("i") % 10 + 1).cast("int").alias("k")).drop("i")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimisation jobs: project, scenario, status, creation time and CAPEX."""
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 10 == 0), "PENDING").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 25).alias("project"), F.col("o_orderpriority").alias("scenario"), status.alias("status"), F.col("o_orderdate").alias("created"), F.col("o_totalprice").cast("decimal(16,2)").alias("capex"))


#: The metrics of a candidate design and whether a larger value is better.
METRICS = {"length_m": False, "losses_kw": False, "poles": False, "parcels": False, "crossings": False, "voltage_margin": True}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate designs: cohort, id, whole-number metrics, cost (NULL if incomplete) and electrical state."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        (c % 25).alias("cohort"),
        k.alias("candidate_id"),
        (60000 + k * 7919 % 9000).alias("length_m"),
        (300 + k * 104729 % 60).alias("losses_kw"),
        (560 + k * 31 % 70).alias("poles"),
        (k * 17 % 9).alias("parcels"),
        (k * 13 % 5).alias("crossings"),
        (10 + k * 101 % 40).alias("voltage_margin"),
        F.when(k % 13 != 0, F.col("o_totalprice").cast("decimal(16,2)")).alias("cost"),
        (k % 17 != 0).alias("converged"),
        F.when(k % 19 == 0, 1).otherwise(0).alias("violations"),
        (k % 23 == 0).alias("hard_violation"),
        F.when(k % 5 == 0, "BASELINE").otherwise("SEARCH").alias("strategy"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey features: an external id and a folder path that between them meet every classification rule."""
    k = F.col("p_partkey")
    names = F.array(*[F.lit(x) for x in ("WTG-", "T/", "AP", "GANTRY ", "PSS ", "BH-", "CP_", "Misc ")])
    folders = F.array(*[F.lit(x) for x in ("Project / Approved WTGs", "My Places / Proposed WTG / Points", "Survey / Boreholes", "Evacuation / Towers", "Grid / Substations", "Documents", "Rejected / Turbines", "Temporary Places / Registration")])
    return table(spark, sf_dir, "part").select(k.alias("ordinal"), (F.col("p_size") % 5).alias("project"), F.concat(F.element_at(names, (k % 8 + 1).cast("int")), (k % 400).cast("string")).alias("external_id"), F.element_at(folders, (F.floor(k / 8) % 8 + 1).cast("int")).alias("folder"))
