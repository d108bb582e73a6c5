"""Cable and cost catalogues, stored results, and the settings that follow from a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.operators.network import KV, POWER_FACTOR
from windloom.sources import bindings

#: Share of utilisation from which a cable counts as highly used, default soft cost and clearance of a layer.
HIGH_UTILISATION, SOFT_COST, CLEARANCE_M = 85.0, 20.0, 10.0
#: Scenario -> weights (length, loss, loading, margin), multipliers (crossing, parcel, water), extra clearance.
PROFILES = {
    "balanced": (0.40, 0.25, 0.20, 0.15, 1.0, 1.0, 1.0, 0.0),
    "minimum cost": (0.70, 0.12, 0.10, 0.08, 0.5, 0.5, 0.5, 0.0),
    "minimum land impact": (0.40, 0.25, 0.20, 0.15, 1.0, 3.0, 1.0, 0.0),
    "minimum environmental impact": (0.40, 0.25, 0.20, 0.15, 1.0, 1.0, 3.0, 25.0),
}
LABELS = [" Minimum Cost", "minimum land impact ", "MINIMUM ENVIRONMENTAL IMPACT", "Balanced", "", "Fastest"]


def pick(values: list, k: Column) -> Column:
    """The k-th of some constants, from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))


def cables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cable types of each catalogue (test binding)."""
    k = F.col("s_suppkey")
    return bindings.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("CAB-"), k.cast("string")).alias("cable_type_id"),
        F.col("s_nationkey").alias("catalogue"),
        pick([11, 33, 66], k % 3).alias("kv"),
        (100 + k * 37 % 900).alias("max_current_a"),
        (800 + k % 5 * 50).alias("derating_milli"),
        (1 + k % 4).alias("parallel_count"),
        (k % 6 != 0).alias("enabled"),
        pick(["VERIFIED", "SEED", "UNVERIFIED", "VENDOR"], k % 4).alias("provenance"),
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced cable types (test binding): id and rate a kilometre."""
    k = F.col("p_partkey")
    return bindings.table(spark, sf_dir, "part").where("p_size > 20").groupBy(F.concat(F.lit("CAB-"), (k % 1000).cast("string")).alias("cable_type_id")).agg(F.min(F.col("p_retailprice").cast("decimal(14,2)")).alias("rate"))


def catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost catalogues (test binding): id, currency, price date as text (some of them no dates), enabled."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"), F.lit("-"), (k * 7 % 24 + 10).cast("string"))
    return bindings.table(spark, sf_dir, "nation").select(k.alias("catalogue"), F.col("n_name").alias("name"), pick(["INR", "inr ", "EUR"], k % 3).alias("currency"), pick(["Inr", "USD"], k % 2).alias("land_currency"), text.alias("price_date"), (k % 5 != 0).alias("enabled"))


def parsed_date(text: Column) -> Column:
    """The ISO date that a text spells, NULL if there is no such day."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def enabled_cables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled cable types of each voltage in the order of their ampacity."""
    order = Window.partitionBy("kv").orderBy("max_current_a", "cable_type_id")  # a catalogue of cables is small
    return cables(spark, sf_dir).where("enabled").select("kv", F.row_number().over(order).alias("place"), "cable_type_id", "max_current_a")


def effective_ampacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cable type carries with derating and parallel circuits, and the feeder capacity in MW if it is the default."""
    amps = F.round(F.col("max_current_a") * F.col("derating_milli") * F.col("parallel_count") / 1000.0, 3)
    return cables(spark, sf_dir).select("cable_type_id", amps.alias("effective_a"), F.round(3**0.5 * F.col("kv") * amps / 1000 * POWER_FACTOR, 3).alias("feeder_mw"))


def assigned_cables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cable of each segment: the one assigned, or the catalogue's default where none or an unknown one is assigned."""
    default = cables(spark, sf_dir).where("enabled").groupBy("catalogue").agg(F.min_by("cable_type_id", F.struct("max_current_a", "cable_type_id")).alias("default_id"))
    rows = bindings.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 25).cast("int").alias("catalogue"), F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("CAB-"), (F.col("l_suppkey") + F.col("l_linenumber") % 2 * 5000).cast("string"))).alias("assigned"))
    known = cables(spark, sf_dir).select(F.col("cable_type_id").alias("assigned"), F.lit(True).alias("known"))
    chosen = F.when(F.col("known"), F.col("assigned")).otherwise(F.col("default_id"))
    return rows.join(known, "assigned", "left").join(F.broadcast(default), "catalogue", "left").groupBy("catalogue", chosen.alias("cable_type_id")).agg(F.count("*").alias("n_segments"), F.count_if(F.col("known").isNull()).alias("n_default"))  # a default for each of 25 catalogues


def offered_unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled cable types without a rate."""
    return cables(spark, sf_dir).where("enabled").join(rates(spark, sf_dir), "cable_type_id", "left_anti").select("cable_type_id", "catalogue").orderBy("cable_type_id")


def provenance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a catalogue's cable types aren't verified."""
    n, bad = F.count("*"), F.count_if(F.col("provenance").isin("SEED", "UNVERIFIED"))
    return cables(spark, sf_dir).groupBy("catalogue").agg(bad.alias("n_unverified"), n.alias("n_types"), F.when(bad == 0, F.format_string("all %d verified", n)).otherwise(F.format_string("%d of %d unverified", bad, n)).alias("summary"))


def catalogue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled catalogues with both item lists, newest price date first; those without a date come last."""
    poles = F.array_join(F.transform(F.array(F.lit("angle"), F.lit("intermediate"), F.lit("junction"), F.lit("terminal")), lambda c: F.concat(c, F.lit("="), (F.length(c) * 100 + F.col("catalogue")).cast("string"))), " | ")
    items = cables(spark, sf_dir).join(rates(spark, sf_dir), "cable_type_id").groupBy("catalogue").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "cable_type_id", F.col("rate").cast("string")))), " | ").alias("conductors"))  # of one catalogue
    rows = catalogues(spark, sf_dir).where("enabled").join(items, "catalogue", "left").withColumn("date", parsed_date(F.col("price_date")))
    place = F.row_number().over(Window.orderBy(F.col("date").desc_nulls_last(), "catalogue"))  # a row for each catalogue
    return rows.select(place.alias("place"), "catalogue", F.coalesce("conductors", F.lit("")).alias("conductors"), poles.alias("poles"))


def price_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogues(spark, sf_dir).select("catalogue", F.date_format(parsed_date(F.col("price_date")), "yyyy/MM/dd").alias("price_date"), parsed_date(F.col("price_date")).isNull().alias("is_invalid"))


def currency_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a catalogue is in another currency than the lifecycle settings, letters' case aside."""
    other = lambda c: F.lower(F.trim(F.col(c))) != "inr"
    found = F.filter(F.array(F.when(other("currency"), "CATALOGUE_CURRENCY"), F.when(other("land_currency"), "LAND_CURRENCY")), lambda x: x.isNotNull())
    return catalogues(spark, sf_dir).select("catalogue", F.array_join(found, ",").alias("mismatches"), (F.size(found) == 0).alias("accepted"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results (test binding): the answer of each job as JSON text, two candidates and the recommended one's name (NULL for some)."""
    line = bindings.table(spark, sf_dir, "lineitem")
    item = F.struct(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("segment_id"),
        F.when(F.col("l_linestatus") == "O", "conductor").otherwise("pole").alias("category"),
        F.concat(F.lit("C"), (F.col("l_suppkey") % 9).cast("string")).alias("item_id"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.when(F.col("l_linenumber") % 7 != 0, ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 1013) % 10007).cast("long")).alias("load"),
        F.col("l_partkey").alias("parcel_id"),
        pick(["PURCHASE", "LEASE", "EASEMENT"], F.col("l_partkey") % 3).alias("mode"),
    )
    scenario = F.format_string("SCN-%03d", (F.col("l_linenumber") % 2 + 1).cast("int"))
    candidates = line.groupBy("l_orderkey", scenario.alias("scenario_id")).agg(F.collect_list(item).alias("items")).groupBy("l_orderkey").agg(F.collect_list(F.struct("scenario_id", "items")).alias("candidates"))  # of one job
    recommended = F.when(F.col("l_orderkey") % 9 != 0, F.format_string("SCN-%03d", (F.col("l_orderkey") % 3 % 2 + 1).cast("int")))
    return candidates.select(F.col("l_orderkey").alias("job_id"), F.to_json(F.struct(recommended.alias("recommended"), "candidates")).alias("summary"))


_RESULT = "recommended string, candidates array<struct<scenario_id:string,items:array<struct<segment_id:string,category:string,item_id:string,cents:long,load:long,parcel_id:long,mode:string>>>>"


def recommended_items(stored: DataFrame) -> DataFrame:
    """Items of the recommended candidate inside each stored result."""
    read = stored.select("job_id", F.from_json("summary", _RESULT).alias("r"))
    chosen = F.filter("r.candidates", lambda c: c["scenario_id"] == F.col("r.recommended"))
    return read.select("job_id", F.explode(F.flatten(F.transform(chosen, lambda c: c["items"]))).alias("i")).select("job_id", "i.*")


def result_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conductor money of the recommended candidate by item."""
    return recommended_items(results(spark, sf_dir)).where("category = 'conductor'").groupBy("item_id").agg(F.count_distinct("job_id").alias("n_jobs"), F.sum("cents").alias("cents"))


def result_cables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cable and utilisation in percent (half up, two digits) of the recommended candidate's segments, and whether it is high."""
    percent = (F.col("load").cast("decimal(20,6)") * 100 / 10007).cast("decimal(20,6)")
    shown = F.round(percent, 2).cast("decimal(10,2)")
    return recommended_items(results(spark, sf_dir)).where("category = 'conductor'").select("job_id", "segment_id", F.col("item_id").alias("cable"), shown.alias("utilisation_pct"), F.coalesce(shown >= HIGH_UTILISATION, F.lit(False)).alias("is_high"))


def recommended_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land decisions of the recommended candidates: parcels and jobs by mode."""
    return recommended_items(results(spark, sf_dir)).groupBy("mode").agg(F.count_distinct("parcel_id").alias("n_parcels"), F.count_distinct("job_id").alias("n_jobs"), F.count("*").alias("n_decisions"))


def scenario_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs and clearances of each layer under each scenario label; unknown and blank labels are Balanced."""
    rows = bindings.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("layer"), pick(["road", "watercourse", "parcel", "restricted"], F.col("n_nationkey") % 4).alias("kind"), F.when(F.col("n_nationkey") % 3 != 0, (F.col("n_nationkey") + 5).cast("double")).alias("imported"))
    labels = rows.select("*", F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("label"))
    key = F.lower(F.trim("label"))
    of = lambda i: F.coalesce(*[F.when(key == name, F.lit(p[i])) for name, p in PROFILES.items()], F.lit(PROFILES["balanced"][i]))
    cost = F.when(F.col("kind") == "road", F.coalesce("imported", F.lit(SOFT_COST)) * of(4)).when(F.col("kind") == "watercourse", F.coalesce("imported", F.lit(SOFT_COST)) * of(6)).when(F.col("kind") == "parcel", SOFT_COST * of(5))
    return labels.select("layer", "label", cost.alias("cost"), F.when(F.col("kind") == "restricted", F.coalesce("imported", F.lit(CLEARANCE_M)) + of(7)).alias("clearance_m"), of(0).alias("length_weight"))


def request_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voltage band from a tolerance, and spans from the greatest span, of each project."""
    t, span = F.col("n_nationkey") * 0.05, (100 + F.col("n_nationkey") * 5).cast("double")
    return bindings.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project"), F.round(F.greatest(F.lit(0.001), 1 - t), 6).alias("min_pu"), F.round(1 + t, 6).alias("max_pu"), F.round(span * 100 / 120, 6).alias("target_span_m"), F.round(span * 30 / 120, 6).alias("min_span_m"))


def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and reactive power of each turbine (leading is negative) and the current that its cable must carry."""
    p = F.col("kw") / 1000.0
    mode = pick(["lagging", "leading", "none"], F.col("turbine_id") % 3)
    s = p / POWER_FACTOR
    q = F.sqrt(s * s - p * p) * F.when(mode == "lagging", 1.0).when(mode == "leading", -1.0).otherwise(0.0)
    apparent = F.when(q != 0, F.sqrt(p * p + q * q)).otherwise(p / POWER_FACTOR)
    return bindings.turbines(spark, sf_dir).select("turbine_id", F.round(p, 6).alias("p_mw"), F.round(q, 6).alias("q_mvar"), F.round(apparent * 1000 / (3**0.5 * KV), 4).alias("amps"))


def policy_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group weights of a request: its own groups, or else the four legacy weights turned into groups and shares."""
    w = [(F.col("n_nationkey") * k % 7).cast("double") for k in (3, 5, 2, 1)]
    electrical = w[1] + w[2] + w[3]
    legacy = F.col("n_nationkey") % 4 != 0
    share = lambda x: F.round(F.when(legacy, F.when(electrical > 0, x / electrical).otherwise(0.0)).otherwise(0.25), 9)
    return bindings.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("request"), F.when(legacy, "LEGACY_COMPATIBILITY").otherwise("UNIFIED_ENGINEERING").alias("policy"), F.when(legacy, w[0]).otherwise(0.3).alias("physical"), F.when(legacy, 0.0).otherwise(0.3).alias("spatial"), F.when(legacy, electrical).otherwise(0.25).alias("electrical"), share(w[1]).alias("loss_share"), share(w[2]).alias("loading_share"), share(w[3]).alias("margin_share"))


QUERIES = (enabled_cables, effective_ampacity, assigned_cables, offered_unpriced, provenance_summary, catalogue_scan, price_dates, currency_mismatches, result_costs, result_cables, recommended_land, scenario_settings, request_settings, operating_points, policy_weights)
