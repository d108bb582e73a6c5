"""What a survey or a request must pass before it is planned: parsing, aliases, overrides, guards and the moves between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.operators.catalogue import pick
from windloom.operators.survey_rules import normalised_id
from windloom.sources import bindings

#: Statuses that may be planned, line types whose crossing costs, limits of a request.
OPTIMISABLE, CROSSED, MAX_TURBINES, MAX_CELLS = ("APPROVED", "REGISTRATION", "PROPOSED"), ("ROAD", "HT_LINE", "WATERCOURSE"), 500, 15_000_000
#: Spellings of asset and line types besides their own names.
ASSET_TYPES = ("WTG", "SUBSTATION", "EVACUATION_TOWER", "SURVEY_POINT", "PARCEL", "RESTRICTED_AREA", "REFERENCE_LINE")
ASSET_ALIASES = {
    "EVACUATION_TOWER": ("TOWER", "TOWERS", "EVACUATION_TOWERS", "TRANSMISSION_TOWER", "GANTRY"),
    "WTG": ("TURBINE", "WIND_TURBINE", "WEC"),
    "SUBSTATION": ("SUB", "PSS", "SUBSTATIONS", "GRID_SUBSTATION"),
    "SURVEY_POINT": ("BOREHOLE", "GEOTECH", "SURVEY"),
    "PARCEL": ("PARCELS", "LAND", "CADASTRAL_PARCEL", "PLOT"),
    "RESTRICTED_AREA": ("RESTRICTED", "RESTRICTED_AREAS", "EXCLUSION", "EXCLUSION_ZONE"),
    "REFERENCE_LINE": ("LINE", "REFERENCE_LINES", "ROAD", "HT_LINE"),
}
LINE_TYPES = ("ROAD", "HT_LINE", "EVACUATION_ROUTE", "WATERCOURSE", "MEASUREMENT")
LINE_ALIASES = {
    "ROAD": ("HIGHWAY", "TRACK", "B.T.ROAD", "BT_ROAD"),
    "HT_LINE": ("TRANSMISSION_LINE", "EHV", "EHV_LINE", "POWER_LINE"),
    "EVACUATION_ROUTE": ("PCN", "COLLECTOR", "FEEDER", "ROUTE"),
    "WATERCOURSE": ("RIVER", "CANAL", "STREAM", "WATER"),
}
#: Words of names and folders that tell a restriction, in the order of judging.
RESTRICTIONS = [("WATER_BODY", ("RIVER", "RESERVOIR", "CANAL", "TANK")), ("PROTECTED_AREA", ("FOREST", "SANCTUARY", "WILDLIFE")), ("SETTLEMENT", ("VILLAGE", "SETTLEMENT")), ("AVIATION", ("RADAR", "AIRPORT"))]
SPELLINGS = ["wind turbine", " PSS", "gantry", "Grid-Substation", "plot", "exclusion zone", "ht line", "B.T.Road", "river", "pcn", "wtg", "", "measurement", "survey"]
NAMES = ["GANTRY", "AP 34", "2/1", "12 / 7-2", "TOWER-9", "220KV Line", "133 KV", "WTG-5", "Village tank", "Reserve FOREST", "Old airport", "Quarry"]


def alias(value: Column, names: tuple[str, ...], aliases: dict[str, tuple[str, ...]]) -> Column:
    """The type that a spelling stands for; UNKNOWN if it is blank or unknown."""
    token = F.translate(F.upper(F.trim(value)), " -", "__")
    known = {n: t for t, spelled in aliases.items() for n in spelled} | {n: n for n in names}
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, token), F.lit("UNKNOWN"))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey features with one of NAMES and one of SPELLINGS (test binding)."""
    k = F.col("p_partkey")
    return bindings.table(spark, sf_dir, "part").select(k.alias("ordinal"), pick(NAMES, k % len(NAMES)).alias("name"), pick(SPELLINGS, k % len(SPELLINGS)).alias("spelled"), pick(["Site / Canal", "Site / Towers", "Wildlife / Areas", None], k % 4).alias("folder"))


def type_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).groupBy("spelled", alias(F.col("spelled"), ASSET_TYPES, ASSET_ALIASES).alias("asset_type"), alias(F.col("spelled"), LINE_TYPES, LINE_ALIASES).alias("line_type")).agg(F.count("*").alias("n"))


def name_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tower type, line section, voltage class and restriction that names and folders tell."""
    name = F.trim("name")
    section = F.when(name.rlike(r"^\d+\s*/\s*\d+(-\d+)?$"), F.regexp_extract(name, r"^(\d+)\s*/", 1))
    tower = F.when(F.upper(name) == "GANTRY", "GANTRY").when(name.rlike(r"(?i)^AP[\s_-]*\d+(-\d+)?$"), "ANGLE_POINT").when(section.isNotNull(), "SUSPENSION")
    voltage = F.when(F.col("name").rlike(r"(?i)\d+\s*kv"), F.regexp_extract("name", r"(?i)(\d+)\s*kv", 1).cast("int"))
    text = F.upper(F.concat_ws(" ", "name", F.coalesce("folder", F.lit(""))))
    restriction = F.coalesce(*[F.when(text.rlike("|".join(words)), F.lit(kind)) for kind, words in RESTRICTIONS], F.lit("RESTRICTED"))
    return named(spark, sf_dir).groupBy("name", "folder", tower.alias("tower_type"), section.alias("line_section"), voltage.alias("voltage_kv"), restriction.alias("restriction")).agg(F.count("*").alias("n"))


def optimisable_turbines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turbines of each project that may be planned, and whether a request of them passes the size limit."""
    rows = bindings.turbines(spark, sf_dir).where(F.col("status").isin(*OPTIMISABLE))
    return rows.groupBy("project").agg(F.count("*").alias("n_turbines"), F.sum("kw").alias("kw"), (F.count("*") <= MAX_TURBINES).alias("accepted"))


def crossing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose crossing costs."""
    kind = alias(F.col("spelled"), LINE_TYPES, LINE_ALIASES)
    return named(spark, sf_dir).where(kind.isin(*CROSSED)).select("ordinal", kind.alias("line_type"))


def request_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of requests as GeoJSON text, with blank ids, repeated ids, capacities that are none and places off the globe (test binding)."""
    k = F.col("c_custkey")
    point = F.struct(F.lit("Point").alias("type"), F.array((k * 7919 % 400 - 200) / 1.0, (k * 104729 % 200 - 100) / 1.0).alias("coordinates"))
    capacity = F.when(k % 11 == 0, "NaN").when(k % 13 == 0, "true").when(k % 17 == 0, "-1").when(k % 19 != 0, (2 + k % 4).cast("string"))
    named = F.when(k % 2 == 0, F.struct(F.concat(F.lit("T"), (k % 997).cast("string")).alias("turbine_id"), F.lit(None).cast("string").alias("id"), capacity.alias("capacity_mw"))).otherwise(F.struct(F.lit(None).cast("string").alias("turbine_id"), F.when(k % 23 == 0, " ").otherwise(F.concat(F.lit("T"), (k % 997).cast("string"))).alias("id"), capacity.alias("capacity_mw")))
    whole = F.to_json(F.struct(F.lit("Feature").alias("type"), named.alias("properties"), point.alias("geometry")))
    return bindings.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project"), k.alias("ordinal"), F.when(k % 29 == 0, F.to_json(point)).otherwise(whole).alias("feature"))


_POINT = "type string, coordinates array<double>, properties map<string,string>, geometry struct<type:string,coordinates:array<double>>"


def repeated(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows with ``is_repeated``: whether another one has the same values of ``by``; never so if ``name``, one of these, is blank or NULL.

    Values are counted by partial aggregates and the repeated ones joined back, so that no task gets all rows of a value; blank
    ones take no part.
    """
    named = F.when(F.col(name) != "", F.col(name))
    twice = rows.where(F.col(name) != "").groupBy(*[F.col(c).alias(f"same_{c}") for c in by]).agg(F.count("*").alias("n_same")).where("n_same > 1")
    on = [F.col(f"same_{c}") == (named if c == name else F.col(c)) for c in by]
    return rows.join(twice, on, "left").select(*rows.columns, F.col("n_same").isNotNull().alias("is_repeated"))


def request_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each point of a request; a bare geometry is a point without properties."""
    read = request_points(spark, sf_dir).withColumn("f", F.from_json("feature", _POINT))
    at = F.coalesce("f.geometry.coordinates", "f.coordinates")
    prop = lambda *names: F.coalesce(*[F.try_element_at(F.col("f.properties"), F.lit(n)) for n in names])
    rows = read.select("project", "ordinal", F.trim(prop("turbine_id", "id")).alias("id"), prop("capacity_mw").alias("capacity"), at[0].alias("lon"), at[1].alias("lat"))
    number = F.expr("try_cast(capacity as double)")
    rows = repeated(rows, ["project", "id"], "id")
    found = F.array(
        F.when(F.coalesce("id", F.lit("")) == "", "BLANK_ID"),
        F.when(F.col("is_repeated"), "DUPLICATE_ID"),
        F.when(F.col("capacity").isNotNull() & (number.isNull() | F.isnan(number) | (number <= 0)), "CAPACITY"),
        F.when((F.abs("lon") > 180) | (F.abs("lat") > 90), "COORDINATES"),
    )
    return rows.select("ordinal", "id", F.array_join(F.filter(found, lambda x: x.isNotNull()), ",").alias("violations"))


def raster_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution of each project's raster: coarsened to whole metres until its cells are few enough; rejected if still too many."""
    pad, fine = 1000, 1
    box = bindings.turbines(spark, sf_dir).groupBy("project").agg((F.max("x") - F.min("x") + 2 * pad).alias("w"), (F.max("y") - F.min("y") + 2 * pad).alias("h"))
    cells = lambda r: F.ceil(F.col("w") / r) * F.ceil(F.col("h") / r)
    resolution = F.when(cells(F.lit(fine)) > MAX_CELLS, F.ceil(fine * F.sqrt(cells(F.lit(fine)) / MAX_CELLS))).otherwise(F.lit(fine)).cast("long")
    rows = box.withColumn("resolution_m", resolution)
    return rows.select("project", "resolution_m", cells(F.col("resolution_m")).alias("cells"), (cells(F.col("resolution_m")) <= MAX_CELLS).alias("accepted"))


def cohort_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts whose candidates repeat an id or a topology, or mix economic contexts."""
    rows = bindings.candidates(spark, sf_dir).select("cohort", F.col("candidate_id") % 900, "length_m", "poles", (F.col("candidate_id") % 7 == 0).alias("context")).toDF("cohort", "id", "length_m", "poles", "context")
    each = rows.groupBy("cohort").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("length_m", "poles").alias("topologies"), F.count_distinct("context").alias("contexts"))
    found = F.array(F.when(F.col("n") > F.col("ids"), "DUPLICATE_ID"), F.when(F.col("n") > F.col("topologies"), "DUPLICATE_TOPOLOGY"), F.when(F.col("contexts") > 1, "MIXED_COHORT"))
    return each.select("cohort", F.array_join(F.filter(found, lambda x: x.isNotNull()), ",").alias("errors"), (F.col("n") - F.col("ids")).alias("n_repeated"))


def unresolved_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names tell no type, and the first ten of them."""
    rows = named(spark, sf_dir).where(alias(F.col("spelled"), ASSET_TYPES, ASSET_ALIASES) == "UNKNOWN")
    first = rows.orderBy("ordinal").limit(10).agg(F.array_join(F.array_sort(F.collect_list("ordinal")).cast("array<string>"), ", ").alias("sample"))  # ten rows
    return rows.agg(F.count("*").alias("n_unresolved")).crossJoin(first)  # one row each


def overridden_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of each feature: an override of its exact id, else of its normalised id, else the classified one."""
    rows = bindings.features(spark, sf_dir).select("ordinal", "external_id", normalised_id(F.col("external_id")).alias("key"))
    chosen = bindings.table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("WTG-"), (F.col("p_partkey") % 400).cast("string"))).otherwise(F.concat(F.lit("bh "), (F.col("p_partkey") % 400).cast("string"))).alias("name"), pick(["wec", "pss", "nonsense"], F.col("p_partkey") % 3).alias("spelled"))
    exact = chosen.groupBy("name").agg(F.min("spelled").alias("exact"))
    loose = chosen.groupBy(normalised_id(F.col("name")).alias("key")).agg(F.min("spelled").alias("loose"))
    joined = rows.join(exact, F.col("external_id") == F.col("name"), "left").join(loose, "key", "left")
    override = alias(F.coalesce("exact", "loose"), ASSET_TYPES, ASSET_ALIASES)
    return joined.groupBy(F.when(override != "UNKNOWN", override).otherwise("classified").alias("resolved"), F.col("exact").isNotNull().alias("is_exact")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first_ordinal"))


def moved_towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that move from the turbines to the towers, with tower type and line section, and those that stay."""
    name = F.trim("name")
    moves = name.rlike(r"(?i)^\d+\s*/\s*\d+(-\d+)?$|^AP[\s_-]*\d+(-\d+)?$|^GANTRY(-\d+)?$|^TOWER[\s_-]*\d+(-\d+)?$")
    tower = F.when(name.rlike(r"(?i)^GANTRY(-\d+)?$"), "GANTRY").when(name.rlike(r"(?i)^AP[\s_-]*\d+(-\d+)?$"), "ANGLE_POINT").otherwise("SUSPENSION")
    section = F.when(name.rlike(r"^\d+\s*/"), F.regexp_extract(name, r"^(\d+)\s*/", 1))
    rows = named(spark, sf_dir)
    towers = rows.where(moves).select("ordinal", F.lit("evacuation_towers").alias("stored_in"), tower.alias("tower_type"), section.alias("line_section"))
    stay = rows.where(~moves).select("ordinal", F.lit("wtg_locations").alias("stored_in"), F.lit(None).cast("string").alias("tower_type"), F.lit(None).cast("string").alias("line_section"))
    return towers.unionByName(stay)


def translated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result features under the names of the first version: segments and poles only."""
    rows = bindings.segments(spark, sf_dir).select("segment_id", F.concat(F.lit("FDR-"), F.coalesce(F.col("feeder").cast("string"), F.lit("X"))).alias("feeder_id"), "length_m", pick(["pnc_segment", "pnc_pole", "pnc_wtg"], F.col("l_linenumber") % 3).alias("feature_type"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"))
    props = F.to_json(F.struct("feature_type", F.when(F.col("feature_type") == "pnc_segment", F.col("feeder_id")).alias("feeder_id"), F.when(F.col("feature_type") == "pnc_pole", F.array("feeder_id")).alias("connected_feeder_ids"), F.col("a").alias("from_node"), F.col("b").alias("to_node"), "length_m"))
    read = rows.select("segment_id", F.from_json(props, "feature_type string, feeder_id string, connected_feeder_ids array<string>, from_node long, to_node long, length_m decimal(12,2)").alias("p"))
    kept = read.where(F.col("p.feature_type").isin("pnc_segment", "pnc_pole"))
    is_segment = F.col("p.feature_type") == "pnc_segment"
    return kept.select("segment_id", F.when(is_segment, F.col("p.feeder_id")).otherwise(F.col("p.connected_feeder_ids")[0]).alias("feederName"), F.when(is_segment, F.concat_ws("-", F.col("p.from_node").cast("string"), F.col("p.to_node").cast("string"))).alias("edge"), F.when(is_segment, F.col("p.length_m")).alias("traversal_cost"))


def enabled_admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled administrators of each nation, and whether one more may be disabled."""
    admin = (F.col("c_custkey") % 7 == 0) & (F.col("c_acctbal") > 0)
    return bindings.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("tenant")).agg(F.count_if(admin).alias("n_admins"), (F.count_if(admin) > 1).alias("may_disable"))


def constraint_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, parcels and restricted areas as one collection, sorted by id; ids carry their source's prefix."""
    part = named(spark, sf_dir)
    lines = part.where(alias(F.col("spelled"), LINE_TYPES, LINE_ALIASES).isin(*CROSSED)).select(F.concat(F.lit("line-"), F.col("ordinal").cast("string")).alias("layer_id"), F.lit("soft").alias("mode"))
    parcels = bindings.table(spark, sf_dir, "supplier").select(F.concat(F.lit("parcel-"), F.col("s_suppkey").cast("string")).alias("layer_id"), F.lit("soft").alias("mode"))
    areas = bindings.table(spark, sf_dir, "nation").select(F.concat(F.lit("restricted-"), F.col("n_nationkey").cast("string")).alias("layer_id"), F.lit("hard").alias("mode"))
    return lines.unionByName(parcels).unionByName(areas).orderBy("layer_id")


def layer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id of each layer: the first of three properties that is there, else a hash of the feature; and whether it is taken twice."""
    k = F.col("o_orderkey")
    first = F.when(k % 3 == 0, F.concat(F.lit("c"), (k % 5000).cast("string")))
    second = F.when(k % 4 == 0, F.concat(F.lit(" l"), k.cast("string")))
    third = F.when(k % 5 == 0, F.lit(" "))
    digest = F.concat(F.lit("constraint-"), F.substring(F.sha2(F.concat_ws("|", F.lit("order"), k.cast("string"), "o_orderpriority"), 256), 1, 16))
    rows = bindings.table(spark, sf_dir, "orders").select(k.alias("feature"), F.trim(F.coalesce(first, second, third, digest)).alias("layer_id"))
    rows = repeated(rows, ["layer_id"], "layer_id")
    return rows.select("feature", "layer_id", F.when(F.col("layer_id") == "", "EMPTY_ID").when(F.col("is_repeated"), "DUPLICATE_ID").alias("error"))


def same_point_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of one key at one point become one, that of the shortest id, then the least; others stay apart."""
    k = F.col("c_custkey")
    rows = bindings.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project"), F.concat(F.lit("WTG "), (k % 40).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("-"), (k % 9).cast("string"))).otherwise("")).alias("external_id"), (k % 4).alias("x"), (k % 3).alias("y"), k.alias("row_id"))
    key = F.upper(F.regexp_replace(F.regexp_replace("external_id", r"-\d+$", ""), r"[\s_\-.]", ""))
    first = F.row_number().over(Window.partitionBy("project", "key", "x", "y").orderBy(F.length("external_id"), "external_id", "row_id"))
    return rows.withColumn("key", key).withColumn("n", first).where("n = 1").select("project", "key", "x", "y", "external_id", "row_id")


QUERIES = (type_aliases, name_attributes, optimisable_turbines, crossing_lines, request_violations, raster_guard, cohort_guard, unresolved_sample, overridden_types, moved_towers, translated_features, enabled_admins, constraint_union, layer_ids, same_point_collapse)
