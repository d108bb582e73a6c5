"""The planned network put together from trees and routes, checked against them and against electrical results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.operators import topology
from windloom.operators.network import KV, ancestors, feeder_tree
from windloom.sources import bindings

#: Tolerances of lengths and endpoints, entries of the evaluation cache.
LENGTH_TOLERANCE, ENDPOINT_TOLERANCE, CACHE_ENTRIES = 1e-3, 1e-6, 1024


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the feeder trees from parent u (0: the substation) to child v, with both ends' places and the straight length."""
    tree = feeder_tree(spark, sf_dir)
    parent = tree.select("project", "feeder", F.col("node").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    edge = tree.join(parent, ["project", "feeder", "parent"], "left")
    ux, uy = F.coalesce("px", F.lit(10000)), F.coalesce("py", F.lit(10000))
    length = F.abs(F.col("x") - ux) + F.abs(F.col("y") - uy)
    return edge.select("project", "feeder", F.col("parent").alias("u"), F.col("node").alias("v"), "turbine_id", ux.alias("ux"), uy.alias("uy"), F.col("x").alias("vx"), F.col("y").alias("vy"), length.alias("length_m"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes found for the edges, in either direction; some are missing, twice there, moved or of another length (test binding)."""
    e, t = tree_edges(spark, sf_dir), F.col("turbine_id")
    back = t % 2 == 0
    ends = [F.when(back, b).otherwise(a) for a, b in ((F.col("u"), F.col("v")), (F.col("v"), F.col("u")), (F.col("ux"), F.col("vx")), (F.col("uy"), F.col("vy")), (F.col("vx"), F.col("ux")), (F.col("vy"), F.col("uy")))]
    moved = F.when(t % 83 == 0, 1).otherwise(0)
    rows = e.where(t % 97 != 0).select("project", "feeder", ends[0].alias("start_node"), ends[1].alias("end_node"), (ends[2] + moved).alias("sx"), ends[3].alias("sy"), ends[4].alias("ex"), ends[5].alias("ey"), (F.col("length_m") + F.when(t % 79 == 0, 5).otherwise(0)).alias("route_m"), t.alias("route_id"))
    twice = rows.where(F.col("route_id") % 89 == 0).withColumn("route_id", -F.col("route_id"))
    stray = rows.where(F.col("route_id") % 101 == 0).withColumn("end_node", F.col("start_node") + 20).withColumn("route_id", F.col("route_id") + 10**9)
    return rows.unionByName(twice).unionByName(stray)


def keyed(rows: DataFrame, a: str, b: str) -> DataFrame:
    """With the canonical key of an undirected edge: its lower and its higher node."""
    return rows.withColumns({"low": F.least(a, b), "high": F.greatest(a, b)})


def feeder_name(feeder: Column) -> Column:
    return F.format_string("FDR-%03d", (feeder + 1).cast("int"))


def assembled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with canonical ids in the order of their edges, the route of each (the least id where there are two) and its direction."""
    found = keyed(routes(spark, sf_dir), "start_node", "end_node").groupBy("project", "feeder", "low", "high").agg(F.min_by(F.struct("start_node", "route_m"), "route_id").alias("r"))
    number = F.row_number().over(Window.partitionBy("project", "feeder").orderBy("u", "v"))
    edges = keyed(tree_edges(spark, sf_dir), "u", "v").withColumn("number", number)
    joined = edges.join(found, ["project", "feeder", "low", "high"])
    name = feeder_name(F.col("feeder"))
    return joined.select("project", F.concat(F.lit("SEG-"), F.replace(name, F.lit("-"), F.lit("")), F.format_string("-%04d", "number")).alias("segment_id"), name.alias("feeder_id"), "u", "v", F.col("r.route_m").alias("length_m"), (F.col("r.start_node") != F.col("u")).alias("is_reversed"), F.when(F.col("u") == 0, "substation_to_turbine").otherwise("turbine_to_turbine").alias("segment_type"))


def route_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the routes of each edge, from a full outer comparison; edges without fault aren't listed."""
    key = ["project", "feeder", "low", "high"]
    edges = keyed(tree_edges(spark, sf_dir), "u", "v").select(*key, "u", "ux", "uy", "vx", "vy", "length_m")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= ENDPOINT_TOLERANCE
    both = keyed(routes(spark, sf_dir), "start_node", "end_node").join(edges, key, "full_outer")
    forward = F.when(F.col("start_node") == F.col("u"), near("sx", "ux") & near("sy", "uy") & near("ex", "vx") & near("ey", "vy")).otherwise(near("sx", "vx") & near("sy", "vy") & near("ex", "ux") & near("ey", "uy"))
    each = both.groupBy(*key).agg(F.count("route_id").alias("n_routes"), F.count("u").alias("n_edges"), F.bool_and(forward).alias("ends"), F.bool_and(F.abs(F.col("route_m") - F.col("length_m")) <= LENGTH_TOLERANCE).alias("length"))
    known = F.col("n_edges") > 0
    fault = F.array(F.when(~known, "UNEXPECTED_ROUTE"), F.when(known & (F.col("n_routes") == 0), "MISSING_ROUTE"), F.when(known & (F.col("n_routes") > 1), "DUPLICATE_ROUTE"), F.when(known & ~F.col("ends"), "ENDPOINT_MISMATCH"), F.when(known & ~F.col("length"), "LENGTH_MISMATCH"))
    return each.select(*key, F.array_join(F.filter(fault, lambda x: x.isNotNull()), ",").alias("faults")).where("faults <> ''")


def network_totals_by_feeder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design read back from the segments: feeders with their nodes in order, turbines and length."""
    rows = assembled_segments(spark, sf_dir)
    nodes = F.array_join(F.array_sort(F.collect_set("v")).cast("array<string>"), " ")  # of one feeder
    return rows.groupBy("project", "feeder_id").agg(nodes.alias("nodes"), F.count("*").alias("n_segments"), F.sum("length_m").alias("length_m"), F.min("segment_id").alias("first_segment"))


def electrical_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Node voltages and segment loadings of a solved network; some are missing, some foreign (test binding)."""
    t = F.col("turbine_id")
    tree = bindings.turbines(spark, sf_dir)
    nodes = tree.where(t % 61 != 0).select("project", "feeder", F.when(t % 59 == 0, F.col("k") + 30).otherwise(F.col("k")).alias("node"), (1_000_000 - t * 7919 % 60_000 + 20_000).alias("micro_pu"))
    segments = tree.where(t % 67 != 0).select("project", "feeder", F.col("k").alias("node"), (t * 104729 % 120_000).alias("loading_milli"), (t * 31 % 5000).alias("loss_w"))
    return nodes, segments


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and segments that only the network or only the electrical result has, by project; all zero where both agree."""
    nodes, segments = electrical_results(spark, sf_dir)
    own = bindings.turbines(spark, sf_dir).select("project", "feeder", F.col("k").alias("node"), F.lit(True).alias("own"))

    def compare(result: DataFrame, name: str) -> DataFrame:
        both = own.join(result.select("project", "feeder", "node", F.lit(True).alias("solved")), ["project", "feeder", "node"], "full_outer")
        return both.groupBy("project").agg(F.count_if(F.col("solved").isNull()).alias(f"{name}_missing"), F.count_if(F.col("own").isNull()).alias(f"{name}_unknown"))

    return compare(nodes, "nodes").join(compare(segments, "segments"), "project")


def feeder_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voltage range, node farthest from nominal and most loaded segment of each feeder; the first one wins a tie."""
    nodes, segments = electrical_results(spark, sf_dir)
    away = F.abs(F.col("micro_pu") - 1_000_000)
    v = nodes.groupBy("project", "feeder").agg(F.min("micro_pu").alias("min_micro_pu"), F.max("micro_pu").alias("max_micro_pu"), F.min_by("node", F.struct(-away, "node")).alias("worst_node"))
    s = segments.groupBy("project", "feeder").agg(F.max("loading_milli").alias("max_loading_milli"), F.min_by("node", F.struct(-F.col("loading_milli"), "node")).alias("most_loaded"), F.sum("loss_w").alias("loss_w"))
    return v.join(s, ["project", "feeder"], "full_outer")


def worst_turbines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turbine of the greatest voltage change and most loaded segment of each project; the greater id wins a tie."""
    nodes, segments = electrical_results(spark, sf_dir)
    away = F.floor(F.abs(F.col("micro_pu") - 1_000_000) / 1000)
    v = nodes.groupBy("project").agg(F.max(F.struct(away.alias("away"), "feeder", "node")).alias("w"))
    s = segments.groupBy("project").agg(F.max(F.struct("loading_milli", "feeder", "node")).alias("m"))
    return v.join(s, "project").select("project", F.col("w.away").alias("change_milli"), F.col("w.feeder").alias("worst_feeder"), F.col("w.node").alias("worst_node"), F.col("m.feeder").alias("loaded_feeder"), F.col("m.node").alias("loaded_node"))


def enriched_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node features with the electrical result put in, rounded for display (pu to 4, kV to 3 digits); NULL where none is known."""
    nodes, _ = electrical_results(spark, sf_dir)
    own = bindings.turbines(spark, sf_dir).select("project", "feeder", F.col("k").alias("node"), "turbine_id")
    pu = F.col("micro_pu").cast("decimal(20,6)") / F.lit(1_000_000).cast("decimal(10,0)")
    joined = own.join(nodes, ["project", "feeder", "node"], "left")
    return joined.select(F.concat(F.lit("wtg-"), F.col("turbine_id").cast("string")).alias("id"), F.bround(pu, 4).cast("decimal(10,4)").alias("voltage_pu"), F.bround(pu * int(KV), 3).cast("decimal(10,3)").alias("voltage_kv"), F.coalesce(F.abs(F.col("micro_pu") - 1_000_000) > 50_000, F.lit(False)).alias("is_violation"))


def engineering_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of each candidate's assessment, or, if any part failed, none of them and the failures in order."""
    k = F.col("candidate_id")
    rows = bindings.candidates(spark, sf_dir).select("cohort", "candidate_id", "converged", F.when(k % 29 == 0, -F.col("length_m")).otherwise(F.col("length_m")).alias("length_m"), F.when(k % 31 != 0, F.col("parcels")).alias("parcels"), F.when(k % 37 != 0, F.col("poles")).alias("poles"), F.when(k % 41 == 0, -1).otherwise(F.col("losses_kw")).alias("losses_kw"), F.when(k % 43 != 0, F.col("voltage_margin")).alias("voltage_margin"))
    electrical = F.when(~F.col("converged"), "LOAD_FLOW_NOT_CONVERGED").when(F.col("voltage_margin").isNull(), "ELECTRICAL_METRICS_MISSING").when(F.col("losses_kw") < 0, "ELECTRICAL_METRICS_INVALID")
    found = F.filter(F.array(F.when(F.col("length_m") < 0, "PHYSICAL_METRICS_INVALID"), F.when(F.col("parcels").isNull(), "SPATIAL_ANALYSIS_FAILED"), F.when(F.col("poles").isNull(), "POLE_PLACEMENT_FAILED"), electrical), lambda x: x.isNotNull())
    rows = rows.withColumn("failures", F.array_join(found, ","))
    whole = F.col("failures") == ""
    return rows.select("cohort", "candidate_id", "failures", *[F.when(whole, F.col(c)).alias(c) for c in ("length_m", "parcels", "poles", "losses_kw", "voltage_margin")])


def topology_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each feeder's edges in canonical order, the same for the same tree; and how many feeders have that tree."""
    edges = keyed(tree_edges(spark, sf_dir), "u", "v")
    text = F.array_join(F.array_sort(F.collect_list(F.format_string("%03d-%03d", F.col("low").cast("int"), F.col("high").cast("int")))), ",")  # of one feeder
    each = edges.groupBy("project", "feeder").agg(F.sha2(text, 256).alias("fingerprint"))
    return each.groupBy("fingerprint").agg(F.count("*").alias("n_feeders"), F.min(F.struct("project", "feeder")).alias("first")).select("fingerprint", "n_feeders", F.col("first.project").alias("first_project"), F.col("first.feeder").alias("first_feeder"))


def reconnect_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each edge taken out of a feeder's tree, the shortest other edge that joins the two parts again (ties: the lower nodes)."""
    tree = feeder_tree(spark, sf_dir).select("project", "feeder", "node", "parent", "x", "y")
    under = ancestors(tree, ["project", "feeder"]).select("project", "feeder", F.col("above").alias("cut"), F.col("node").alias("inner"))
    root = tree.select("project", "feeder").distinct().select("*", F.lit(0).alias("node"), F.lit(10000).cast("long").alias("x"), F.lit(10000).cast("long").alias("y"))
    places = tree.select("project", "feeder", "node", "x", "y").unionByName(root)
    inner = under.join(places.select("project", "feeder", F.col("node").alias("inner"), F.col("x").alias("ix"), F.col("y").alias("iy")), ["project", "feeder", "inner"])
    outer = places.select("project", "feeder", F.col("node").alias("outer"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pairs = inner.join(outer, ["project", "feeder"])  # at most ten by eleven nodes for each of ten edges of a feeder
    pairs = pairs.join(under.select("project", "feeder", "cut", F.col("inner").alias("outer")), ["project", "feeder", "cut", "outer"], "left_anti")
    pairs = pairs.join(tree.select("project", "feeder", F.col("node").alias("cut"), F.col("parent").alias("was")), ["project", "feeder", "cut"]).where("not (inner = cut and outer = was)")
    d = (F.col("ix") - F.col("ox")) * (F.col("ix") - F.col("ox")) + (F.col("iy") - F.col("oy")) * (F.col("iy") - F.col("oy"))
    best = pairs.groupBy("project", "feeder", "cut").agg(F.min(F.struct(d.alias("d"), F.least("inner", "outer").alias("a"), F.greatest("inner", "outer").alias("b"))).alias("e"))
    return best.select("project", "feeder", "cut", F.col("e.a").alias("a"), F.col("e.b").alias("b"), F.col("e.d").alias("distance_sq"))


def mutation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mutations that a search may propose, from the three generators, with the squared length of the new link and a name."""
    text = lambda *parts: F.concat_ws(">", *[F.col(p).cast("string") for p in parts])
    moves = topology.reassign_mutations(spark, sf_dir).select("project", F.lit("reassign").alias("kind"), F.col("d").alias("weight"), text("u", "feeder").alias("name"))
    swaps = topology.swap_mutations(spark, sf_dir).select("project", F.lit("swap").alias("kind"), F.col("d").alias("weight"), text("u", "v").alias("name"))
    links = reconnect_mutations(spark, sf_dir).select("project", F.lit("reconnect").alias("kind"), F.col("distance_sq").alias("weight"), text("feeder", "cut", "a", "b").alias("name"))
    return moves.unionByName(swaps).unionByName(links)


def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the proposals of each search: unique, duplicate, rejected, from the cache, feasible, failed."""
    k = F.col("candidate_id")
    rows = bindings.candidates(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("cohort", "length_m", "poles").orderBy("candidate_id")))
    first = F.col("n") == 1
    reject = first & F.col("hard_violation")
    cached = first & ~F.col("hard_violation") & (k % 6 == 0)
    run = first & ~F.col("hard_violation") & (k % 6 != 0)
    good = F.col("converged") & (F.col("violations") == 0)
    return rows.groupBy("cohort").agg(F.count("*").alias("proposed"), F.count_if(first).alias("unique"), F.count_if(~first).alias("duplicate"), F.count_if(reject).alias("rejected"), F.count_if(cached).alias("cache_hits"), F.count_if(run & good).alias("feasible"), F.count_if(run & ~good).alias("failed"))


def cached_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations that a cache of the newest CACHE_ENTRIES keys still holds when the last third of the proposals comes in, and those to be made."""
    rows = bindings.candidates(spark, sf_dir).select("cohort", "candidate_id", F.concat_ws("/", F.col("length_m").cast("string"), F.col("poles").cast("string"), (F.col("candidate_id") % 2).cast("string")).alias("key"))
    old, new = rows.where("candidate_id % 3 <> 0"), rows.where("candidate_id % 3 = 0")
    held = old.groupBy("key").agg(F.min("candidate_id").alias("entered")).orderBy(F.desc("entered"), "key").limit(CACHE_ENTRIES)
    asked = new.groupBy("key").agg(F.count("*").alias("n_proposals"), F.min("candidate_id").alias("first_id"))
    return asked.join(F.broadcast(held), "key", "left").select("key", "n_proposals", "first_id", F.col("entered").isNotNull().alias("is_hit"))  # CACHE_ENTRIES rows


def candidate_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of text for each candidate."""
    state = F.when(~F.col("converged"), "not converged").when(F.col("violations") > 0, F.format_string("%d violations", F.col("violations").cast("int"))).otherwise("feasible")
    cost = F.coalesce(F.concat(F.col("cost").cast("string"), F.lit(" INR")), F.lit("Not costed"))
    return bindings.candidates(spark, sf_dir).select("candidate_id", F.concat_ws("; ", F.format_string("SCN-%03d", F.col("candidate_id").cast("int")), F.concat(F.col("length_m").cast("string"), F.lit(" m")), F.concat(F.col("poles").cast("string"), F.lit(" poles")), state, cost).alias("summary"))


QUERIES = (assembled_segments, route_coverage, network_totals_by_feeder, reconciliation, feeder_extremes, worst_turbines, enriched_features, engineering_metrics, topology_fingerprints, reconnect_mutations, mutation_chain, search_counters, cached_evaluations, candidate_summaries)
