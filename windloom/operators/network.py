"""Feeder trees, cable sizing, geometry and poles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.sources import bindings

#: Effective ampacity of the catalogue's cables in ampere, in the order of preference.
CABLES = [("C1", 100), ("C2", 160), ("C3", 240), ("C4", 330), ("C5", 430), ("C6", 600), ("C7", 900), ("C8", 1400)]
#: Nominal voltage in kV, power factor, span limits in metres and the least angle of an angle pole.
KV, POWER_FACTOR, TARGET_SPAN, MIN_SPAN, MAX_SPAN, POLE_ANGLE = 33.0, 0.95, 100.0, 30.0, 120.0, 10.0
R_PER_KM, X_PER_KM = 0.03, 0.10
EARTH_M = 6_371_000.0


def geojson_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as GeoJSON text and parsed back with an explicit schema; coordinates out of range are dropped."""
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array((F.col("x") / 100).cast("int"), (F.col("y") / 200).cast("int")).alias("coordinates")).alias("geometry"), F.struct(F.col("turbine_id").cast("string").alias("id"), F.col("kw")).alias("properties")))
    schema = "type string, geometry struct<type:string,coordinates:array<int>>, properties struct<id:string,kw:long>"
    got = bindings.turbines(spark, sf_dir).select(F.from_json(text, schema).alias("f"))
    lon, lat = F.col("f.geometry.coordinates")[0], F.col("f.geometry.coordinates")[1]
    return got.select(F.col("f.properties.id").alias("id"), lon.alias("lon"), lat.alias("lat"), F.col("f.properties.kw").alias("kw")).where("abs(lon) <= 180 and abs(lat) <= 90")


def complete_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of each feeder's complete graph, with the summed squared edge length."""
    t = bindings.turbines(spark, sf_dir).select("project", "feeder", "k", "x", "y")
    edges = t.alias("a").join(t.alias("b"), ["project", "feeder"]).where("a.k < b.k")  # at most ten nodes each
    d = lambda c: F.col(f"a.{c}") - F.col(f"b.{c}")
    return edges.groupBy("project", "feeder").agg(F.count("*").alias("n_edges"), F.sum(d("x") * d("x") + d("y") * d("y")).alias("sum_sq"))


def ancestors(tree: DataFrame, key: list[str]) -> DataFrame:
    """Each node with itself and all nodes above it (``node``, ``above``, ``depth``), in as many rounds as its depth has binary digits.

    A round joins what is known within some distance with the jumps of that distance, and doubles the jumps. Rounds are kept in
    memory or on disk, as the next one reads them twice; a lost part is worked out again. A root's parent is 0.
    """
    jump = tree.where("parent > 0").select(*key, "node", F.col("parent").alias("to")).persist(StorageLevel.MEMORY_AND_DISK)
    out, reach, n = tree.select(*key, "node", F.col("node").alias("above"), F.lit(0).alias("depth")), 1, tree.count()
    while not jump.isEmpty():
        if reach > n:
            raise ValueError("a node is above itself")
        further = jump.join(out.withColumnRenamed("node", "to"), [*key, "to"]).select(*key, "node", "above", (F.col("depth") + reach).alias("depth"))
        out = out.unionByName(further).persist(StorageLevel.MEMORY_AND_DISK)
        jump = jump.join(jump.select(*key, F.col("node").alias("to"), F.col("to").alias("beyond")), [*key, "to"]).select(*key, "node", F.col("beyond").alias("to")).persist(StorageLevel.MEMORY_AND_DISK)
        reach *= 2
    return out


def feeder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.turbines(spark, sf_dir).select("project", "feeder", F.col("k").alias("node"), F.floor(F.col("k") / 2).cast("int").alias("parent"), "kw", "x", "y", "turbine_id")


def _loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = feeder_tree(spark, sf_dir)
    up = ancestors(tree, ["project", "feeder"])
    return up.join(tree.select("project", "feeder", "node", "kw"), ["project", "feeder", "node"]).groupBy("project", "feeder", F.col("above").alias("node")).agg(F.sum("kw").alias("downstream_kw"), F.count("*").alias("n_below"))


def downstream_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power that each node's incoming edge carries: the sum over its subtree."""
    return _loads(spark, sf_dir)


def current_a(kw: Column) -> Column:
    return kw / (3**0.5 * KV * POWER_FACTOR)


def cable_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cable of the catalogue that carries each edge's current; NULL if none does."""
    amps = F.round(current_a(F.col("downstream_kw")), 6)
    pick = F.lit(None).cast("string")
    for name, limit in reversed(CABLES):
        pick = F.when(limit >= F.col("amps") - 1e-6, F.lit(name)).otherwise(pick)
    return _loads(spark, sf_dir).withColumn("amps", amps).select("project", "feeder", "node", F.round("amps", 3).alias("amps"), pick.alias("cable"))


def path_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voltage change from the substation to each turbine: the sum over its path of the edges' changes, in millionths of a percent."""
    tree, key = feeder_tree(spark, sf_dir), ["project", "feeder"]
    parent = tree.select(*key, F.col("node").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    edge = tree.join(parent, [*key, "parent"], "left").join(_loads(spark, sf_dir), [*key, "node"])
    km = (F.abs(F.col("x") - F.coalesce("px", F.lit(10000))) + F.abs(F.col("y") - F.coalesce("py", F.lit(10000)))) / 1000.0
    change = 3**0.5 * current_a(F.col("downstream_kw")) * (R_PER_KM * POWER_FACTOR + X_PER_KM * (1 - POWER_FACTOR**2) ** 0.5) * km / (KV * 1000) * 100
    edge = edge.select(*key, F.col("node").alias("above"), F.round(change * 1e6).cast("long").alias("change"))  # whole numbers add up alike in any order
    return ancestors(tree, key).join(edge, [*key, "above"]).groupBy(*key, "node").agg(F.sum("change").alias("change_micropct"), F.max("depth").alias("depth"))


def nearest(points: DataFrame, places: DataFrame, step: int = 8) -> DataFrame:
    """The nearest place (project, place_id, px, py) of each point (project, point_id, x, y) by squared distance, ties to the lower id; NULL if the project has none.

    Each cell holds the places of the nine cells around it as one array, and a point looks into its cell's, so that no pair is a row and
    nothing is sorted or aggregated by point. A place within one cell's size can't be beaten from outside, so only points without
    such a place go on to cells ``step`` times as large, the last of which reach over everything. The first size follows from
    the places' density: twice the side of the square that holds one of them. Of places at one spot the least id stands for all.
    """
    box = lambda rows, x, y: rows.groupBy("project").agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("n"))
    side = lambda a, b: (F.col(b) - F.col(a)).cast("double")
    places = places.groupBy("project", "px", "py").agg(F.min("place_id").alias("place_id"))
    first = box(places, "px", "py").agg(F.avg(F.sqrt(side("x0", "x1") * side("y0", "y1") / F.col("n")))).first()[0]
    ends = box(places, "px", "py").drop("n").unionByName(box(points, "x", "y").drop("n")).groupBy("project").agg(*[f(c).alias(c) for c, f in (("x0", F.min), ("x1", F.max), ("y0", F.min), ("y1", F.max))])
    reach = ends.agg(F.max(F.greatest(side("x0", "x1"), side("y0", "y1")))).first()[0] or 1.0
    size, n = max(2 * (first or reach), 1.0), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = F.broadcast(places.select("project").distinct())
    left, out = points.join(known, "project", "left_semi"), points.join(known, "project", "left_anti").select("point_id", F.lit(None).cast(places.schema["place_id"].dataType).alias("place_id"))
    d = lambda p: (F.col("x") - p["px"]) * (F.col("x") - p["px"]) + (F.col("y") - p["py"]) * (F.col("y") - p["py"])
    while True:
        last = size > reach
        cell = lambda c: F.floor(F.col(c) / size)  # noqa: B023, E731
        around = F.explode(F.array(*[F.struct((cell("px") + i).alias("cx"), (cell("py") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        held = places.select("*", around.alias("c")).groupBy("project", "c.cx", "c.cy").agg(F.collect_list(F.struct("place_id", "px", "py")).alias("near"))
        at = left.select("project", "point_id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy")).repartition(n, "project", "cx", "cy")  # by a named number, so that Spark doesn't put them together
        best = F.array_min(F.transform("near", lambda p: F.struct(d(p).alias("d"), p["place_id"].alias("place_id"))))
        met = at.join(held, ["project", "cx", "cy"], "left").select("project", "point_id", "x", "y", best.alias("b")).persist(StorageLevel.MEMORY_AND_DISK)
        enough = F.lit(True) if last else F.coalesce(F.col("b.d") <= size * size, F.lit(False))
        out = out.unionByName(met.where(enough).select("point_id", "b.place_id", "b.d"), allowMissingColumns=True)
        if last:
            return out
        left, size = met.where(~enough), size * step


def nearest_substation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a nation's substations to each turbine by squared distance, ties to the lower id."""
    s = bindings.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("place_id"), (F.col("s_suppkey") * 6151 % 20000).alias("px"), (F.col("s_suppkey") * 3079 % 20000).alias("py"))
    t = bindings.turbines(spark, sf_dir).select("project", F.col("turbine_id").alias("point_id"), "x", "y")
    return nearest(t, s).where("place_id is not null").select(F.col("point_id").alias("turbine_id"), F.col("place_id").alias("substation_id"), F.col("d").alias("distance_sq"))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _vertices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Window]:
    return bindings.turbines(spark, sf_dir), Window.partitionBy("project", "feeder").orderBy("k")


def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each feeder's line through its turbines on the sphere (grid units of a ten-thousandth degree)."""
    rows, order = _vertices(spark, sf_dir)
    lon, lat = F.col("x") / 10000.0, F.col("y") / 10000.0
    leg = haversine(F.lag(lon).over(order), F.lag(lat).over(order), lon, lat)
    return rows.withColumn("leg", leg).groupBy("project", "feeder").agg(F.round(F.coalesce(F.sum("leg"), F.lit(0.0)), 2).alias("length_m"), F.count("*").alias("n_vertices"))


def deflection_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn at each inner vertex in degrees, 0 where a leg has no length; and whether an angle pole stands there."""
    rows, order = _vertices(spark, sf_dir)
    near = {f"{c}{d}": (F.lag(c) if d == "0" else F.lead(c)).over(order) for c in "xy" for d in "02"}
    rows = rows.withColumns(near).where("x0 is not null and x2 is not null")
    ax, ay, bx, by = F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (la * lb)))
    angle = F.round(F.when((la < 1e-9) | (lb < 1e-9), 0.0).otherwise(F.degrees(F.acos(cosine))), 4)
    return rows.select("project", "feeder", "k", angle.alias("angle"), (angle >= POLE_ANGLE).alias("angle_pole"))


def span_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each segment: the rounded share of the target span, or more until none is too long."""
    length = F.col("length_m").cast("double")
    n = F.greatest(F.lit(1), F.bround(length / TARGET_SPAN).cast("int"), F.ceil(length / (MAX_SPAN + 1e-9)).cast("int"))
    return bindings.segments(spark, sf_dir).select("segment_id", n.alias("n_spans"), F.round(length / n, 6).alias("span_m"))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turbines in each cell of the cost raster, rows from the top."""
    return bindings.turbines(spark, sf_dir).groupBy("project", F.floor((20000 - F.col("y")) / 500).cast("int").alias("row"), F.floor(F.col("x") / 500).cast("int").alias("col")).agg(F.count("*").alias("n"), F.sum("kw").alias("kw"))


def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turbines inside a fixed restricted area by ray casting, its boundary included."""
    ring = [(2000, 2000), (15000, 4000), (18000, 16000), (9000, 11000), (3000, 17000)]
    x, y, odd, edge = F.col("x"), F.col("y"), F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        edge |= (cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
        hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & ((cross > 0) if y2 > y1 else (cross < 0))
        odd += hit.cast("int")
    return bindings.turbines(spark, sf_dir).select("turbine_id", (edge | (odd % 2 == 1)).alias("inside"))


def login_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user within the fifteen minutes up to each event; five or more would lock."""
    frame = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-900_000_000, 0)
    fails = F.count_if(F.col("event_type") == "error").over(frame)
    return bindings.table(spark, sf_dir, "events").select("event_id", fails.alias("fails"), (fails >= 5).alias("locked"))


def least_tree(xy: np.ndarray, names: list[int]) -> list[tuple[int, int, float]]:
    """Minimum spanning tree of a complete graph; ties by node names, the lower one first.

    Each node outside keeps its best link to the tree, so a step looks at one distance a node.
    """
    names = np.asarray(names)
    rest, out = np.arange(1, len(xy)), []
    link = lambda a, to: (np.hypot(*(xy[to] - xy[a]).T), np.minimum(names[to], names[a]), np.maximum(names[to], names[a]))
    far, low, high = link(0, rest)
    while len(rest):
        k = np.lexsort((high, low, far))[0]
        out.append((int(low[k]), int(high[k]), float(far[k])))
        new, others = rest[k], np.arange(len(rest)) != k
        rest, far, low, high = (v[others] for v in (rest, far, low, high))
        f, lo, hi = link(new, rest)
        better = (f < far) | ((f == far) & ((lo < low) | ((lo == low) & (hi < high))))
        far, low, high = (np.where(better, u, v) for u, v in ((f, far), (lo, low), (hi, high)))
    return out


def feeder_mst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree of least length over each feeder's turbines and the substation (node 0); a feeder is one row of arrays, a task grows batches of these."""
    nodes = bindings.turbines(spark, sf_dir).groupBy("project", "feeder").agg(F.array_sort(F.collect_list(F.struct("turbine_id", "x", "y"))).alias("nodes"))  # of one feeder
    feeders = nodes.select("project", "feeder", *[F.col(f"nodes.{c}").alias(c) for c in ("turbine_id", "x", "y")])

    def grow(batches):
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                xy = np.vstack([[10000.0, 10000.0], np.column_stack([f.x, f.y]).astype(float)])
                rows += [(f.project, f.feeder, a, b, round(d, 3)) for a, b, d in least_tree(xy, [0, *f.turbine_id])]
            yield pd.DataFrame(rows, columns=["project", "feeder", "u", "v", "length_m"])

    return feeders.mapInPandas(grow, "project int, feeder int, u long, v long, length_m double")


QUERIES = (geojson_parse, complete_graph, downstream_power, cable_sizing, path_voltage, nearest_substation, polyline_length, deflection_angles, span_plan, grid_cells, point_in_polygon, login_window, feeder_mst)
