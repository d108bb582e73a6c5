"""Polygon constraint layers: scan, clearance, raster, endpoints; land as routing cost; poles along bent routes.

Coordinates are whole metres, so that every test (inside, within a distance, touching a cell) is exact.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from windloom.operators.catalogue import pick
from windloom.operators.decide import land_decision
from windloom.operators.network import MAX_SPAN, MIN_SPAN, TARGET_SPAN, deflection_angles
from windloom.sources import bindings

#: Penalty of an interaction with an owner, and the share of a parcel's present value that routing pays.
OWNER_PENALTY, VALUE_SHARE = 20.0, 1e-4
#: Cells of the spatial join and of the raster, in metres, and the width of the surface that is rasterised (test binding).
CELL, SITE = 500, 20000


def ring_of(cx: Column, cy: Column, r: Column) -> Column:
    """Five corners, the fourth one drawn in to the centre."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((cx - r, cy - r), (cx + r, cy - r), (cx + r, cy + r), (cx, cy), (cx - r, cy + r))])


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of each project (test binding): ring, clearance, mode, weight of the soft ones."""
    k = F.col("s_suppkey")
    ring = ring_of(k * 6151 % 18000 + 1000, k * 3079 % 18000 + 1000, 600 + k % 5 * 400)
    return bindings.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project"), k.alias("layer"), ring.alias("ring"), (k % 3 * 40).alias("buffer_m"), (k % 4 != 0).alias("is_hard"), F.when(k % 4 == 0, 5 + k % 7).alias("weight"))


def layer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers read from GeoJSON text: area of each, or what is wrong with it."""
    k = F.col("layer")
    at = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    closed = F.when(k % 13 != 0, F.concat(at, F.slice(at, 1, 1))).otherwise(at)
    geometry = F.struct(F.when(k % 17 == 0, "Point").otherwise("Polygon").alias("type"), F.array(F.when(k % 19 == 0, F.slice(closed, 1, 3)).otherwise(closed)).alias("coordinates"))
    props = F.struct(F.concat(F.lit("L"), F.when(k % 23 == 0, k - 1).otherwise(k).cast("string")).alias("layer_id"), F.when(F.col("is_hard"), "hard").otherwise("soft").alias("mode"), F.when((k % 29 == 0) | ~F.col("is_hard"), 7).alias("cost_weight"))
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry")))
    schema = "type string, properties struct<layer_id:string,mode:string,cost_weight:double>, geometry struct<type:string,coordinates:array<array<array<long>>>>"
    rows = polygons(spark, sf_dir).select("project", "layer", F.from_json(text, schema).alias("f")).select("project", "layer", "f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates")[0].alias("p"))
    twice = F.count("*").over(Window.partitionBy("project", "layer_id")) > 1
    error = F.when(F.col("kind") != "Polygon", "UNSUPPORTED_TYPE").when(F.size("p") < 4, "TOO_FEW_POSITIONS").when(F.element_at("p", 1) != F.element_at("p", -1), "NOT_CLOSED").when(twice, "DUPLICATE_ID").when((F.col("mode") == "hard") & F.col("cost_weight").isNotNull(), "HARD_WITH_COST")
    legs = F.zip_with("p", F.slice("p", 2, F.size("p") - 1), lambda a, b: F.coalesce(a[0] * b[1] - b[0] * a[1], F.lit(0)))
    twice_area = F.abs(F.aggregate(legs, F.lit(0).cast("long"), lambda s, x: s + x))
    return rows.select("layer", "layer_id", error.alias("error"), F.when(error.isNull(), twice_area / 2).alias("area_m2"))


def edges_of(rows: DataFrame) -> DataFrame:
    """A row for each edge (x1, y1, x2, y2) of each row's ring."""
    nxt = lambda i: F.col("ring")[F.pmod(i + 1, F.size("ring"))]
    edge = F.transform("ring", lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), nxt(i)["x"].alias("x2"), nxt(i)["y"].alias("y2")))
    return rows.withColumn("e", F.explode(edge)).select(*[c for c in rows.columns if c != "ring"], "e.*")


def _ends(edge: Column | None) -> list[Column]:
    return [F.col(c) if edge is None else edge[c] for c in ("x1", "y1", "x2", "y2")]


def crosses(x: Column, y: Column, edge: Column | None = None) -> Column:
    """Whether a ray from (x, y) to the right meets the edge (a struct, or else the row's)."""
    x1, y1, x2, y2 = _ends(edge)
    side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    return ((y1 > y) != (y2 > y)) & F.when(y2 > y1, side > 0).otherwise(side < 0)


def within(x: Column, y: Column, reach: Column, edge: Column | None = None) -> Column:
    """Whether (x, y) is within ``reach`` of the edge (a struct, or else the row's)."""
    x1, y1, x2, y2 = _ends(edge)
    dot, size = (x - x1) * (x2 - x1) + (y - y1) * (y2 - y1), (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    return F.when(dot <= 0, (x - x1) * (x - x1) + (y - y1) * (y - y1) <= reach * reach).when(dot >= size, (x - x2) * (x - x2) + (y - y2) * (y - y2) <= reach * reach).otherwise(side * side <= reach * reach * size)


def cells_of(rows: DataFrame) -> DataFrame:
    """A row (col, row) for each cell that the bounding box of ring and clearance meets, wherever it lies."""
    low = lambda c: F.ceil((F.array_min(F.transform("ring", lambda p: p[c])) - F.col("buffer_m")) / CELL) - 1
    high = lambda c: F.floor((F.array_max(F.transform("ring", lambda p: p[c])) + F.col("buffer_m")) / CELL)
    return rows.withColumn("col", F.explode(F.sequence(low("x"), high("x")))).withColumn("row", F.explode(F.sequence(low("y"), high("y"))))


def _outline(ring: list) -> np.ndarray:
    return np.array([(p["x"], p["y"], q["x"], q["y"]) for p, q in zip(ring, [*ring[1:], *ring[:1]])])


def _cover(points: pa.Table, layers: pa.Table, most: int = 2_000_000) -> pa.Table:
    """Pairs (turbine_id, layer) of the points and layers of one cell, by the tests of ``crosses`` and ``within``."""
    at = [points[c].to_numpy() for c in ("x", "y")]
    found_points, found_layers = [], []
    for number, (ring, reach) in enumerate(zip(layers["ring"].to_pylist(), layers["buffer_m"].to_pylist())):
        if not ring or reach is None or any(p["x"] is None or p["y"] is None for p in ring):
            continue
        x1, y1, x2, y2 = (c[:, None] for c in _outline(ring).T)
        low, high = (np.minimum(x1, x2).min() - reach, np.minimum(y1, y2).min() - reach), (np.maximum(x1, x2).max() + reach, np.maximum(y1, y2).max() + reach)
        near = np.flatnonzero((at[0] >= low[0]) & (at[0] <= high[0]) & (at[1] >= low[1]) & (at[1] <= high[1]))
        step = max(1, most // len(ring))
        for some in (near[k : k + step] for k in range(0, len(near), step)):
            x, y = at[0][some], at[1][some]
            side = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
            odd = (((y1 > y) != (y2 > y)) & np.where(y2 > y1, side > 0, side < 0)).sum(axis=0) % 2 == 1
            dot, size = (x - x1) * (x2 - x1) + (y - y1) * (y2 - y1), (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
            to = lambda a, b: (x - a) * (x - a) + (y - b) * (y - b) <= reach * reach
            close = np.where(dot <= 0, to(x1, y1), np.where(dot >= size, to(x2, y2), side * side <= reach * reach * size))
            inside = some[odd | close.any(axis=0)]
            found_points.append(inside)
            found_layers.append(np.full(len(inside), number))
    rows, numbers = (np.concatenate(f) if f else np.array([], np.int64) for f in (found_points, found_layers))
    return pa.table({"turbine_id": points["turbine_id"].take(pa.array(rows)), "layer": layers["layer"].take(pa.array(numbers))})


def covering(points: DataFrame, layers: DataFrame) -> DataFrame:
    """Points (project, turbine_id, x, y) and the layers that cover them, clearance and boundary included; met by cells, no other pairs."""
    cell = lambda c: F.floor(F.col(c) / CELL)
    here = points.where("x is not null and y is not null").select("project", "turbine_id", "x", "y", cell("x").alias("col"), cell("y").alias("row"))
    there = cells_of(layers.select("project", "layer", "ring", "buffer_m")).withColumnsRenamed({"project": "in_project", "col": "in_col", "row": "in_row"})
    schema = T.StructType([here.schema["turbine_id"], there.schema["layer"]])
    return here.groupBy("project", "col", "row").cogroup(there.groupBy("in_project", "in_col", "in_row")).applyInArrow(lambda a, b: _cover(a, b), schema)  # a point lies in one cell


def places_of(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with the place (a struct: project, x, y) where they stand, and a point at each of these, so that those at one place are tested once."""
    at = F.struct("project", "x", "y")
    rows = points.withColumn("place", at)
    return rows, rows.select("project", "x", "y").distinct().select("project", at.alias("turbine_id"), "x", "y")


def hard_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turbines that a hard layer with its clearance covers, and the layers."""
    turbines, places = places_of(bindings.turbines(spark, sf_dir).select("project", "turbine_id", "x", "y"))
    covered = covering(places, polygons(spark, sf_dir).where("is_hard")).withColumnRenamed("turbine_id", "place")
    found = covered.groupBy("place").agg(F.count("*").alias("n_layers"), F.array_join(F.array_sort(F.collect_list("layer")).cast("array<string>"), ",").alias("layers"))  # of one place
    return turbines.join(found, "place").select("turbine_id", "n_layers", "layers")


def raster(layers: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Cells of each project's surface (project, west, south, east, north in metres) that layers with their clearance touch in any point: blocked if one is hard, and the summed weight of the soft ones."""
    inside = lambda c, low, high: (F.col(c) * CELL < F.col(high)) & ((F.col(c) + 1) * CELL > F.col(low))
    on = cells_of(layers).join(surfaces, "project")
    cells = edges_of(on.where(inside("col", "west", "east") & inside("row", "south", "north")).drop("west", "south", "east", "north"))
    x1, y1, x2, y2, reach = (F.col(c) for c in ("x1", "y1", "x2", "y2", "buffer_m"))
    left, low = F.col("col") * CELL, F.col("row") * CELL
    corners = [(left, low), (left + CELL, low), (left, low + CELL), (left + CELL, low + CELL)]
    sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x, y in corners]
    met = (F.least(x1, x2) <= left + CELL) & (F.greatest(x1, x2) >= left) & (F.least(y1, y2) <= low + CELL) & (F.greatest(y1, y2) >= low) & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
    off = lambda v, a: F.greatest(a - v, v - a - CELL, F.lit(0))
    end = lambda x, y: off(x, left) * off(x, left) + off(y, low) * off(y, low) <= reach * reach
    near = reduce(Column.__or__, [met, end(x1, y1), end(x2, y2), *[within(x, y, reach) for x, y in corners]])
    touched = cells.groupBy("project", "layer", "row", "col").agg((F.bool_or(near) | (F.sum(crosses(left, low).cast("int")) % 2 == 1)).alias("touched"), F.first("is_hard").alias("is_hard"), F.first("weight").alias("weight")).where("touched")
    return touched.groupBy("project", "row", "col").agg(F.bool_or("is_hard").alias("blocked"), F.coalesce(F.sum("weight"), F.lit(0)).alias("soft_weight"), F.count("*").alias("n_layers"))


def layer_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster of the polygon layers."""
    layers = polygons(spark, sf_dir)
    site = layers.select("project").distinct().select("project", F.lit(0).alias("west"), F.lit(0).alias("south"), F.lit(SITE).alias("east"), F.lit(SITE).alias("north"))
    return raster(layers, site)


def land_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcel layers as routing sees them: unavailable land is hard, other soft land costs more by its owner and its price."""
    k = F.col("parcel_id")
    was_hard = k % 6 == 0
    rows = land_decision(spark, sf_dir).where("parcel_id % 9 <> 0")  # the others have no profile
    layers = bindings.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("parcel_id"), (1 + F.col("p_partkey") % 4).cast("double").alias("was"))
    penalty = OWNER_PENALTY + F.coalesce(F.col("present_value") * VALUE_SHARE, F.lit(0.0))
    hard = was_hard | F.coalesce(F.col("status") == "UNAVAILABLE", F.lit(False))
    weight = F.when(~hard, F.col("was") + F.when(F.col("status").isNotNull(), penalty).otherwise(0.0))
    return layers.join(rows, "parcel_id", "left").select("parcel_id", hard.alias("is_hard"), F.round(weight, 6).alias("weight"))


def bent_route_poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poles of each feeder's line through its turbines: at its ends, at sharp turns, and evenly between these; places in millimetres along it."""
    order = Window.partitionBy("project", "feeder").orderBy("k")
    t = bindings.turbines(spark, sf_dir).select("project", "feeder", "k", "x", "y")
    dx, dy = F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)
    leg = F.coalesce(F.round(F.sqrt(dx * dx + dy * dy) * 1000).cast("long"), F.lit(0))
    rows = t.withColumn("leg", leg).withColumns({"at": F.sum("leg").over(order), "n": F.count("*").over(Window.partitionBy("project", "feeder"))})
    turns = deflection_angles(spark, sf_dir).where("angle_pole").select("project", "feeder", "k", "angle_pole")
    rows = rows.join(turns, ["project", "feeder", "k"], "left")
    fixed = rows.where("k = 1 or k = n or angle_pole").withColumn("to", F.lead("at").over(order))
    length = F.col("to") - F.col("at")
    spans = F.when(length > int(MIN_SPAN * 1000), F.greatest(F.lit(1), F.bround(length / (TARGET_SPAN * 1000)).cast("int"), F.ceil(length / (MAX_SPAN * 1000 + 1e-6)).cast("int"))).otherwise(1)
    ends = fixed.select("project", "feeder", "at", F.when((F.col("k") == 1) | (F.col("k") == F.col("n")), "terminal").otherwise("angle").alias("kind"))
    between = fixed.where(F.col("to").isNotNull()).withColumn("spans", spans).where("spans > 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("spans") - 1)))
    inner = between.select("project", "feeder", (F.col("at") + F.floor(F.col("i") * length / F.col("spans"))).alias("at"), F.lit("intermediate").alias("kind"))
    poles = ends.unionByName(inner).groupBy("project", "feeder", "at").agg(F.max("kind").alias("kind"))  # one pole where two stand at one place: terminal before intermediate before angle
    number = F.row_number().over(Window.partitionBy("project", "feeder").orderBy("at"))
    return poles.select("project", "feeder", F.format_string("FDR-%03d-P%03d", (F.col("feeder") + 1).cast("int"), number).alias("pole_id"), "at", "kind")


def pole_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poles of each kind, longest and shortest span of each feeder's line, and whether its spans keep the limits."""
    poles = bent_route_poles(spark, sf_dir).withColumn("span", F.lead("at").over(Window.partitionBy("project", "feeder").orderBy("at")) - F.col("at"))
    kinds = [F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in ("terminal", "angle", "intermediate")]
    longest = F.max("span")
    return poles.groupBy("project", "feeder").agg(*kinds, longest.alias("longest_mm"), F.min("span").alias("shortest_mm"), F.coalesce((longest <= int(MAX_SPAN * 1000) + 1) & (F.min("span") > 0), F.lit(True)).alias("is_valid"))


def parcel_poles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turbine poles on each soft layer's land and its owner, if known; a pole may stand on several."""
    turbines, places = places_of(bindings.turbines(spark, sf_dir).select("project", "turbine_id", "x", "y"))
    poles = turbines.groupBy("place").agg(F.count("*").alias("n"))
    on = covering(places, polygons(spark, sf_dir).where("not is_hard").withColumn("buffer_m", F.lit(0))).withColumnRenamed("turbine_id", "place").join(poles, "place")
    owner = F.when(F.col("layer") % 5 != 0, F.concat(pick(["A", "B", "C"], F.col("layer") % 3), (F.col("layer") % 40).cast("string")))
    return on.groupBy("layer", owner.alias("owner")).agg(F.sum("n").alias("n_poles"))


QUERIES = (layer_scan, hard_endpoints, layer_raster, land_layers, bent_route_poles, pole_spans, parcel_poles)
