"""Projected coordinates back to degrees, and networks as GeoJSON in output coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators.routing import tree_edges
from windloom.operators.topology import AXIS, EASTING, FLATTENING, SCALE

#: The site's place in the projection (test binding): zone, and what is added to its metres.
ZONE, EAST0, NORTH0 = 43, 400_000, 1_500_000
#: Decimals of output degrees: about a centimetre.
DECIMALS = 7


def utm_inverse(east: str, north: str, zone: str, south: str = "false") -> tuple[str, str]:
    """Longitude and latitude in degrees as SQL text that holds for any engine with the usual functions: the inverse series in n."""
    n = FLATTENING / (2 - FLATTENING)
    a = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    real = lambda v: f"cast('{v!r}' as double)"
    eta = f"(({east} - {EASTING}) / {real(SCALE * a)})"
    xi = f"(({north} - CASE WHEN {south} THEN 10000000.0 ELSE 0.0 END) / {real(SCALE * a)})"
    up = "(" + " - ".join([xi] + [f"{real(v)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, v in enumerate(beta, 1)]) + ")"
    across = "(" + " - ".join([eta] + [f"{real(v)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, v in enumerate(beta, 1)]) + ")"
    chi = f"asin(sin({up}) / cosh({across}))"
    latitude = " + ".join([chi] + [f"{real(v)} * sin({2 * j} * {chi})" for j, v in enumerate(delta, 1)])
    return f"({zone} * 6 - 183) + degrees(atan2(sinh({across}), cos({up})))", f"degrees({latitude})"


def to_degrees(rows: DataFrame, line: str, zone: int, south: bool = False) -> DataFrame:
    """Rows with the vertices (x, y in metres of the zone) of their ``line`` as (lon, lat)."""
    lon, lat = utm_inverse("p.x", "p.y", str(zone), str(south).lower())
    return rows.withColumn(line, F.expr(f"transform({line}, p -> named_struct('lon', round({lon}, {DECIMALS}), 'lat', round({lat}, {DECIMALS})))"))


def network_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree edge as a line in metres of the projection."""
    place = lambda k: F.struct((F.col(f"x{k}") + EAST0).cast("double").alias("x"), (F.col(f"y{k}") + NORTH0).cast("double").alias("y"))
    return tree_edges(spark, sf_dir).select("project", "feeder", "node", F.array(place(1), place(2)).alias("line"))


def segment_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin and end of each segment in degrees."""
    rows = to_degrees(network_lines(spark, sf_dir), "line", ZONE)
    return rows.select("project", "feeder", "node", *[F.col(f"line.{c}")[k].alias(f"{c}_{name}") for k, name in enumerate(("begin", "end")) for c in ("lon", "lat")])


def network_collections(rows: DataFrame, network: list[str], node: str, line: str) -> DataFrame:
    """One GeoJSON FeatureCollection for each network: its nodes (at the begin of their segments), then its segments, each in order of the nodes.

    ``rows`` hold a segment each, with its line in degrees. Positions with a null or non-finite coordinate make no feature.
    """
    position = lambda p: F.array(p["lon"], p["lat"])
    good = F.forall(line, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull() & ~F.isnan(p["lon"]) & ~F.isnan(p["lat"]))
    # a geometry's text is built apart, as points and lines nest differently
    shape = lambda kind, coordinates: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(coordinates), F.lit("}"))
    text = lambda kind, geometry: F.concat(F.lit(f'{{"type":"Feature","properties":{{"kind":"{kind}","node":'), F.to_json(F.array(node)).substr(F.lit(2), F.length(F.to_json(F.array(node))) - 2), F.lit('},"geometry":'), geometry, F.lit("}"))
    features = F.array(F.struct(F.lit(0).alias("order"), F.col(node).alias("node"), text("node", shape("Point", position(F.get(line, F.lit(0))))).alias("text")), F.struct(F.lit(1).alias("order"), F.col(node).alias("node"), text("segment", shape("LineString", F.transform(line, position))).alias("text")))
    each = rows.where(good & (F.size(line) > 1)).select(*network, F.explode(features).alias("f"))
    listed = F.transform(F.array_sort(F.collect_list("f")), lambda f: f["text"])  # of one network
    return each.groupBy(*network).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")).alias("geojson"))


QUERIES = (segment_degrees,)
