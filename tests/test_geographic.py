"""Degrees to metres and back, and networks as GeoJSON."""

import json

from pyspark.sql import functions as F

from windloom.operators import geographic, topology


def test_forward_and_back_within_a_millimetre(spark):
    places = [(float(lon), float(lat)) for lon in range(-180, 181, 17) for lat in range(-80, 85, 7)] + [(3.0, 0.0), (5.999999, 60.0), (6.0, -33.5)]
    rows = spark.createDataFrame(places, "lon double, lat double").withColumn("zone", F.least(F.floor((F.col("lon") + 180) / 6) + 1, F.lit(60)).cast("int"))
    east, north = topology.utm("lon", "lat", "zone")
    there = rows.withColumns({"east": F.expr(east), "north": F.expr(north)})
    lon, lat = geographic.utm_inverse("east", "north", "zone", "lat < 0")
    back = there.select("lon", "lat", F.expr(lon).alias("lon2"), F.expr(lat).alias("lat2")).collect()
    metre = 1 / 111_320
    assert len(back) == len(places)
    assert all(abs(r["lon"] - r["lon2"]) < metre / 1000 and abs(r["lat"] - r["lat2"]) < metre / 1000 for r in back)


def test_collections(spark):
    line = "array<struct<lon:double,lat:double>>"
    rows = spark.createDataFrame([(1, "b", [(7.5, 1.25), (8.0, 2.0)]), (1, 'a"', [(7.0, 1.0), (7.5, 1.25), (9.0, 9.0)]), (2, "c", [(None, 1.0), (2.0, 2.0)]), (2, "d", [(3.0, 1.0)])], f"network int, node string, line {line}")
    got = {r["network"]: json.loads(r["geojson"]) for r in geographic.network_collections(rows, ["network"], "node", "line").collect()}
    assert set(got) == {1}
    features = got[1]["features"]
    assert [(f["properties"]["kind"], f["properties"]["node"], f["geometry"]["type"]) for f in features] == [("node", 'a"', "Point"), ("node", "b", "Point"), ("segment", 'a"', "LineString"), ("segment", "b", "LineString")]
    assert features[0]["geometry"]["coordinates"] == [7.0, 1.0] and features[3]["geometry"]["coordinates"] == [[7.5, 1.25], [8.0, 2.0]]


def test_collections_of_the_site(spark):
    rows = geographic.to_degrees(geographic.network_lines(spark, "/root/testdata/sf0.001"), "line", geographic.ZONE)
    found = geographic.network_collections(rows, ["project", "feeder"], "node", "line").collect()
    assert found and all(len(json.loads(r["geojson"])["features"]) % 2 == 0 for r in found)
