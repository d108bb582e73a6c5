"""Spatial searches beyond the made site: far places, negative coordinates, projects without places."""

import random

from windloom.operators import layers, network


def test_nearest_against_all_pairs(spark):
    rnd = random.Random(1)
    for spread in (300, 60_000):
        points = [(rnd.randrange(3), k, rnd.randrange(-spread, spread), rnd.randrange(-spread, spread)) for k in range(150)] + [(1, 900, 100_000, 0), (9, 901, 0, 0)]
        places = [(rnd.randrange(3), k, rnd.randrange(-spread, spread) // 10, rnd.randrange(-spread, spread)) for k in range(25)] + [(1, 99, 0, 0), (1, 98, 0, 0)]
        got = network.nearest(spark.createDataFrame(points, "project int, point_id int, x long, y long"), spark.createDataFrame(places, "project int, place_id int, px long, py long"))
        want = {}
        for project, point, x, y in points:
            found = [((x - px) ** 2 + (y - py) ** 2, k) for p, k, px, py in places if p == project]
            want[point] = min(found) if found else (None, None)
        assert {r["point_id"]: (r["d"], r["place_id"]) for r in got.collect()} == want


def test_one_place_far_from_all(spark):
    points = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 100_000, 0)], "project int, point_id int, x long, y long")
    places = spark.createDataFrame([(1, 7, 0, 0)], "project int, place_id int, px long, py long")
    assert {r["point_id"]: r["d"] for r in network.nearest(points, places).collect()} == {1: 0, 2: 10**10}
    assert {r["place_id"] for r in network.nearest(points, places.where("false")).collect()} == {None}


def test_layers_beyond_the_site(spark):
    ring = "array<struct<x:long,y:long>>"
    square = lambda x, y: [(x, y), (x + 600, y), (x + 600, y + 600), (x, y + 600)]
    rows = spark.createDataFrame([(1, 1, square(-60_300, -900), 40, True, None), (1, 2, square(59_000, 100), 0, False, 5)], f"project int, layer int, ring {ring}, buffer_m int, is_hard boolean, weight int")
    points = spark.createDataFrame([(1, 1, -60_000, -500), (1, 2, -60_339, -500), (1, 3, -60_341, -500), (1, 4, 59_600, 700), (1, 5, 0, 0)], "project int, turbine_id int, x long, y long")
    assert {(r["turbine_id"], r["layer"]) for r in layers.covering(points, rows).collect()} == {(1, 1), (2, 1), (4, 2)}
    surface = spark.createDataFrame([(1, -60_500, -1000, -59_000, 0)], "project int, west int, south int, east int, north int")
    cells = {(r["row"], r["col"]): r["blocked"] for r in layers.raster(rows, surface).collect()}
    assert cells == {(row, col): True for row in (-2, -1) for col in (-121, -120)}


def test_pairs_are_never_aggregated_by_point(spark):
    """A point looks into its cell's array of places; places at one spot are one, the least id of them."""
    points = spark.range(400).selectExpr("1 AS project", "id AS point_id", "id % 20 AS x", "id DIV 20 AS y")
    places = spark.range(300).selectExpr("1 AS project", "id AS place_id", "id % 3 * 7 AS px", "5L AS py")
    got = network.nearest(points, places)
    assert "key=[point_id" not in got._jdf.queryExecution().executedPlan().toString()
    want = {k: min(((k % 20 - p % 3 * 7) ** 2 + (k // 20 - 5) ** 2, p) for p in range(300)) for k in range(400)}
    assert {r["point_id"]: (r["d"], r["place_id"]) for r in got.collect()} == want
