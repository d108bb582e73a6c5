"""Cases that only larger tables hold: feeders of four digits, turbines at one place, ties of rounding."""

import math

import duckdb
import pytest

from windloom.operators import assembly, decide, layers, rights_of_way, topology, validity
from windloom.plans import oracle, oracle_assembly, oracle_layers, oracle_topology

CUSTOMERS = "SELECT i AS c_custkey, 1 AS c_nationkey, 'BUILDING' AS c_mktsegment FROM range({}) t(i)"
#: Orders of one cohort: the extremes of its metrics and costs, and one whose blend lies at a half.
TIED = [(110, 113279.37), (139, 251236.03), (233, 475712.45), (343, 130645.6), (450, 96187.6), (571, 171528.39), (1260, 468463.19), (2240, 50265.75), (2739, 51185.96), (114953, 1141.69), (144803, 499985.88), (216000, 158428.11), (220321, 154025.5), (346006, 463899.99)]


def both(spark, tmp_path, name, table, query, sql):
    """Rows of a query and of its SQL over one made table."""
    db = duckdb.connect()
    db.execute(f"COPY ({table}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    return sorted((tuple(r[n] for n in names) for r in query(spark, str(tmp_path)).collect()), key=repr), sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("query, sql", [(assembly.assembled_segments, oracle_assembly), (assembly.network_totals_by_feeder, oracle_assembly), (layers.bent_route_poles, oracle_layers)])
def test_names_of_feeders_from_a_thousand_on(spark, tmp_path, query, sql):
    got, want = both(spark, tmp_path, "customer", CUSTOMERS.format(10_030), query, sql.SQL[query.__name__])
    assert got == want
    assert any("FDR-1003" in str(r) for r in got)


def test_feeder_whose_turbines_stand_at_one_place(spark, tmp_path):
    got, want = both(spark, tmp_path, "customer", CUSTOMERS.format(15).replace("SELECT i ", "SELECT i * 20000 + i // 10 "), topology.long_edge_weight, oracle_topology.SQL["long_edge_weight"])
    assert len(got) == len(want) == 45 + 10
    assert [r[:4] for r in got] == [r[:4] for r in want] and all(math.isnan(r[4]) for r in got + want)


def test_blend_at_a_half(spark, tmp_path):
    rows = ", ".join(f"({k}::BIGINT, {price}::DOUBLE)" for k, price in TIED)
    got, want = both(spark, tmp_path, "orders", f"SELECT k AS o_orderkey, 5 AS o_custkey, price AS o_totalprice FROM (VALUES {rows}) t(k, price)", decide.cost_aware_rank, oracle.SQL["cost_aware_rank"])
    assert got == want
    assert {r[1]: r[2] for r in got}[346006] == 0.248862


def test_three_points_in_line_have_no_area(spark):
    ring = [(-13, 2723), (1387, 4123), (2787, 5523)]
    rows = spark.createDataFrame([(837, ring)], "layer int, ring array<struct<x:int,y:int>>")
    got = validity.checked(rows, ["layer"]).first()
    assert (got.state, got.area_m2) == ("NO_AREA", None)


def test_turbines_at_one_place_are_tested_once(spark):
    points = spark.createDataFrame([(1, 10, 5, 5), (1, 11, 5, 5), (1, 12, 90, 5), (2, 13, 5, 5)], "project int, turbine_id long, x long, y long")
    rings = spark.createDataFrame([(1, 7, [(0, 0), (10, 0), (10, 10), (0, 10)], 0), (1, 8, [(80, 0), (82, 0), (82, 9)], 8)], "project int, layer long, ring array<struct<x:long,y:long>>, buffer_m int")
    turbines, places = layers.places_of(points)
    assert places.count() == 3
    found = layers.covering(places, rings).withColumnRenamed("turbine_id", "place").join(turbines, "place")
    assert {(r.turbine_id, r.layer) for r in found.collect()} == {(10, 7), (11, 7), (12, 8)}


def test_moves_are_known_in_their_cell(spark):
    """No pair travels: nothing is shuffled after the turbines of a cell have met."""
    plan = topology.reassign_mutations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan.splitlines()[0] and "Join" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_a_route_meets_a_shape_once_over_many_cells(spark):
    """Legs and shapes over several cells give each stretch once, and nothing is made distinct."""
    routes = spark.createDataFrame([(1, "R", [(-5000.0, 10.0), (9000.0, 10.0)])], "project int, node string, line array<struct<x:double,y:double>>")
    shapes = spark.createDataFrame([(1, 3, [(-4500.0, -9000.0), (8000.0, -9000.0), (8000.0, 9000.0), (-4500.0, 9000.0)])], "project int, layer int, ring array<struct<x:double,y:double>>")
    found = rights_of_way.stretches(routes, shapes)
    assert [(r.begin, r.end, r.inside) for r in found.collect()] == [(500.0, 13000.0, True)]
    assert "Deduplicate" not in found._jdf.queryExecution().logical().toString()


def test_routes_at_one_place_and_end_to_end_cover_their_ground_once(spark):
    lines = [[(0.0, 0.0), (700.0, 100.0)], [(0.0, 0.0), (700.0, 100.0)], [(700.0, 100.0), (1400.0, 200.0)], [(0.0, 0.0), (1400.0, 200.0)]]
    routes = spark.createDataFrame([(1, k, line) for k, line in enumerate(lines)], "project int, node int, line array<struct<x:double,y:double>>")
    found = rights_of_way.union_area(rights_of_way.in_cells(rights_of_way.corridor_pieces(routes, 20)), ["project"])
    assert found.first()["area"] == pytest.approx(20 * math.hypot(1400, 200), abs=1e-3)
    assert "Window" not in found._jdf.queryExecution().logical().toString()  # no slabs: nothing but the pieces is shuffled
