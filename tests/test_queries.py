"""Every registered planning query against its SQL on a second engine, and small cases of the operators."""

import io
import itertools
import json
import math
import os
import time
import zipfile
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import MODULES, ORACLES
from windloom.operators import decide, economics, exact_grouping, network, report, survey_rules, topology
from windloom.sources import bindings, survey
from windloom.streaming import lockout, publish, staging

SF = "/root/testdata/sf0.001"
SQL = {name: sql for module in ORACLES for name, sql in module.SQL.items()}
QUERIES = {f.__name__: f for module in MODULES for f in module.QUERIES}


def plain(value):
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(plain(r[n]) for n in sorted(names)) for r in got.collect()), key=repr)
    expected = sorted((tuple(plain(dict(zip(names, r))[n]) for n in sorted(names)) for r in want.fetchall()), key=repr)
    assert rows == expected


def test_every_sql_is_a_query():
    assert set(SQL) <= set(QUERIES)


def test_money_is_unknown_only_if_no_part_is_known(spark):
    rows = spark.createDataFrame([(1, None, "a", 1), (1, None, "b", 2), (2, 5, "c", None), (None, 7, "d", None)], "feeder int, cost int, segment_id string, loss_w int").selectExpr("feeder", "cast(cost as decimal(14,2)) cost", "cast(1000 as decimal(12,2)) length_m", "loss_w")
    got = {r.feeder: (r.cost, r.loss_w) for r in report.rollup_feeders(rows).collect()}
    assert got == {"1": (None, 3), "2": (Decimal("5.00"), 0), "Unassigned": (Decimal("7.00"), 0)}


def test_rollup_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "feeder int, cost decimal(14,2), length_m decimal(12,2), loss_w int")
    assert report.rollup_feeders(rows).collect() == []


def test_annuity():
    assert decide.annuity(0, 25) == 25
    assert round(decide.annuity(0.08, 25), 4) == 10.6748


def test_spanning_tree_is_least(spark):
    rows = network.feeder_mst(spark, SF)
    sizes = {(r.project, r.feeder): r["count"] for r in rows.groupBy("project", "feeder").count().collect()}
    turbines = {(r.project, r.feeder): r["count"] for r in network.feeder_tree(spark, SF).groupBy("project", "feeder").count().collect()}
    assert sizes == turbines  # one edge for each turbine, the substation being the root


def test_lockout_rules():
    failures, until = [], 0
    for at in (0, 1, 2, 3, 4):
        failures, until, refused = lockout.transition(failures, until, at, True)
        assert not refused
    assert failures == [] and until == 4 + lockout.LOCK_MS
    assert lockout.transition([], until, 5, False)[2]
    assert lockout.transition([], until, until, True) == ([until], 0, False)
    assert lockout.transition([1, 2], 0, 2 + lockout.WINDOW_MS, True)[0] == [2 + lockout.WINDOW_MS]


def test_lockout_as_a_stream_equals_the_batch(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    query = lockout.lockouts(lockout.attempts(stream, lockout.SPEED)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r.user_id, r.event_id)
    assert lockout.lockout_batch(spark, SF).count() > 0
    assert sorted(map(key, spark.read.schema("user_id long, event_id long, at long").parquet(str(tmp_path / "out")).collect())) == sorted(map(key, lockout.lockout_batch(spark, SF).collect()))


def test_kmz_source(spark, tmp_path):
    kml = """<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>WTGs</name><Placemark><name>T1</name><Point><coordinates>1,2,0</coordinates></Point></Placemark>
      <Placemark><name>L</name><LineString><coordinates>1,2 bad 3,4</coordinates></LineString></Placemark></Folder>
      <Placemark><name>P</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("doc.kml", kml)
    (tmp_path / "a.kmz").write_bytes(raw.getvalue())
    (tmp_path / "bad.kmz").write_bytes(b"not a file")
    got = [(r.name, r.folder, r.geometry_type, r.lon) for r in survey.read_kmz(spark, str(tmp_path)).orderBy("path", "ordinal").collect()]
    assert got == [("T1", "WTGs", "Point", [1.0]), ("L", "WTGs", "LineString", [1.0, 3.0]), ("P", "", "Polygon", [0.0, 1.0, 1.0, 0.0])]


def test_kmz_faults_and_properties(spark, tmp_path, monkeypatch):
    head = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
    mark = '<Placemark><name>A</name><ExtendedData><Data name="cap"><value> 3 </value></Data><SchemaData><SimpleData name="h">90</SimpleData></SchemaData></ExtendedData><Point><coordinates>1,2</coordinates></Point></Placemark>'
    few = "<Placemark><LineString><coordinates>1,2</coordinates></LineString><Model/><Model/></Placemark>"
    files = {"a.kml": head + mark + few + "</Document></kml>", "b.kml": "nothing", "c.kml": '<!DOCTYPE x><kml/>', "d.kmz": "PKbroken"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = survey.read_kmz(spark, str(tmp_path)).collect()
    assert [(r.name, r.properties) for r in got] == [("A", {"cap": "3", "h": "90"})]
    faults = {(r.path.rsplit("/", 1)[1], r.fault): r.n for r in survey.kmz_faults(spark, str(tmp_path)).collect()}
    assert faults == {("a.kml", "TOO_FEW_VERTICES_LineString"): 1, ("a.kml", "SKIPPED_Model"): 2, ("b.kml", "MALFORMED"): 1, ("c.kml", "ENTITIES"): 1, ("d.kmz", "MALFORMED"): 1}
    monkeypatch.setattr(survey, "MAX_BYTES", 100)
    assert survey.document(files["a.kml"].encode()) == ([], {"TOO_LARGE": 1})


def test_geometry_json(spark):
    rows = spark.createDataFrame([("Point", [1.0], [2.5]), ("LineString", [1.0, 2.0], [0.0, 1.0]), ("Polygon", [0.0, 1.0, 0.0], [0.0, 0.0, 0.0])], "kind string, lon array<double>, lat array<double>")
    got = [json.loads(r[0]) for r in rows.select(survey.geometry_json(F.col("kind"), F.col("lon"), F.col("lat"))).collect()]
    assert got == [{"type": "Point", "coordinates": [1.0, 2.5]}, {"type": "LineString", "coordinates": [[1.0, 0.0], [2.0, 1.0]]}, {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]]}]


def test_loads_that_do_not_fit_are_known_without_trying_all_orders():
    """Ten loads of which no two share a group, nine groups: took over a million trials."""
    began = time.perf_counter()
    assert exact_grouping.least_cost(np.ones((10, 9)), np.full(10, 7), 13) is None
    assert time.perf_counter() - began < 1


def test_exact_grouping_deals_sites_by_number(spark):
    plan = exact_grouping.exact_grouping(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "MapInPandas" in plan


@pytest.mark.parametrize("seed", range(12))
def test_exact_grouping_against_all_assignments(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 7)), int(rng.integers(1, 4))
    cost, load = rng.integers(0, 50, (n, k)).astype(float), rng.integers(1, 10, n)
    capacity = int(rng.integers(5, 25))
    fits = [p for p in itertools.product(range(k), repeat=n) if all(load[[i for i in range(n) if p[i] == j]].sum() <= capacity for j in range(k))]
    got, even = exact_grouping.least_cost(cost, load, capacity), exact_grouping.most_even(load, k, capacity)
    if not fits:
        assert got is None and even is None
        return
    total = lambda p: sum(cost[i, j] for i, j in enumerate(p))
    away = lambda p: max(abs(list(p).count(j) - n / k) for j in range(k))
    assert tuple(got) in fits and total(got) == min(map(total, fits))
    assert tuple(even) in fits and abs(away(even) - min(map(away, fits))) < 1e-9


def test_sites_take_the_fewest_feeders(spark):
    rows = exact_grouping.exact_grouping(spark, SF).collect()
    kw = {r.turbine_id: r.kw for r in bindings.turbines(spark, SF).collect()}
    for name in ("by_distance", "by_balance"):
        loads = {}
        for r in rows:
            key = r.project, r.site
            loads.setdefault(key, {}).setdefault(r[name], 0)
            loads[key][r[name]] += kw[r.turbine_id]
        assert len(rows) == len(kw) and all(max(x.values()) <= exact_grouping.CAPACITY for x in loads.values())
        assert all(len(x) >= -(-sum(x.values()) // exact_grouping.CAPACITY) for x in loads.values())


def test_results_are_there_before_their_events(spark, tmp_path):
    source, results, events = (str(tmp_path / x) for x in ("in", "results", "events"))
    for k in range(3):
        spark.createDataFrame([(10 * k + i, s) for i, s in enumerate(("COMPLETED", "RUNNING", "FAILED"))], "job_id long, status string").write.mode("append").parquet(source)
    query = spark.readStream.schema("job_id long, status string").option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(publish.publish(results, events)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = spark.createDataFrame([(99, "COMPLETED")], "job_id long, status string")
    for _ in range(2):
        publish.publish(results, events)(batch, 1000)
    done = spark.read.parquet(events)
    assert {r.job_id for r in done.collect()} == {0, 2, 10, 12, 20, 22, 99} and done.where("batch = 1000").count() == 1
    assert done.join(spark.read.parquet(results), ["job_id", "status", "batch"], "left_anti").count() == 0


def test_the_audit_trail_survives_a_failure(spark, tmp_path):
    entry = spark.createDataFrame([("delete", 5)], "action string, id long")

    def fail():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        publish.audited(fail, entry, str(tmp_path / "audit"))
    publish.audited(lambda: None, entry, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


def test_ancestors_of_a_long_chain(spark):
    rows = spark.createDataFrame([(1, k, k - 1) for k in range(1, 51)] + [(2, 1, 0)], "feeder int, node int, parent int")
    got = {(r.feeder, r.node, r.above): r.depth for r in network.ancestors(rows, ["feeder"]).collect()}
    assert got == {(1, a, b): a - b for a in range(1, 51) for b in range(1, a + 1)} | {(2, 1, 1): 0}
    with pytest.raises(ValueError, match="above itself"):
        network.ancestors(spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "feeder int, node int, parent int"), ["feeder"]).count()


def test_csv_sections_mark_missing_money(spark, tmp_path):
    rows = spark.sql("select 'a' name, cast(null as decimal(10,2)) cost union all select 'b', cast(1 as decimal(10,2))")
    survey.write_csv_sections({"poles": rows}, str(tmp_path))
    got = {r.name: r.cost for r in spark.read.option("header", True).csv(os.path.join(tmp_path, "poles")).collect()}
    assert got == {"a": "Not costed", "b": "1.00"}
