"""Small cases and brute force for the planning kernels that SQL doesn't express."""

import itertools

import numpy as np

from windloom.operators import grouping, loadflow, survey_rules

SF = "/root/testdata/sf0.001"


def test_load_flow_balances_power():
    parent, kw, km = np.array([-1, 0, 0, 1]), np.array([3000.0, 2500.0, 4000.0, 2000.0]), np.array([5.0, 2.0, 3.0, 1.0])
    cable = loadflow.smallest(parent, kw)
    amp, r, x, c = loadflow.CATALOGUE[cable].T
    z, y = (r + 1j * x) * km, np.zeros(4, complex)
    power = kw * 1000 * (1 - 1j * np.tan(np.arccos(loadflow.POWER_FACTOR)))
    v, flow, ok = loadflow.sweep(parent, power, z, y, 33000.0)
    assert ok
    supplied = 3**0.5 * 33000.0 * np.conj(flow[parent < 0]).sum()
    loss = (3 * z * abs(flow) ** 2).sum()
    assert abs(supplied + power.sum() - loss) < 1.0  # VA: what comes from the grid and the turbines is lost in the cables


def test_load_flow_of_an_impossible_load_does_not_converge():
    got = loadflow.solve(np.array([-1]), np.array([-9e6]), np.array([50.0]), np.array([0]))
    assert not got["ok"]


def test_repair_enlarges_cables_only():
    parent, kw, km = np.array([-1, 0, 1, 2]), np.array([9000.0] * 4), np.array([20.0] * 4)
    cable, got, n, state = loadflow.repair(parent, kw, km)
    assert (cable >= loadflow.smallest(parent, kw)).all()
    assert state in ("VALID", "REPAIRED", "NO_LARGER_CABLE", "ROUNDS_EXHAUSTED", "NOT_CONVERGED")
    if state in ("VALID", "REPAIRED"):
        assert got["loading"].max() <= 1 and got["pu"].max() <= loadflow.HIGH + 1e-9


def test_grouping_keeps_capacity_and_all_turbines(spark):
    rows = grouping.capacity_grouping(spark, SF).collect()
    assert len({r.turbine_id for r in rows}) == len(rows) == 150
    load = {}
    for r in rows:
        load[r.project, r.site, r.feeder] = load.get((r.project, r.site, r.feeder), 0) + r.kw
    assert max(load.values()) <= grouping.CAPACITY


def test_a_request_is_a_whole_project_up_to_the_limit(spark, monkeypatch):
    rows = [(i, p, i, i, 2000, i // 10, i % 10 + 1) for p, n in ((0, 41), (1, 500), (2, 501)) for i in range(n)]
    monkeypatch.setattr(grouping.bindings, "turbines", lambda *_: spark.createDataFrame(rows, "turbine_id int, project int, x int, y int, kw int, feeder int, k int"))
    got = {(r.project, r.site): len(r.turbines) for r in grouping.requests(spark, SF).collect()}
    assert got == {(0, 0): 41, (1, 0): 500, (2, 0): 500, (2, 1): 1}


def test_grouping_is_close_to_the_best_of_small_sites():
    rng = np.random.default_rng(5)
    for _ in range(5):
        xy, kw = rng.integers(0, 20000, (7, 2)).astype(float), np.full(7, 9000.0)
        label = grouping.group(xy, kw)
        assert np.bincount(label, weights=kw).max() <= grouping.CAPACITY and len(np.unique(label)) == 2
        best = min(grouping.cost_of(xy, np.array(m)) for m in itertools.product((0, 1), repeat=7) if 3 <= sum(m) <= 4)
        assert grouping.cost_of(xy, label) <= 2.5 * best


def test_changes_are_the_cheapest_of_all():
    rng = np.random.default_rng(9)
    xy, kw, label = rng.integers(0, 20000, (9, 2)).astype(float), rng.integers(20, 50, 9) * 100.0, np.array([0, 1, 2] * 3)
    every = []
    for i in range(9):
        every += [np.where(np.arange(9) == i, j, label) for j in range(3) if j != label[i]]
        for o in range(i):
            if label[i] != label[o]:
                other = label.copy()
                other[i], other[o] = label[o], label[i]
                every.append(other)
    want = sorted(grouping.cost_of(xy, m) for m in every if np.bincount(m, weights=kw).max() <= grouping.CAPACITY)[: grouping.NEIGHBOURS]
    assert np.allclose([grouping.cost_of(xy, m) for m in grouping.changes(xy, kw, label)], want)


def test_beam_search_never_worsens(spark):
    rows = grouping.beam_search(spark, SF).collect()
    assert rows and all(r.best_cost <= r.first_cost for r in rows)


def test_folder_rules(spark):
    rows = spark.createDataFrame([(1, "Penna River", "Sheet1 / Untitled"), (2, None, ""), (3, "Untitled Polygon", "A / My Places / Land"), (4, "x", None)], "ordinal int, name string, folder string")
    got = {r.ordinal: (r.kind, r.rule) for r in survey_rules._classify(rows, survey_rules.AREA_FOLDERS, survey_rules.AREA_NAMES).collect()}
    assert got == {1: ("RESTRICTED_AREA", "NAME"), 2: ("UNKNOWN", "NONE"), 3: ("PARCEL", "FOLDER"), 4: ("UNKNOWN", "NONE")}


def test_a_staged_import_is_taken_once_and_in_time(spark):
    from windloom.streaming.staging import STAGED_US, settle

    rows = [("a", 0, 1, 7, True), ("a", 5, 2, 8, False), ("a", STAGED_US, 3, 7, False), ("a", STAGED_US, 4, 7, False), ("b", 1, 5, 7, False), ("c", 0, 6, 7, True), ("c", STAGED_US + 1, 7, 7, False), ("c", STAGED_US + 2, 8, 7, True), ("c", STAGED_US + 3, 9, 7, False)]
    got = {r.id: r.result for r in settle(spark.createDataFrame(rows, "handle string, at long, id long, project int, staged boolean")).collect()}
    assert got == {2: "OTHER_PROJECT", 3: "COMMITTED", 4: "EXPIRED", 5: "EXPIRED", 7: "EXPIRED", 9: "COMMITTED"}


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    from windloom.sources.bindings import table
    from windloom.streaming.staging import sessions

    events = table(spark, "/root/testdata/sf0.001", "events").select("user_id", "ts", "event_id", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("progress_test").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got, whole = {tuple(r) for r in spark.table("progress_test").collect()}, {tuple(r) for r in sessions(events).collect()}
    assert got and got <= whole and len(whole) - len(got) <= 20  # the last ones are still open


def test_reports_of_no_candidates(spark):
    from windloom.operators.decision_report import compare, winners

    rows = spark.createDataFrame([], "cohort int, candidate_id long, total double, length_m long, losses_kw long, cost decimal(16,2), parcels long, crossings long")
    assert winners(rows).collect() == [] and compare(rows, rows).collect() == []


def test_beam_search_shuffles_requests_only(spark):
    """Rounds shuffle nothing, and each kernel runs once: the requests are the only thing dealt, into a named number of partitions."""
    plan = grouping.beam_search(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInPandas") == 1 + grouping.ROUNDS
    assert "Join" not in plan and "Window" not in plan.split("Exchange")[0] and "REPARTITION_BY_NUM" in plan
