"""Moves of poles against trying all candidates, and whole layouts on made land."""

import itertools
import random

import numpy as np

from windloom.operators import micro_siting as siting

POLE = "project int, feeder int, pole_id string, at long, kind string"
RING = "project int, layer int, ring array<struct<x:long,y:long>>"


def made_route(rnd, n):
    """Candidates of n poles in a row, all but the ends with seven places."""
    rows = []
    for k in range(n):
        steps = [0] if k in (0, n - 1) else range(-3, 4)
        rows.append(np.array([(k * 100_000 + s * 5000, k * 100 + s * 5, 0.0, rnd.randrange(2), rnd.randrange(3), rnd.random() < 0.8) for s in steps], float))
    return rows, [0 if len(r) == 1 else 3 for r in rows]


def worth(rows, taken):
    """Owners, parcels and span penalty of a layout, None where it breaks a rule."""
    at = [r[t] for r, t in zip(rows, taken)]
    spans = [b[1] - a[1] for a, b in zip(at, at[1:])]
    return sum(a[3] for a in at), sum(a[4] for a in at), sum(abs(s - siting.TARGET_SPAN) for s in spans), all(siting.MIN_SPAN <= s <= siting.MAX_SPAN for s in spans)


def test_one_movable_pole_takes_the_best_place():
    rnd = random.Random(1)
    for _ in range(200):
        rows, start = made_route(rnd, 3)
        taken = siting.descend(rows, start, passes=1, improvement=0.0)
        choices = [c for c in range(7) if (rows[1][c][5] and worth(rows, [0, c, 0])[3]) or c == 3]
        best = min((*worth(rows, [0, c, 0])[:3], abs(c - 3)) for c in choices)
        assert (*worth(rows, taken)[:3], abs(taken[1] - 3)) == best


def test_six_poles_never_get_worse_and_keep_order_and_spans():
    rnd = random.Random(2)
    better = 0
    for _ in range(60):
        rows, start = made_route(rnd, 6)
        taken = siting.descend(rows, start)
        before, after = worth(rows, start), worth(rows, taken)
        assert after[0] <= before[0] and after[3]
        assert all(rows[k][taken[k]][5] or taken[k] == start[k] for k in range(6))
        better += after[:2] < before[:2]
        # what a single further move of any pole could still gain, nothing could: the descent has ended
        settled = siting.descend(rows, start, passes=50)
        for k, c in itertools.product(range(1, 5), range(7)):
            other = [c if i == k else t for i, t in enumerate(settled)]
            if rows[k][c][5] and worth(rows, other)[3]:
                assert worth(rows, other)[:2] >= worth(rows, settled)[:2]
    assert better > 30


def test_places_on_a_bent_route(spark):
    legs = spark.createDataFrame([(1, 1, 0, 100_000, 100_000, 0, 0, 100, 0), (1, 1, 100_000, 150_000, 50_000, 100, 0, 100, 50)], "project int, feeder int, `from` long, `to` long, leg long, x1 long, y1 long, x2 long, y2 long")
    places = spark.createDataFrame([(1, 1, at) for at in (-5, 0, 25_000, 100_000, 120_500, 150_000, 150_001)], "project int, feeder int, at long")
    got = {r["at"]: (r["x"], r["y"]) for r in siting.at_chainage(places, legs).collect()}
    assert got == {0: (0, 0), 25_000: (25, 0), 100_000: (100, 0), 120_500: (100, 20.5), 150_000: (100, 50)}


def test_layouts_are_accepted_by_network(spark):
    """Project 1 leaves a parcel by moving one pole; in project 2 the parcel reaches too far, so nothing changes."""
    poles = [(p, 1, f"P{k}", k * 100_000, "terminal" if k in (0, 3) else "intermediate") for p in (1, 2) for k in range(4)]
    legs = spark.createDataFrame([(p, 1, 0, 300_000, 300_000, 0, 0, 300, 0) for p in (1, 2)], "project int, feeder int, `from` long, `to` long, leg long, x1 long, y1 long, x2 long, y2 long")
    square = lambda x1, x2: [(x1, -50), (x2, -50), (x2, 50), (x1, 50)]
    from pyspark.sql import functions as F

    parcels = spark.createDataFrame([(1, 10, square(95, 107)), (2, 20, square(60, 140))], RING).withColumn("unavailable", F.lit(False))
    owners = spark.createDataFrame([(10, "A"), (20, "B")], "layer int, owner string")
    hard = spark.createDataFrame([(1, 30, square(109, 116))], RING).withColumn("buffer_m", F.lit(0))
    places = siting.at_chainage(siting.candidates(spark.createDataFrame(poles, POLE)), legs)
    got = {(r["project"], r["pole_id"]): r for r in siting.sited(siting.standing_on(places, parcels, owners, hard)).collect()}
    assert len(got) == 8
    assert got[1, "P1"]["accepted"] and got[1, "P1"]["at"] == 90_000
    assert not got[2, "P1"]["accepted"] and all(r["at"] == r["original"] for (p, _), r in got.items() if p == 2)


def test_routes_of_a_share_are_sited_as_by_joins(spark):
    """Places and acceptance are those of the joins over all candidates."""
    from pyspark.sql import functions as F

    from windloom.operators.layers import bent_route_poles, polygons

    sf = "/root/testdata/sf0.001"
    poles = bent_route_poles(spark, sf)
    layers = polygons(spark, sf)
    parcels = layers.where("not is_hard").select("project", "layer", "ring", (F.col("layer") % 6 == 0).alias("unavailable"))
    owners = parcels.where("layer % 5 <> 0").select("layer", F.concat(F.element_at(F.array(*map(F.lit, "ABC")), (F.col("layer") % 3 + 1).cast("int")), (F.col("layer") % 40).cast("string")).alias("owner"))
    places = siting.at_chainage(siting.candidates(poles), siting.route_legs(spark, sf))
    want = siting.sited(siting.standing_on(places, parcels, owners, layers.where("is_hard").select("project", "layer", "ring", "buffer_m")))
    found = siting.micro_siting(spark, sf)
    got = [tuple(r) for r in found.select(*want.columns).collect()]
    assert len(got) > 1000 and sorted(got) == sorted(tuple(r) for r in want.collect())


def test_places_are_rounded_as_in_sql():
    assert siting.half_up(np.array([0.0005, 1.0015, 2.0025, -0.0005, 123.4565, 7.25])).tolist() == [0.001, 1.002, 2.003, -0.001, 123.457, 7.25]


def test_layouts_of_shares_are_accepted_by_network(spark):
    """As by joins: many made projects, of which some are accepted and some not."""
    from pyspark.sql import functions as F

    rnd = random.Random(4)
    poles = [(p, f, f"P{f}-{k}", k * 100_000, "terminal" if k in (0, 5) else "intermediate") for p in range(30) for f in (1, 17) for k in range(6)]
    line = "project int, feeder int, `from` long, `to` long, leg long, x1 long, y1 long, x2 long, y2 long"
    legs = spark.createDataFrame([(p, f, s * 250_000, (s + 1) * 250_000, 250_000, s * 250, f * 3000, (s + 1) * 250, f * 3000) for p in range(30) for f in (1, 17) for s in (0, 1)], line)
    square = lambda x, y, a: [(x - a, y - a), (x + a, y - a), (x + a, y + a), (x - a, y + a)]
    land = [(p, 100 * p + n, square(rnd.randrange(0, 500), rnd.choice([3000, 51000]), rnd.randrange(3, 25))) for p in range(30) for n in range(8)]
    parcels = spark.createDataFrame([r for r in land if r[1] % 4], RING).withColumn("unavailable", F.col("layer") % 9 == 0)
    hard = spark.createDataFrame([r for r in land if not r[1] % 4], RING).withColumn("buffer_m", F.lit(3))
    owners = spark.createDataFrame([(r[1], f"O{r[1] % 3}") for r in land if r[1] % 4 == 1], "layer int, owner string")
    rows = spark.createDataFrame(poles, POLE)
    want = siting.sited(siting.standing_on(siting.at_chainage(siting.candidates(rows), legs), parcels, owners, hard))
    got = siting.sited_routes(rows, legs, parcels, owners, hard).select(*want.columns)
    got, want = sorted(tuple(r) for r in got.collect()), sorted(tuple(r) for r in want.collect())
    assert got == want and len(got) == 360
    assert {r[-1] for r in got} == {True, False} and any(r[4] != r[5] for r in got)


def test_covered_places_are_not_tried_again():
    """Shut places and touched layers against all pairs, which are tried in full only where little is covered."""
    import pyarrow as pa

    from windloom.operators.layers import _cover

    rng = np.random.default_rng(5)
    rings = [[(-r, -r), (r, -r), (r, r), (0, 0), (-r, r)][: int(rng.integers(3, 6))] for r in rng.integers(20, 120, 60)]
    rings = [[{"x": int(x + a), "y": int(y + b)} for x, y in ring] for ring, a, b in zip(rings, rng.integers(0, 900, 60), rng.integers(0, 900, 60))]
    layers = pa.table({"layer": np.arange(60), "ring": rings, "buffer_m": rng.integers(0, 3, 60) * 20})
    x, y = rng.uniform(0, 900, (2, 500)).round(3)
    pairs = _cover(pa.table({"turbine_id": np.arange(500), "x": x, "y": y}), layers)
    point, layer = (pairs[c].to_numpy() for c in ("turbine_id", "layer"))
    land, some = siting._Land(layers), np.arange(0, 60, 2)
    assert (land.shut(x, y, some, most=2000) == np.isin(np.arange(500), point[layer % 2 == 0])).all()
    assert (land.touched(x, y, some, most=2000) == np.unique(layer[layer % 2 == 0])).all()
    tried, covers = [], land.covers
    land.covers = lambda x, y, some: tried.append(len(x) * len(some)) or covers(x, y, some)
    land.shut(x, y, np.repeat(np.arange(60), 20), most=2000)
    assert sum(tried) < 500 * 1200 / 2
