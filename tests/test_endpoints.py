"""Clusters of route ends against one after the other."""

import random

from windloom.operators import endpoints


def one_by_one(ends, tolerance):
    """Cluster (its first end) of each end, first fit in order of the routes."""
    found, clusters = {}, {}
    for project, topology, route, x, y in sorted(set(ends)):
        mine = clusters.setdefault((project, topology), [])
        for cluster in mine:
            if all((x - a) ** 2 + (y - b) ** 2 <= tolerance**2 for _, a, b in cluster):
                cluster.append((route, x, y))
                break
        else:
            cluster = [(route, x, y)]
            mine.append(cluster)
        found[project, topology, route, x, y] = cluster[0]
    return found


def joined(spark, ends, tolerance):
    table = spark.createDataFrame(ends, "project int, topology int, route int, x double, y double")
    rows = endpoints.clusters(table, tolerance).collect()
    assert len(rows) == len(set(ends))
    return {tuple(r)[:5]: tuple(r["cluster"]) for r in rows}


def test_first_fit_in_order(spark):
    rnd = random.Random(1)
    ends = [(rnd.randrange(2), rnd.randrange(3), route, float(rnd.randrange(-12, 12)), float(rnd.randrange(-6, 6))) for route in range(70)]
    for tolerance in (0.0, 3.0):
        assert joined(spark, ends + ends[:5], tolerance) == one_by_one(ends, tolerance)


def test_tolerance_is_inclusive_and_does_not_chain(spark):
    ends = [(1, 7, 1, 0.0, 0.0), (1, 7, 2, 3.0, 0.0), (1, 7, 3, 6.0, 0.0), (1, 8, 4, 0.0, 0.0), (2, 7, 5, 0.0, 0.0)]
    got = {k[2]: v[0] for k, v in joined(spark, ends, 3.0).items()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_a_node_of_most_routes_and_odd_rows(spark):
    ends = [(1, 0, route, 5.0, 5.0) for route in range(400)] + [(1, None, 900, 5.0, 5.0), (1, 0, 901, None, 5.0)]
    got = joined(spark, ends, 1.0)
    assert {v for k, v in got.items() if k[2] < 900} == {(0, 5.0, 5.0)}
    assert got[1, None, 900, 5.0, 5.0][0] == 900 and got[1, 0, 901, None, 5.0][0] == 901
    assert joined(spark, [], 1.0) == {}
