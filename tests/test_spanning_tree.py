"""Spanning trees against all trees of small graphs, and ties by names."""

import itertools

import numpy as np

from windloom.operators import network

SF = "/root/testdata/sf0.001"


def joined(edges, n):
    """Whether the edges join all nodes, by merging labels."""
    label = list(range(n))
    for a, b in edges:
        label = [label[a] if x == label[b] else x for x in label]
    return len(set(label)) == 1


def test_least_weight_of_all_trees():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 5, 6):
        for _ in range(6):
            xy = rng.integers(0, 4, (n, 2)).astype(float)  # many equal distances and equal places
            got = network.least_tree(xy, list(range(n)))
            length = lambda e: float(np.hypot(*(xy[e[0]] - xy[e[1]])))
            trees = [t for t in itertools.combinations(itertools.combinations(range(n), 2), n - 1) if joined(t, n)]
            assert len(got) == n - 1 and joined([e[:2] for e in got], n)
            assert abs(sum(e[2] for e in got) - min(sum(map(length, t)) for t in trees)) < 1e-9


def test_ties_go_to_the_lower_names():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    assert network.least_tree(square, [0, 30, 20, 10]) == [(0, 10, 1.0), (0, 30, 1.0), (10, 20, 1.0)]


def test_feeders_weigh_as_little_as_by_sorted_edges(spark):
    turbines = {}  # the substation is -1 here, as the tables have a turbine 0
    for r in network.bindings.turbines(spark, SF).collect():
        turbines.setdefault((r.project, r.feeder), {-1: (10000, 10000)})[r.turbine_id] = (r.x, r.y)
    got = {}
    for r in network.feeder_mst(spark, SF).collect():
        got[r.project, r.feeder] = got.get((r.project, r.feeder), 0) + r.length_m
    assert set(got) == set(turbines)
    for key, places in turbines.items():
        label, total = {n: n for n in places}, 0.0
        for d, a, b in sorted((np.hypot(places[a][0] - places[b][0], places[a][1] - places[b][1]), a, b) for a, b in itertools.combinations(places, 2)):
            if label[a] != label[b]:
                old, total = label[b], total + d
                label = {n: label[a] if v == old else v for n, v in label.items()}
        assert abs(got[key] - total) < 0.01
