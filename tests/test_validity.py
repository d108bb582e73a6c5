"""Rings against brute force: contacts by all pairs in fractions, areas by counting parity over a fine grid of points."""

from fractions import Fraction

import numpy as np

from windloom.operators import validity

RING = "layer int, ring array<struct<x:int,y:int>>"


def rows(spark, rings):
    return spark.createDataFrame([(i, None if r is None else [tuple(p) for p in r]) for i, r in enumerate(rings)], RING)


def states(spark, rings):
    return {r.layer: (r.state, r.n_contacts, r.area_m2) for r in validity.checked(rows(spark, rings), ["layer"]).collect()}


def test_bow_tie_star_and_plain_rings(spark):
    bow_tie, square = [(0, 0), (10, 10), (10, 0), (0, 10)], [(0, 0), (10, 0), (10, 10), (0, 10)]
    star = [(0, 0), (8, 6), (-2, 6), (6, 0), (3, 10)]
    got = states(spark, [bow_tie, square, [*square, square[0]], square[::-1], star, [square[0], *square, square[2], square[2]]])
    assert got[0] == ("REPAIRED", 1, 50.0) and got[1] == got[2] == got[3] == ("VALID", 0, 100.0)
    assert got[4][:2] == ("REPAIRED", 5) and got[5][0] == "REPAIRED"


def test_spikes_touches_and_twice_round(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    spike = [(0, 0), (10, 0), (20, 0), (10, 0), (10, 10), (0, 10)]
    touch = [(0, 0), (10, 0), (10, 10), (5, 0), (0, 10)]
    inner = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0), (4, 2), (4, 4), (2, 4)]  # round the square, then a kite from its corner
    got = states(spark, [spike, touch, square * 2, inner])
    assert [got[i][0] for i in range(4)] == ["REPAIRED", "REPAIRED", "NO_AREA", "REPAIRED"]
    assert got[0][2] == 100.0 and got[1][2] == 50.0 and got[3][2] == 100.0 - 8.0


def test_rejected_rings_have_a_reason(spark):
    got = states(spark, [None, [], [(0, 0)], [(0, 0), (5, 5), (0, 0)], [(0, 0), (5, 5), (9, 9)], [(0, 0), (None, 5), (9, 9), (3, 1)]])
    assert [got[i][0] for i in range(6)] == ["NOT_KNOWN", "TOO_FEW_POINTS", "TOO_FEW_POINTS", "TOO_FEW_POINTS", "NO_AREA", "NOT_KNOWN"]
    assert all(v[2] is None for v in got.values()) and validity.checked(rows(spark, [[]]).limit(0), ["layer"]).count() == 0


def edges_of(ring):
    ring = [p for i, p in enumerate(ring) if p != ring[i - 1]]
    return list(zip(ring, ring[1:] + ring[:1]))


def share_a_point(e, f):
    """By solving for the parameters in fractions; parallel edges by the order of their ends."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = *e, *f
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    if det:
        s = Fraction((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), det)
        t = Fraction((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), det)
        return 0 <= s <= 1 and 0 <= t <= 1
    return (bx - ax) * (cy - ay) == (by - ay) * (cx - ax) and max(min(e), min(f)) <= min(max(e), max(f))


def test_random_rings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rings = [[tuple(p) for p in (rng.integers(-3, 4, (int(rng.integers(3, 9)), 2)) * 400).tolist()] for _ in range(60)]
    got = states(spark, rings)
    for i, ring in enumerate(rings):
        if len(set(ring)) < 3:
            assert got[i][0] == "TOO_FEW_POINTS"
            continue
        edges, n = edges_of(ring), len(edges_of(ring))
        wrong = 0
        for a in range(n):
            for b in range(a + 1, n):
                (p, q), (u, v) = edges[a], edges[b]
                if b == a + 1 or (a == 0 and b == n - 1):
                    turn = (q[0] - p[0]) * (v[1] - u[1]) - (q[1] - p[1]) * (v[0] - u[0])
                    wrong += turn == 0 and (q[0] - p[0]) * (v[0] - u[0]) + (q[1] - p[1]) * (v[1] - u[1]) < 0
                else:
                    wrong += share_a_point(edges[a], edges[b])
        assert got[i][1] == wrong
        # parity along lines a little off the whole heights, summed: the middle rule over fine strips
        ys, area = np.arange(-1200, 1200, 0.5) + 0.25, 0.0
        for y in ys:
            xs = sorted(p[0] + (y - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) for p, q in edges if (p[1] > y) != (q[1] > y))
            area += 0.5 * sum(b - a for a, b in zip(xs[::2], xs[1::2]))
        assert abs((got[i][2] or 0.0) - area) < 1 + 1e-4 * area, ring
