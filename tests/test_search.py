"""Least-cost routes against relaxation, ties, states, refinement and surfaces whose extent follows the data."""

import itertools

import numpy as np
import pytest

from windloom.operators import search, surfaces

SF = "/root/testdata/sf0.001"
SURFACE = "project int, west int, north int, resolution_m long, width long, height long, accepted boolean"
EDGE = "project int, feeder int, node int, x1 int, y1 int, x2 int, y2 int"
CELL = "project int, row long, col long, blocked boolean, added double"


def cheapest(cost, start, goal, size):
    """Bellman-Ford over the same steps."""
    best = np.full(cost.shape, np.inf)
    best[start] = 0.0
    for _ in range(cost.size):
        for r, c in itertools.product(*map(range, cost.shape)):
            for dr, dc in itertools.product((-1, 0, 1), repeat=2):
                to = (r + dr, c + dc)
                if (dr or dc) and 0 <= to[0] < cost.shape[0] and 0 <= to[1] < cost.shape[1] and not (dr and dc and np.isinf([cost[r + dr, c], cost[r, c + dc]]).any()):
                    best[to] = min(best[to], best[r, c] + size * (2**0.5 if dr and dc else 1.0) * float(cost[to]))
    return best[goal]


def plain_search(cost, start, goal, size):
    """The same order of leaving by the plainest means: all open entries are looked through for the least (f, h, arrival)."""
    ways = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)]
    least = float(cost.min())
    left = lambda c: np.hypot(goal[0] - c[0], goal[1] - c[1]) * size * least
    spent, came, closed, waiting, n = {start: 0.0}, {}, set(), [(left(start), left(start), 0, start)], 0
    while waiting:
        entry = min(waiting)
        waiting.remove(entry)
        here = entry[3]
        if here == goal:
            path = [here]
            while path[-1] != start:
                path.append(came[path[-1]])
            return path[::-1]
        if here in closed:
            continue
        closed.add(here)
        for dr, dc in ways:
            to = (here[0] + dr, here[1] + dc)
            if not (0 <= to[0] < cost.shape[0] and 0 <= to[1] < cost.shape[1]) or np.isinf(cost[to]) or (dr and dc and (np.isinf(cost[to[0], here[1]]) or np.isinf(cost[here[0], to[1]]))):
                continue
            total = spent[here] + (2**0.5 if dr and dc else 1.0) * size * float(cost[to])
            if total < spent.get(to, np.inf):
                spent[to], came[to], n = total, here, n + 1
                waiting.append((total + left(to), left(to), n, to))
    return None


def made(rng, shape):
    cost = np.ones(shape, np.float32)
    cost[rng.random(shape) < 0.2] = np.inf
    cost[rng.random(shape) < 0.3] = rng.choice([21.0, 41.0])
    return cost


@pytest.mark.parametrize("size", [5.0, 20.0, 100.0])
def test_cost_equals_relaxation_and_ties_those_of_a_plain_search(size):
    rng = np.random.default_rng(int(size))
    for _ in range(20):
        cost = made(rng, (9, 7))
        cost[0, 0] = cost[8, 6] = 1.0
        got, want = search.least_cost_path(cost, (0, 0), (8, 6), size), cheapest(cost, (0, 0), (8, 6), size)
        assert (got is None and want == np.inf) or abs(got[0] - want) < 1e-6
        assert (got[1] if got else None) == plain_search(cost, (0, 0), (8, 6), size)


def test_path_of_one_cell_walled_in_and_shut_ends():
    cost = np.ones((5, 5))
    assert search.least_cost_path(cost, (2, 2), (2, 2), 20.0) == (0.0, [(2, 2)])
    cost[:, 2] = np.inf
    assert search.least_cost_path(cost, (2, 0), (2, 4), 20.0) is None
    assert search.least_cost_path(cost, (2, 0), (2, 2), 20.0) is None and search.least_cost_path(cost, (2, 0), (2, 9), 20.0) is None


def test_touched_cells():
    assert search.touched((0.5, 0.5), (0.5, 2.5)) == {(0, 0), (0, 1), (0, 2)}
    assert search.touched((0.5, 0.5), (1.5, 1.5)) == {(0, 0), (0, 1), (1, 0), (1, 1)}  # both cells at the corner count
    assert search.touched((1.0, 0.5), (1.0, 1.5)) == {(0, 0), (1, 0), (0, 1), (1, 1)}  # along a line: both sides
    assert search.touched((0.5, 0.5), (0.5, 0.5)) == {(0, 0)}


def test_shortcuts_keep_clear_of_blocked_cells_and_never_cost_more():
    cost = np.ones((3, 3))
    path = np.array([(0, 0), (0, 1), (0, 2), (1, 2), (2, 2)]) + 0.5
    assert search.shorten(path, cost)[0].tolist() == [[0.5, 0.5], [2.5, 2.5]]
    cost[1, 1] = np.inf
    assert search.shorten(path, cost)[0].tolist() == [[0.5, 0.5], [0.5, 2.5], [2.5, 2.5]]
    cost[1, 1] = 21.0  # dearer than the way round
    assert len(search.shorten(path, cost)[0]) == 3
    assert search.shorten(np.array([(1.5, 0.5), (1.5, 2.5)]), np.where(cost > 1, np.inf, 1.0)) is None
    rng = np.random.default_rng(5)
    for _ in range(30):
        cost = made(rng, (12, 12))
        cost[0, 0] = cost[11, 11] = 1.0
        got = search.least_cost_path(cost, (0, 0), (11, 11), 1.0)
        if got:
            line = np.array(got[1]) + 0.5
            before = sum(search.leg_cost(a, b, cost) for a, b in zip(line, line[1:]))
            better, spent = search.shorten(line, cost)
            assert spent <= before + 1e-6 and abs(spent - sum(search.leg_cost(a, b, cost) for a, b in zip(better, better[1:]))) < 1e-6


def test_every_edge_is_routed_or_named(spark):
    rows = search.astar_routes(spark, SF).collect()
    assert len(rows) == 150 and {r.state for r in rows} <= {"ROUTED", "NO_PATH", "START_BLOCKED", "GOAL_BLOCKED"}
    refined = {(r.project, r.feeder, r.node): r for r in search.route_refine(spark, SF).collect()}
    assert all(refined[r.project, r.feeder, r.node].n_vertices <= r.n_vertices for r in rows)


def test_routes_detour_over_the_whole_surface(spark):
    edges = spark.createDataFrame([(p, 3, 1, 5250, 5250, 7250, 5250) for p in range(3)], EDGE)
    on = spark.createDataFrame([(p, 0, 10500, 500, 40, 40, True) for p in range(3)], SURFACE)
    wall = spark.createDataFrame([(0, r, 12, True, 0.0) for r in range(39)] + [(1, r, 12, False, 9000.0) for r in range(39)], CELL)  # open in row 39 only
    got = {r.project: r for r in search.routes(edges, wall, on).collect()}
    for p, dear in enumerate((np.inf, 9001.0, 1.0)):
        cost = np.ones((40, 40))
        cost[:39, 12] = dear
        assert (got[p].state, got[p].cost) == ("ROUTED", round(search.least_cost_path(cost, (10, 10), (10, 14), 500.0)[0], 3))
    assert got[1].cost < 9001.0 * 500


def test_states_of_edges_without_a_route(spark):
    ends = {1: (150, 150, 450, 150), 2: (250, 150, 450, 150), 3: (150, 150, 250, 150), 4: (-1, 150, 450, 150), 5: (150, 150, 450, 900), 6: (110, 110, 140, 150), 7: (150, 450, 150, 150)}
    edges = spark.createDataFrame([(0, 1, n, *e) for n, e in ends.items()] + [(1, 1, 1, 0, 0, 9, 9), (2, 1, 1, 0, 0, 9, 9)], EDGE)
    on = spark.createDataFrame([(0, 0, 500, 100, 5, 5, True), (1, 0, 500, 100, 5, 5, False)], SURFACE)
    wall = spark.createDataFrame([(0, r, 2, True, 0.0) for r in range(5)] + [(0, 3, 1, False, 20.0)], CELL)
    got = {(r.project, r.node): r for r in search.routes(edges, wall, on).collect()}
    states = ["NO_PATH", "START_BLOCKED", "GOAL_BLOCKED", "START_OUT_OF_BOUNDS", "GOAL_OUT_OF_BOUNDS", "ROUTED", "ROUTED"]
    assert [got[0, n].state for n in range(1, 8)] == states and got[1, 1].state == got[2, 1].state == "SURFACE_TOO_LARGE"
    assert got[0, 6].cost == 50.0 * 21 and got[0, 6].length_m == 50.0  # one cell: the way within it


@pytest.mark.parametrize("resolution", [5, 20, 100])
def test_surfaces_follow_the_data(spark, resolution):
    points = spark.createDataFrame([(0, -30000, -100), (0, 30000, 250), (1, 7, 7), (2, None, 4)], "project int, x int, y int")
    got = {r.project: r for r in surfaces.surfaces_of(points, resolution).collect()}
    assert set(got) == {0, 1} and (got[0].west, got[0].north) == (-30100, 350)
    assert (got[0].width, got[0].height, got[0].resolution_m) == (-(-60200 // resolution), -(-550 // resolution), resolution)
    discs = spark.createDataFrame([(0, -30000, -100, 60, True), (0, 30000, 250, 60, False), (0, 90000, 0, 60, True)], "project int, lx int, ly int, r int, hard boolean")
    cells = surfaces.disc_cells(discs, surfaces.surfaces_of(points, resolution)).collect()
    centre = lambda c: (-30100 + (c.col + 0.5) * resolution, 350 - (c.row + 0.5) * resolution)
    every = {(r, c) for r in range(got[0].height) for c in range(got[0].width) for x, y in [(-30100 + (c + 0.5) * resolution, 350 - (r + 0.5) * resolution)] if min(np.hypot(x + 30000, y + 100), np.hypot(x - 30000, y - 250)) <= 60}
    assert {(c.row, c.col) for c in cells} == every and all(c.blocked == (centre(c)[0] < 0) for c in cells)


def test_large_surfaces_are_coarsened_or_rejected(spark):
    points = spark.createDataFrame([(0, 0, 0), (0, 9800, 9800), (1, 0, 0)], "project int, x int, y int")
    got = {r.project: r for r in surfaces.surfaces_of(points, 20, max_cells=10000).collect()}
    assert (got[0].resolution_m, got[0].width, got[0].accepted) == (100, 100, True) and got[1].resolution_m == 20
    assert not any(r.accepted for r in surfaces.surfaces_of(points, 100, max_cells=3).collect() if r.width * r.height > 3)
    for wrong in (4, 101):
        with pytest.raises(ValueError):
            surfaces.surfaces_of(points, wrong)


def test_legs_cost_what_the_kernel_says(spark):
    rng = np.random.default_rng(9)
    cost = made(rng, (12, 12))
    ends = rng.integers(0, 1201, (60, 4)).tolist() + [[0, 0, 1200, 1200], [300, 0, 300, 1200], [50, 50, 50, 50], [-5, 0, 100, 100]]
    legs = spark.createDataFrame([(0, i, *e, 0, 1200, 100, 12, 12, True) for i, e in enumerate(ends)], "project int, leg int, x1 int, y1 int, x2 int, y2 int, west int, north int, resolution_m long, width long, height long, accepted boolean")
    cells = [(0, r, c, bool(np.isinf(cost[r, c])), 0.0 if np.isinf(cost[r, c]) else float(cost[r, c]) - 1) for r in range(12) for c in range(12) if cost[r, c] != 1]
    got = {r.leg: r for r in surfaces.leg_costs(legs, spark.createDataFrame(cells, CELL), ["project", "leg"]).collect()}
    for i, (x1, y1, x2, y2) in enumerate(ends):
        a, b = np.array([(1200 - y1) / 100, x1 / 100]), np.array([(1200 - y2) / 100, x2 / 100])
        within = {c for c in search.touched(a, b) if 0 <= c[0] < 12 and 0 <= c[1] < 12}
        want = search.leg_cost(a, b, cost) if min(x1, y1) >= 0 else np.inf
        assert got[i].n_cells == len(within) and got[i].is_open == np.isfinite(want)
        assert got[i].cost is None if np.isinf(want) else abs(got[i].cost - want * 100) < 0.002


def test_search_by_distances_opens_fewer_cells_and_takes_the_same_path():
    from array import array

    rng = np.random.default_rng(3)
    opened = {True: 0, False: 0}
    for n in range(30):
        cost = made(rng, (14, 11))
        goals = [(13, 10), (0, 5), (7, 7)]
        for cell in [(0, 0), *goals]:
            cost[cell] = 1.0
        found, wall, slack = search.distances(cost, goals)
        cells = search.bordered(cost)

        class Counted(array):
            def __getitem__(self, i):
                opened[way] += 1
                return array.__getitem__(self, i)

        for k, goal in enumerate(goals):
            away, size = array("d", (found[:, k] * 20.0).tobytes()), 20.0
            least = away[cells[1] + 1]
            way = False
            want = search.walk(Counted("f", cells[0]), *cells[1:], (0, 0), goal, size)
            assert (want is None) == (least >= wall * size)
            if want:
                way = True
                assert abs(least - want[0]) <= slack * size
                assert search.walk(Counted("f", cells[0]), *cells[1:], (0, 0), goal, size, away, least + slack * size) == want
    assert opened[True] * 2 < opened[False]


def test_bounds_of_legs_hold():
    rng = np.random.default_rng(8)
    for _ in range(50):
        cost = made(rng, (12, 12))
        a, ends = rng.integers(0, 25, 2) / 2, rng.integers(0, 25, (30, 2)) / 2
        exact = np.array([search.leg_cost(a, b, cost) for b in ends])
        assert (search.at_least(a, ends, cost) <= exact * (1 + 1e-9) + 1e-9).all()
        assert np.isinf(exact[~search.unblocked(a, ends, cost)]).all()
