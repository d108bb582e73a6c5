"""Least-cost routes of tree edges over their project's surface, and their refinement by straight shortcuts.

A row of a raster is one record (columns and costs of its unlike cells), so a task gets a surface as few rows. The distance of
all cells to some goals comes from sweeps over arrays; a search then opens only cells that a cheapest path may pass.
"""

from __future__ import annotations

import heapq
from array import array
from math import hypot, isinf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.operators.routing import layers, tree_edges
from windloom.operators.surfaces import ON_LINE, column_at, disc_cells, row_at, surfaces

#: Feeders whose edges one task's group holds.
FEEDERS = 10
#: Relative tolerance of the comparison of costs.
ALIKE = 1e-9
#: Numbers that the distances to some goals hold at once, places of a line that are looked at for blocked cells, and shortcuts weighed at once.
SWEPT, GLANCES, FAN = 3_000_000, 64, 12
SCHEMA = "project int, feeder int, node int, state string, cost double, n_vertices int, length_m double, xy array<double>"


def least_cost_path(cost: np.ndarray, start: tuple[int, int], goal: tuple[int, int], resolution: float) -> tuple[float, list[tuple[int, int]]] | None:
    """Cheapest path over eight neighbours of a raster (infinite cells are blocked): a step costs its length times the entered
    cell's cost, corners of blocked cells aren't cut. Of equal estimates the one nearer to the goal leaves first, then the earlier one.
    """
    height, width = cost.shape
    if not all(0 <= r < height and 0 <= c < width and np.isfinite(cost[r, c]) for r, c in (start, goal)):
        return None
    return walk(*bordered(cost), start, goal, resolution)


def bordered(cost: np.ndarray) -> tuple[array, int, float]:
    """A raster's cells one after another with a blocked border, the width of a row, and the least cost."""
    around = np.full((cost.shape[0] + 2, cost.shape[1] + 2), np.inf, np.float32)
    around[1:-1, 1:-1] = cost
    return array("f", around.tobytes()), around.shape[1], float(cost.min())


def walk(cells: array, width: int, least: float, start: tuple[int, int], goal: tuple[int, int], resolution: float, ahead: array | None = None, most: float = 0.0) -> tuple[float, list[tuple[int, int]]] | None:
    """``least_cost_path`` on bordered cells, from one open cell to another.

    With ``ahead``, what each cell is away from the goal, cells from which a path would cost over ``most`` are left alone. Such a cell is
    never on a cheapest path, nor do the others leave in another order without it, so the path is the same.
    """
    spot = lambda c: (c[0] + 1) * width + c[1] + 1
    first, last, (goal_row, goal_col), blocked = spot(start), spot(goal), (goal[0] + 1, goal[1] + 1), float("inf")
    beside, slant = (-width, width, -1, 1), sqrt(2) * resolution
    corners = [(v + h, v, h) for v in (-width, width) for h in (-1, 1)]  # a diagonal step with the two cells beside it
    spent, came, done, unit, n, push = {first: 0.0}, {}, set(), resolution * least, 0, heapq.heappush
    far = hypot(goal[0] - start[0], goal[1] - start[1]) * unit
    heap = [(far, far, 0, first)]
    while heap:
        here = heapq.heappop(heap)[3]
        if here == last:
            path = [here]
            while here != first:
                here = came[here]
                path.append(here)
            return spent[last], [(p // width - 1, p % width - 1) for p in reversed(path)]
        if here in done:
            continue
        done.add(here)
        so_far = spent[here]
        found = [(here + d, so_far + resolution * cells[here + d]) for d in beside]
        for d, v, h in corners:
            if cells[here + v] != blocked and cells[here + h] != blocked:
                found.append((here + d, so_far + slant * cells[here + d]))
        for to, total in found:
            if total < spent.get(to, blocked) and (ahead is None or total + ahead[to] <= most):  # never so for a blocked cell
                spent[to], came[to] = total, here
                row, col = divmod(to, width)
                left = hypot(goal_row - row, goal_col - col) * unit
                n += 1
                push(heap, (total + left, left, n, to))
    return None


def distances(cost: np.ndarray, goals: list[tuple[int, int]]) -> tuple[np.ndarray, float, float]:
    """Cost in cells of the cheapest path from each cell (with a border) to each goal, by the steps of ``least_cost_path``; the value
    from which on there is none; and how exact the costs are. Sweeps down and up take in any path without a turn back; they end when nothing gets less.
    """
    height, width = cost.shape
    is_open = np.isfinite(cost)
    wall = 1.5 * float(cost[is_open].sum(dtype=float)) + 1.0  # more than any path over open cells
    price = np.where(is_open, cost, wall).astype(float)
    upto = np.cumsum(price, axis=1)
    before, slant = upto - price, sqrt(2) * price
    found = np.full((height + 2, len(goals), width + 2), np.inf)
    here = found[1:-1, :, 1:-1]
    for n, (r, c) in enumerate(goals):
        here[r, n, c] = 0.0

    def settle(r: int, q: int | None) -> bool:
        old = here[r]
        new = old
        if q is not None:
            new = np.minimum(old, here[q] + price[q])
            steps = here[q] + slant[q]
            shut = sides[r, q]
            new[:, 1:] = np.minimum(new[:, 1:], steps[:, :-1] + shut[0])
            new[:, :-1] = np.minimum(new[:, :-1], steps[:, 1:] + shut[1])
            if not (new < old - 1e-6).any():
                return False
        right = np.minimum.accumulate((new + upto[r])[:, ::-1], axis=1)[:, ::-1] - upto[r]
        left = np.minimum.accumulate(new - before[r], axis=1) + before[r]
        new = np.minimum(np.minimum(new, right), left)
        less = bool((new < old - 1e-6).any())
        here[r] = new
        return less

    corner = lambda r, q: (np.where(is_open[q, 1:] & is_open[r, :-1], 0.0, wall), np.where(is_open[q, :-1] & is_open[r, 1:], 0.0, wall))
    sides = {(r, q): corner(r, q) for r in range(height) for q in (r - 1, r + 1) if 0 <= q < height}
    for r in {r for r, _ in goals}:
        settle(r, None)
    since, seen, now = [0] * height, {pair: -1 for pair in sides}, 0  # when a row last got less, and was last looked at by the one beside it
    changed = True
    while changed:
        changed = False
        for r, q in [*((r, r - 1) for r in range(1, height)), *((r, r + 1) for r in range(height - 2, -1, -1))]:
            now += 1
            if since[q] > seen[r, q]:
                seen[r, q] = now
                if settle(r, q):
                    since[r], changed = now, True
    return found, wall, 1e-3 + width * wall * 1e-12


def stops(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shares of the way from a to b, both ends included, at which it meets a line of the grid."""
    ways = [np.array([0.0, 1.0])]
    for p, q in zip(a, b):
        if p != q:
            ways.append((np.arange(np.ceil(min(p, q)), np.floor(max(p, q)) + 1) - p) / (q - p))
    t = np.unique(np.concatenate(ways))
    return t[(t >= 0) & (t <= 1)]


def sides(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells (four a place, repeats included) that the places at shares t of the way touch."""
    at = a + (b - a) * t[:, None]
    low, high = np.floor(at - ON_LINE).astype(int), np.floor(at + ON_LINE).astype(int)
    return np.stack([low[:, 0], low[:, 0], high[:, 0], high[:, 0]]), np.stack([low[:, 1], high[:, 1], low[:, 1], high[:, 1]])


def touched(a: tuple[float, float], b: tuple[float, float]) -> set[tuple[int, int]]:
    """Cells that the line from a to b (row and column as numbers, lines of the grid at whole ones) meets, corners included."""
    a, b = np.array(a, float), np.array(b, float)
    t = stops(a, b)
    rows, cols = sides(a, b, np.concatenate([t, (t[1:] + t[:-1]) / 2]))
    return set(zip(rows.ravel().tolist(), cols.ravel().tolist()))


def leg_cost(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> float:
    """Length in cells times the dearest cell of each part between lines of the grid; infinite if a blocked cell is met."""
    t = stops(a, b)
    rows, cols = sides(a, b, np.concatenate([t, (t[1:] + t[:-1]) / 2]))
    within = (rows >= 0) & (rows < cost.shape[0]) & (cols >= 0) & (cols < cost.shape[1])
    met = np.where(within, cost[rows.clip(0, cost.shape[0] - 1), cols.clip(0, cost.shape[1] - 1)], 0.0).max(axis=0)
    if np.isinf(met).any():
        return np.inf
    return float((np.diff(t) * met[len(t) :]).sum()) * hypot(*(b - a))


def straightened(points: np.ndarray) -> np.ndarray:
    """Points without repeats and without those in the middle of a straight stretch."""
    kept: list[np.ndarray] = []
    for p in points:
        if kept and (p == kept[-1]).all():
            continue
        while len(kept) > 1:
            before, after = kept[-1] - kept[-2], p - kept[-1]
            if abs(before[0] * after[1] - before[1] * after[0]) > ALIKE or before @ after < -ALIKE:
                break
            kept.pop()
        kept.append(p)
    return np.array(kept)


def unblocked(a: np.ndarray, ends: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Whether no glance at the way from a to each of the ends falls on a blocked cell; ``leg_cost`` of the others is infinite."""
    at = a + (ends - a)[:, None] * ((np.arange(GLANCES) + 0.5) / GLANCES)[:, None]
    rows, cols = np.floor(at).astype(int).transpose(2, 0, 1)
    within = (rows >= 0) & (rows < cost.shape[0]) & (cols >= 0) & (cols < cost.shape[1])
    return ~(within & np.isinf(cost[rows.clip(0, cost.shape[0] - 1), cols.clip(0, cost.shape[1] - 1)])).any(axis=1)


def at_least(a: np.ndarray, ends: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """What ``leg_cost`` from a to each of the ends can't be below: each part between lines of the grid at the cell of its middle; finite prices only."""
    ways = [np.zeros((len(ends), 1)), np.ones((len(ends), 1))]
    for k in (0, 1):
        step = ends[:, k] - a[k]
        low, high = np.ceil(np.minimum(a[k], ends[:, k])), np.floor(np.maximum(a[k], ends[:, k]))
        line = low[:, None] + np.arange(max(0, int((high - low).max()) + 1))
        t = (line - a[k]) / np.where(step != 0, step, 1.0)[:, None]
        ways.append(np.where((step != 0)[:, None] & (line <= high[:, None]), t, 0.0))
    t = np.sort(np.concatenate(ways, axis=1).clip(0.0, 1.0), axis=1)
    at = a + (ends - a)[:, None] * ((t[:, 1:] + t[:, :-1]) / 2)[:, :, None]
    rows, cols = np.floor(at).astype(int).transpose(2, 0, 1)
    within = (rows >= 0) & (rows < cost.shape[0]) & (cols >= 0) & (cols < cost.shape[1])
    met = np.where(within, cost[rows.clip(0, cost.shape[0] - 1), cols.clip(0, cost.shape[1] - 1)], 0.0).astype(float)
    return (np.diff(t, axis=1) * np.minimum(met, 1e12)).sum(axis=1) * np.hypot(*(ends - a).T)


def shorten(points: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Straight shortcuts, each to the farthest point that open cells lead to at no higher cost, and the cost of the result in
    cells; None if the line itself meets a blocked cell.
    """
    line = straightened(points)
    legs = [leg_cost(a, b, cost) for a, b in zip(line, line[1:])]
    if any(isinf(x) for x in legs):
        return None
    sums, kept, total, i = np.concatenate([[0.0], np.cumsum(legs)]), [0], 0.0, 0
    while i < len(line) - 1:
        j, price = i + 1, legs[i]
        far = i + 2 + np.flatnonzero(unblocked(line[i], line[i + 2 :], cost))[::-1]
        for some in (far[k : k + FAN] for k in range(0, len(far), FAN)):
            before = sums[some] - sums[i]
            most = before + ALIKE * np.maximum(1.0, before)
            hopeful = np.flatnonzero(at_least(line[i], line[some], cost) <= most * (1 + ALIKE))
            fits = next(((int(some[n]), c) for n in hopeful if (c := leg_cost(line[i], line[some[n]], cost)) <= most[n]), None)
            if fits:
                j, price = fits
                break
        kept.append(j)
        total, i = total + price, j
    return line[kept], total


def _grid(rows: pd.DataFrame, height: int, width: int) -> np.ndarray:
    cost = np.ones((height, width), np.float32)
    for row, cols, prices in zip(rows["row"], rows["cols"], rows["prices"]):
        cost[int(row), np.asarray(cols, int)] = prices
    return cost


def _solve(edges: pd.DataFrame, raster: pd.DataFrame, refine: bool) -> pd.DataFrame:
    """Routes of the edges of one share of a project."""
    rows, ways, cost = [], {}, None
    for e in edges.itertuples(index=False):
        lost = lambda state: rows.append((e.project, e.feeder, e.node, state, None, 0, None, None))  # noqa: B023, E731
        if not e.accepted:
            lost("SURFACE_TOO_LARGE")
            continue
        if cost is None:
            cost = _grid(raster, int(e.height), int(e.width))
        ends = (int(e.r1), int(e.c1)), (int(e.r2), int(e.c2))
        out = [not (0 <= r < cost.shape[0] and 0 <= c < cost.shape[1]) for r, c in ends]
        shut = [not o and isinf(cost[c]) for o, c in zip(out, ends)]
        if any(out) or any(shut):
            lost("START_OUT_OF_BOUNDS" if out[0] else "GOAL_OUT_OF_BOUNDS" if out[1] else "START_BLOCKED" if shut[0] else "GOAL_BLOCKED")
            continue
        ways.setdefault(ends[1], []).append((e, ends[0]))
    goals = list(ways)
    cells = bordered(cost) if goals else None
    some = max(1, SWEPT // cost.size) if goals else 1
    for part in (goals[k : k + some] for k in range(0, len(goals), some)):
        away, wall, slack = distances(cost, part)
        for n, goal in enumerate(part):
            size = float(ways[goal][0][0].resolution_m)
            ahead = array("d", (away[:, n] * size).tobytes())
            rows += [_route(e, start, goal, cost, cells, ahead, (wall, slack), refine) for e, start in ways[goal]]
    return pd.DataFrame(rows, columns=["project", "feeder", "node", "state", "cost", "n_vertices", "length_m", "xy"])


def _route(e: tuple, start: tuple[int, int], goal: tuple[int, int], cost: np.ndarray, cells: tuple[array, int, float], ahead: array, bounds: tuple[float, float], refine: bool) -> tuple:
    """Route of one edge from an open cell to another."""
    size, (west, north) = float(e.resolution_m), (float(e.west), float(e.north))
    least = ahead[(start[0] + 1) * cells[1] + start[1] + 1]
    got = walk(*cells, start, goal, e.resolution_m, ahead, least * (1 + ALIKE) + bounds[1] * size) if least < bounds[0] * size else None
    if got is None:
        return e.project, e.feeder, e.node, "NO_PATH", None, 0, None, None
    own = lambda x, y: ((north - y) / size, (x - west) / size)
    points = np.array([own(e.x1, e.y1), *[(r + 0.5, c + 0.5) for r, c in got[1][1:-1]], own(e.x2, e.y2)])
    state, spent = "ROUTED", got[0]
    if len(got[1]) == 1:
        spent = hypot(e.x2 - e.x1, e.y2 - e.y1) * float(cost[start])
    if refine and (points[0] != points[-1]).any():
        better = shorten(points, cost)
        if better is None:
            state = "NOT_REFINED"
        else:
            points, spent = better[0], better[1] * size
    xy = np.column_stack([west + points[:, 1] * size, north - points[:, 0] * size])
    length = float(np.hypot(*np.diff(xy, axis=0).T).sum())
    return e.project, e.feeder, e.node, state, round(float(spent), 3), len(xy), round(length, 3), xy.ravel().tolist()


def routes(edges: DataFrame, raster: DataFrame, surfaces: DataFrame, refine: bool = False) -> DataFrame:
    """Route of each edge (project, feeder, node, x1, y1, x2, y2) over its project's surface and raster (project, row, col, blocked, added).

    States: ROUTED; START_ or GOAL_OUT_OF_BOUNDS, START_ or GOAL_BLOCKED, NO_PATH, SURFACE_TOO_LARGE without a route (also for
    a project without a surface); NOT_REFINED if the route from an end to the next cell's centre meets a blocked cell. Edges
    spread evenly, FEEDERS feeders a group, whatever the size of a project.
    """
    place = {f"{n}{i}": f(F.col(f"{c}{i}")).cast("long") for i in (1, 2) for n, c, f in (("r", "y", row_at), ("c", "x", column_at))}
    on = edges.join(surfaces, "project", "left").withColumns(place | {"accepted": F.coalesce("accepted", F.lit(False)), "share": F.floor(F.col("feeder") / FEEDERS)})
    price = F.when(F.col("blocked"), F.lit(float("inf"))).otherwise(1 + F.col("added")).cast("float")
    lines = raster.groupBy("project", "row").agg(F.collect_list(F.struct("col", price.alias("price"))).alias("c"))  # one row of one surface
    lines = lines.select("project", "row", F.col("c.col").alias("cols"), F.col("c.price").alias("prices"))
    shares = on.select("project", "share").distinct().join(lines, "project").withColumnsRenamed({"project": "in_project", "share": "in_share"})
    solve = lambda edges, raster: _solve(edges, raster, refine)
    n = 4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as few bytes stand for much work here and would be put together
    on, shares = on.repartition(n, "project", "share"), shares.repartition(n, "in_project", "in_share")
    return on.groupBy("project", "share").cogroup(shares.groupBy("in_project", "in_share")).applyInPandas(solve, SCHEMA)


def _tree_routes(spark: SparkSession, sf_dir: str, refine: bool) -> DataFrame:
    on = surfaces(spark, sf_dir)
    return routes(tree_edges(spark, sf_dir), disc_cells(layers(spark, sf_dir), on), on, refine).drop("xy")


def astar_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest route of each tree edge with its traversal cost and its length from end to end."""
    return _tree_routes(spark, sf_dir, False)


def route_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes after straight shortcuts that cost no more; the cost is that of the line itself, not of steps between cells."""
    return _tree_routes(spark, sf_dir, True)


QUERIES = (astar_routes, route_refine)
