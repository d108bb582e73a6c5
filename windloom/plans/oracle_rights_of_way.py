"""SQL of the corridors: the same slabs over a coarser grid without joins by cell, lengths of each leg against every layer of its project."""

from __future__ import annotations

import math

from windloom.operators.rights_of_way import SIDES, WIDTH
from windloom.plans.oracle_layers import RINGS
from windloom.plans.oracle_routing import EDGES

GRID = 1250
HALF = WIDTH / 2
_DISC = ", ".join(f"({k}, {HALF * math.cos(2 * math.pi * k / SIDES)!r}::DOUBLE, {HALF * math.sin(2 * math.pi * k / SIDES)!r}::DOUBLE)" for k in range(SIDES))
_ROUTES = f"""{EDGES}, bends AS (SELECT *, floor((x1 + x2) / 2.0::DOUBLE - (y2 - y1) / 8.0::DOUBLE) AS bx, floor((y1 + y2) / 2.0::DOUBLE + (x2 - x1) / 8.0::DOUBLE) AS "by" FROM edges WHERE x1 <> x2 OR y1 <> y2),
  legs0 AS (SELECT project, feeder, node, 0 AS leg, x1::DOUBLE AS x1, y1::DOUBLE AS y1, bx AS x2, "by" AS y2 FROM bends UNION ALL SELECT project, feeder, node, 1, bx, "by", x2, y2 FROM bends),
  legs AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM legs0 WHERE x1 <> x2 OR y1 <> y2)"""
_PIECES = f"""{_ROUTES}, discs(k, ox, oy) AS (VALUES {_DISC}),
  ring AS (SELECT project, feeder, node, leg AS piece, k, CASE WHEN k IN (0, 3) THEN x1 ELSE x2 END + CASE WHEN k < 2 THEN -1 ELSE 1 END * (y1 - y2) / length * {HALF} AS x, CASE WHEN k IN (0, 3) THEN y1 ELSE y2 END + CASE WHEN k < 2 THEN -1 ELSE 1 END * (x2 - x1) / length * {HALF} AS y, 4 AS n FROM legs, range(0, 4) r(k)
    UNION ALL SELECT project, feeder, node, -1, k, bx + ox, "by" + oy, {SIDES} FROM bends, discs),
  sides AS (SELECT a.project, a.feeder, a.node, a.piece, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ring a JOIN ring b ON b.project = a.project AND b.feeder = a.feeder AND b.node = a.node AND b.piece = a.piece AND b.k = (a.k + 1) % a.n),
  boxes AS (SELECT project, feeder, node, piece, min(x1) AS west, max(x1) AS east, min(y1) AS low, max(y1) AS high FROM sides GROUP BY ALL),
  here AS (SELECT *, unnest(range(CAST(floor(low / {GRID}) AS BIGINT), CAST(floor(high / {GRID}) AS BIGINT) + 1)) AS cy FROM (SELECT *, unnest(range(CAST(floor(west / {GRID}) AS BIGINT), CAST(floor(east / {GRID}) AS BIGINT) + 1)) AS cx FROM boxes)),
  near AS (SELECT h.cx, h.cy, s.* FROM here h JOIN sides s USING (project, feeder, node, piece))"""


def _crossing(a: str, b: str) -> str:
    """Height at which two sides cross, NULL if they don't."""
    d = f"(({a}.x2 - {a}.x1) * ({b}.y2 - {b}.y1) - ({a}.y2 - {a}.y1) * ({b}.x2 - {b}.x1))"
    t = f"((({b}.x1 - {a}.x1) * ({b}.y2 - {b}.y1) - ({b}.y1 - {a}.y1) * ({b}.x2 - {b}.x1)) / {d})"
    u = f"((({b}.x1 - {a}.x1) * ({a}.y2 - {a}.y1) - ({b}.y1 - {a}.y1) * ({a}.x2 - {a}.x1)) / {d})"
    return f"CASE WHEN {d} <> 0 AND {t} > 0 AND {t} < 1 AND {u} > 0 AND {u} < 1 THEN {a}.y1 + {t} * ({a}.y2 - {a}.y1) END"


def _apart(a: str, b: str) -> str:
    return " OR ".join(f"greatest({p}.{c}1, {p}.{c}2) < least({q}.{c}1, {q}.{c}2)" for p, q in ((a, b), (b, a)) for c in "xy")


def _covered(name: str, by: str, rows: str, layer: bool) -> str:
    """CTEs that end in ``name``: by, cx, cy, mid, height, low, high of stretches that don't overlap, of the sides in ``rows``."""
    group = f"{by}, cx, cy"
    x = f"cx * {GRID}"
    sides = [f"SELECT {group}, y1 + ({p} - x1) * (y2 - y1) / (x2 - x1) AS y FROM {{t}} WHERE least(x1, x2) < {p} AND greatest(x1, x2) > {p}" for p in (x, f"({x} + {GRID})")]
    join = " AND ".join(f"a.{c} = b.{c}" for c in group.split(", "))
    heights = [f"SELECT {group}, y1 AS y FROM {rows}", *[s.format(t=rows) for s in sides], f"SELECT {group}, cy * {GRID} FROM {rows}", f"SELECT {group}, cy * {GRID} + {GRID} FROM {rows}", f"SELECT {', '.join('a.' + c for c in group.split(', '))}, {_crossing('a', 'b')} FROM {rows} a JOIN {rows} b ON {join} AND a.name < b.name AND NOT ({_apart('a', 'b')})"]
    if layer:
        heights += [f"SELECT {group}, y1 AS y FROM {rows}_layer", *[s.format(t=f"{rows}_layer") for s in sides], f"SELECT {', '.join('a.' + c for c in group.split(', '))}, {_crossing('a', 'b')} FROM {rows} a JOIN {rows}_layer b ON {join} AND NOT ({_apart('a', 'b')})"]
    return f"""{name}_heights AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(heights)}) WHERE y BETWEEN cy * {GRID} AND cy * {GRID} + {GRID}),
  {name}_slabs AS (SELECT *, (y + top) / 2 AS mid, top - y AS height FROM (SELECT *, lead(y) OVER (PARTITION BY {group} ORDER BY y) AS top FROM {name}_heights) WHERE top IS NOT NULL),
  {name}_met AS (SELECT {group}, mid, height, name, greatest(min(x1 + (mid - y1) * (x2 - x1) / (y2 - y1)), {x}) AS low, least(max(x1 + (mid - y1) * (x2 - x1) / (y2 - y1)), {x} + {GRID}) AS high FROM {name}_slabs JOIN {rows} USING ({group}) WHERE (y1 > mid) <> (y2 > mid) GROUP BY {group}, mid, height, name),
  {name} AS (SELECT {group}, mid, height, greatest(low, coalesce(max(high) OVER (PARTITION BY {group}, mid ORDER BY low, high, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low)) AS low, high FROM {name}_met WHERE high > low)"""


_NAMED = "SELECT *, feeder || '/' || node || '/' || piece AS name FROM near"
_RINGS = f"{RINGS}, outlines AS (SELECT project, layer, is_hard, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM corners)"
_SHARED = f"""named AS ({_NAMED}), spans AS (SELECT project, layer, min(x1) AS west, max(x1) AS east, min(y1) AS low, max(y1) AS high FROM outlines GROUP BY ALL),
  pairs AS (SELECT DISTINCT n.project, n.feeder, n.node, s.layer, n.cx, n.cy FROM named n JOIN spans s ON s.project = n.project AND s.west <= n.cx * {GRID} + {GRID} AND s.east >= n.cx * {GRID} AND s.low <= n.cy * {GRID} + {GRID} AND s.high >= n.cy * {GRID}),
  shared AS (SELECT p.layer, n.* FROM named n JOIN pairs p USING (project, feeder, node, cx, cy)),
  shared_layer AS (SELECT p.feeder, p.node, p.cx, p.cy, o.* FROM pairs p JOIN outlines o USING (project, layer)),
  {_covered('strips', 'project, feeder, node, layer', 'shared', True)},
  gaps AS (SELECT project, feeder, node, layer, cx, cy, mid, x, row_number() OVER (PARTITION BY project, feeder, node, layer, cx, cy, mid ORDER BY x) AS n FROM (SELECT project, feeder, node, layer, cx, cy, mid, x1 + (mid - y1) * (x2 - x1) / (y2 - y1) AS x FROM strips_slabs JOIN shared_layer USING (project, feeder, node, layer, cx, cy) WHERE (y1 > mid) <> (y2 > mid))),
  inner_ AS (SELECT a.project, a.feeder, a.node, a.layer, a.cx, a.cy, a.mid, a.x AS from_, b.x AS to_ FROM gaps a JOIN gaps b ON a.project = b.project AND a.feeder = b.feeder AND a.node = b.node AND a.layer = b.layer AND a.cx = b.cx AND a.cy = b.cy AND a.mid = b.mid AND b.n = a.n + 1 AND a.n % 2 = 1),
  areas AS (SELECT project, feeder, node, layer, sum(greatest(0.0::DOUBLE, least(high, to_) - greatest(low, from_)) * height) AS area FROM strips JOIN inner_ USING (project, feeder, node, layer, cx, cy, mid) GROUP BY ALL)"""
_STRETCHES = """met AS (SELECT l.*, o.layer, o.is_hard, ((o.x1 - l.x1) * (o.y2 - o.y1) - (o.y1 - l.y1) * (o.x2 - o.x1)) / ((l.x2 - l.x1) * (o.y2 - o.y1) - (l.y2 - l.y1) * (o.x2 - o.x1)) AS t,
      ((o.x1 - l.x1) * (l.y2 - l.y1) - (o.y1 - l.y1) * (l.x2 - l.x1)) / ((l.x2 - l.x1) * (o.y2 - o.y1) - (l.y2 - l.y1) * (o.x2 - o.x1)) AS u FROM legs l JOIN outlines o ON o.project = l.project WHERE (l.x2 - l.x1) * (o.y2 - o.y1) - (l.y2 - l.y1) * (o.x2 - o.x1) <> 0),
  cuts AS (SELECT project, feeder, node, leg, layer, t FROM met WHERE u BETWEEN 0 AND 1 AND t > 0 AND t < 1 UNION SELECT DISTINCT project, feeder, node, leg, layer, unnest([0.0::DOUBLE, 1.0::DOUBLE]) FROM met),
  parts AS (SELECT *, lead(t) OVER (PARTITION BY project, feeder, node, leg, layer ORDER BY t) AS t1 FROM cuts),
  middles AS (SELECT p.project, p.feeder, p.node, p.leg, p.layer, t, t1, l.length, x1 + (t + t1) / 2 * (x2 - x1) AS mx, y1 + (t + t1) / 2 * (y2 - y1) AS my, coalesce(f.length, 0) AS "from" FROM parts p JOIN legs l USING (project, feeder, node, leg) LEFT JOIN (SELECT project, feeder, node, length FROM legs WHERE leg = 0) f ON p.leg = 1 AND f.project = p.project AND f.feeder = p.feeder AND f.node = p.node WHERE t1 IS NOT NULL),
  stretches AS (SELECT m.project, m.feeder, m.node, m.layer, any_value(o.is_hard) AS is_hard, "from" + t * length AS begin_, "from" + t1 * length AS end_ FROM middles m JOIN outlines o ON o.project = m.project AND o.layer = m.layer GROUP BY m.project, m.feeder, m.node, m.leg, m.layer, t, t1, length, "from", mx, my HAVING count(*) FILTER ((y1 > my) <> (y2 > my) AND x1 + (my - y1) * (x2 - x1) / CASE WHEN y2 = y1 THEN 1 ELSE y2 - y1 END > mx) % 2 = 1)"""

SQL = {
    "row_areas": f"""WITH {_PIECES}, named AS ({_NAMED}), {_covered('own', 'project, feeder, node', 'named', False)}, {_covered('joint', 'project', 'named', False)},
  single AS (SELECT project, count(DISTINCT (feeder, node)) AS n_corridors, round(sum((high - low) * height), 1) AS total_m2 FROM own WHERE high > low GROUP BY 1)
SELECT project, n_corridors, total_m2, unique_m2 FROM single JOIN (SELECT project, round(sum((high - low) * height), 1) AS unique_m2 FROM joint WHERE high > low GROUP BY 1) USING (project)""",
    "row_intersections": f"""WITH {_PIECES}, {_RINGS}, {_SHARED.replace('strips JOIN', '(SELECT * FROM strips WHERE high > low) JOIN')}, {_STRETCHES}, lengths AS (SELECT project, feeder, node, layer, sum(end_ - begin_) AS length FROM stretches GROUP BY ALL)
SELECT project, feeder, node, layer, round(area, 2) AS area_m2, round(coalesce(length, 0), 3) AS overlap_m, FALSE AS touches_only FROM areas LEFT JOIN lengths USING (project, feeder, node, layer) WHERE area > 1e-6""",
    "areal_crossings": f"""WITH {_ROUTES}, {_RINGS}, {_STRETCHES},
  broken AS (SELECT *, sum(CASE WHEN begin_ > before + 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY project, feeder, node, layer ORDER BY begin_, end_) AS part FROM (SELECT *, lag(end_) OVER (PARTITION BY project, feeder, node, layer ORDER BY begin_, end_) AS before FROM stretches WHERE NOT is_hard)),
  whole AS (SELECT project, feeder, node, layer, max(end_) - min(begin_) AS length FROM broken GROUP BY project, feeder, node, layer, part)
SELECT project, feeder, node, count(*) AS n_crossings, count(DISTINCT layer) AS n_roads, round(sum(length), 3) AS length_m FROM whole WHERE length > 1e-6 GROUP BY ALL""",
}
