"""Equivalent SQL of the raster, corridor and crossing queries (least-cost paths have none)."""

from __future__ import annotations

from windloom.operators.routing import CELL, EXTENT, ROOT, SOFT_WEIGHT
from windloom.plans.oracle import TURBINES

LAYERS = f"layers AS (SELECT s_nationkey AS project, s_suppkey AS layer, s_suppkey * 6151 % {EXTENT} AS lx, s_suppkey * 3079 % {EXTENT} AS ly, 300 + s_suppkey % 5 * 200 AS r, s_suppkey % 4 = 0 AS hard FROM supplier)"
EDGES = f"{TURBINES}, edges AS (SELECT t.project, t.feeder, t.k AS node, t.x AS x1, t.y AS y1, coalesce(p.x, {ROOT}) AS x2, coalesce(p.y, {ROOT}) AS y2 FROM turbines t LEFT JOIN turbines p ON p.project = t.project AND p.feeder = t.feeder AND p.k = t.k // 2)"


def _side(p: int, q: int, s: int) -> str:
    return f"sign((x{q} - x{p}) * (y{s} - y{p}) - (y{q} - y{p}) * (x{s} - x{p}))"


SQL = {
    "raster_constraints": f"WITH {LAYERS}, n AS (SELECT unnest(range(0, 60)) AS i), cells AS (SELECT a.i AS row, b.i AS col FROM n a, n b) SELECT project, row, col, bool_or(hard) AS blocked, count(*) FILTER (NOT hard) * {SOFT_WEIGHT}::DOUBLE AS added FROM layers, cells WHERE pow(col * {CELL} + {CELL // 2} - lx, 2) + pow(row * {CELL} + {CELL // 2} - ly, 2) <= r * r GROUP BY ALL",
    "row_overlaps": f"""WITH {EDGES}, {LAYERS}, pairs AS (SELECT e.*, layer, hard, CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE) AS a, CAST((x2 - x1) * (x1 - lx) + (y2 - y1) * (y1 - ly) AS DOUBLE) AS b, CAST((x1 - lx) * (x1 - lx) + (y1 - ly) * (y1 - ly) - r * r AS DOUBLE) AS c FROM edges e JOIN layers l ON l.project = e.project),
cut AS (SELECT *, greatest(0.0::DOUBLE, (-b - sqrt(b * b - a * c)) / a) AS t0, least(1.0::DOUBLE, (-b + sqrt(b * b - a * c)) / a) AS t1 FROM pairs WHERE a > 0 AND b * b - a * c > 0),
gains AS (SELECT *, greatest(0.0::DOUBLE, t1 - greatest(t0, coalesce(max(t1) OVER (PARTITION BY project, feeder, node, hard ORDER BY t0, t1, layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))) * sqrt(a) AS gain FROM cut WHERE t1 > t0)
SELECT project, feeder, node, round(sum(CASE WHEN hard THEN 0.0 ELSE gain END), 3) AS soft_m, bool_or(hard) AS meets_hard, count(*) AS n_layers FROM gains GROUP BY ALL""",
    "road_crossings": f"""WITH {EDGES}, {LAYERS}, roads AS (SELECT project, layer AS road, lx AS x3, ly AS y3, lx + 6000 AS x4, ly + layer % 7 * 1000 - 3000 AS y4 FROM layers)
SELECT e.project, e.feeder, count(*) AS n_crossings, count(DISTINCT road) AS n_roads FROM edges e JOIN roads r ON r.project = e.project WHERE {_side(1, 2, 3)} * {_side(1, 2, 4)} < 0 AND {_side(3, 4, 1)} * {_side(3, 4, 2)} < 0 GROUP BY ALL""",
}
