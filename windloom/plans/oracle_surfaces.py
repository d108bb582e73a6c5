"""Equivalent SQL of the surfaces, their rasters and the cost of straight legs (least-cost paths have none)."""

from __future__ import annotations

from windloom.operators.routing import ROOT, SOFT_WEIGHT
from windloom.operators.surfaces import MAX_CELLS, ON_LINE, PADDING, RESOLUTION
from windloom.plans.oracle_routing import EDGES, LAYERS

_CELLS = "greatest(1, ceil((east - west) / {r})) * greatest(1, ceil((north - south) / {r}))"
SURFACES = f"""points AS (SELECT project, x, y FROM turbines UNION ALL SELECT DISTINCT project, {ROOT}, {ROOT} FROM turbines),
  box AS (SELECT project, min(x) - {PADDING} AS west, max(x) + {PADDING} AS east, min(y) - {PADDING} AS south, max(y) + {PADDING} AS north FROM points GROUP BY 1),
  used AS (SELECT *, CAST(CASE WHEN {_CELLS.format(r=RESOLUTION)} > {MAX_CELLS} THEN greatest({RESOLUTION}, ceil({RESOLUTION} * sqrt({_CELLS.format(r=RESOLUTION)} / {MAX_CELLS}))) ELSE {RESOLUTION} END AS BIGINT) AS resolution_m FROM box),
  surfaces AS (SELECT project, west, north, resolution_m, CAST(greatest(1, ceil((east - west) / resolution_m)) AS BIGINT) AS width, CAST(greatest(1, ceil((north - south) / resolution_m)) AS BIGINT) AS height, {_CELLS.format(r="resolution_m")} <= {MAX_CELLS} AS accepted FROM used)"""
RASTER = f"""columns_of AS (SELECT l.*, s.*, unnest(range(width)) AS col FROM layers l JOIN surfaces s USING (project) WHERE accepted),
  near AS (SELECT *, unnest(range(height)) AS row FROM columns_of WHERE abs(west + (col + 0.5) * resolution_m - lx) <= r),
  raster AS (SELECT project, row, col, bool_or(hard) AS blocked, count(*) FILTER (NOT hard) * {SOFT_WEIGHT}::DOUBLE AS added FROM near
    WHERE pow(west + (col + 0.5) * resolution_m - lx, 2) + pow(north - (row + 0.5) * resolution_m - ly, 2) <= r * r GROUP BY 1, 2, 3)"""


def _lines(c: str) -> str:
    return f"SELECT project, feeder, node, (k - {c}1) / ({c}2 - {c}1) AS t FROM (SELECT *, unnest(range(CAST(ceil(least({c}1, {c}2)) AS BIGINT), CAST(floor(greatest({c}1, {c}2)) AS BIGINT) + 1)) AS k FROM legs WHERE {c}1 <> {c}2)"


SQL = {
    "surfaces": f"WITH {EDGES}, {SURFACES} SELECT * FROM surfaces",
    "surface_raster": f"WITH {EDGES}, {LAYERS}, {SURFACES}, {RASTER} SELECT * FROM raster",
    "segment_costs": f"""WITH {EDGES}, {LAYERS}, {SURFACES}, {RASTER},
  legs AS (SELECT e.*, s.* EXCLUDE (project), (x1 - west)::DOUBLE / resolution_m AS u1, (north - y1)::DOUBLE / resolution_m AS v1, (x2 - west)::DOUBLE / resolution_m AS u2, (north - y2)::DOUBLE / resolution_m AS v2 FROM edges e JOIN surfaces s USING (project) WHERE accepted),
  stops AS (SELECT project, feeder, node, t FROM ({_lines("u")} UNION {_lines("v")}) WHERE t > 0 AND t < 1 UNION SELECT project, feeder, node, unnest([0.0::DOUBLE, 1.0::DOUBLE]) FROM legs),
  places AS (SELECT project, feeder, node, t, 0.0::DOUBLE AS share FROM stops UNION ALL SELECT project, feeder, node, (t + after) / 2, after - t FROM (SELECT *, lead(t) OVER (PARTITION BY project, feeder, node ORDER BY t) AS after FROM stops) WHERE after IS NOT NULL),
  spots AS (SELECT project, feeder, node, t, share, width, height, u1 + (u2 - u1) * t AS c, v1 + (v2 - v1) * t AS r FROM places JOIN legs USING (project, feeder, node)),
  cells AS (SELECT DISTINCT project, feeder, node, t, share, CAST(floor(r + i * {ON_LINE}::DOUBLE) AS BIGINT) AS row, CAST(floor(c + j * {ON_LINE}::DOUBLE) AS BIGINT) AS col, width, height FROM spots, (VALUES (-1), (1)) a(i), (VALUES (-1), (1)) b(j)),
  parts AS (SELECT c.project, feeder, node, t, share, row, col, coalesce(added, 0) AS added, coalesce(blocked, false) AS blocked FROM cells c LEFT JOIN raster USING (project, row, col) WHERE row BETWEEN 0 AND height - 1 AND col BETWEEN 0 AND width - 1),
  dear AS (SELECT project, feeder, node, t, any_value(share) AS share, max(added) AS added, bool_or(blocked) AS blocked FROM parts GROUP BY 1, 2, 3, 4),
  summed AS (SELECT project, feeder, node, sum(share * added) AS more, bool_or(blocked) AS blocked FROM dear GROUP BY 1, 2, 3),
  counted AS (SELECT project, feeder, node, count(DISTINCT (row, col)) AS n_cells FROM parts GROUP BY 1, 2, 3)
SELECT l.project, l.feeder, l.node, n_cells, NOT blocked AS is_open, CASE WHEN NOT blocked THEN round(sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE) * (1 + more), 3) END AS cost FROM legs l JOIN counted USING (project, feeder, node) JOIN summed USING (project, feeder, node)""",
}
