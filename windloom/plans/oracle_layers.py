"""SQL of the layer queries: no spatial join, every point or cell of a project against every edge."""

from __future__ import annotations

from windloom.operators.layers import CELL, OWNER_PENALTY, SITE, VALUE_SHARE
from windloom.operators.network import MAX_SPAN, MIN_SPAN, TARGET_SPAN
from windloom.plans.oracle import OPTIONS, TURBINES

RINGS = """centres AS (SELECT s_nationkey AS project, s_suppkey AS layer, s_suppkey * 6151 % 18000 + 1000 AS cx, s_suppkey * 3079 % 18000 + 1000 AS cy, 600 + s_suppkey % 5 * 400 AS r, s_suppkey % 3 * 40 AS buffer_m, s_suppkey % 4 <> 0 AS is_hard,
    CASE WHEN s_suppkey % 4 = 0 THEN 5 + s_suppkey % 7 END AS weight FROM supplier),
  corners AS (SELECT c.*, i, cx + dx * r AS x1, cy + dy * r AS y1, cx + ex * r AS x2, cy + ey * r AS y2 FROM centres c, (VALUES (1, -1, -1, 1, -1), (2, 1, -1, 1, 1), (3, 1, 1, 0, 0), (4, 0, 0, -1, 1), (5, -1, 1, -1, -1)) o(i, dx, dy, ex, ey))"""


def _side(x: str, y: str) -> str:
    return f"((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1))"


def _crosses(x: str, y: str) -> str:
    return f"((y1 > {y}) <> (y2 > {y}) AND CASE WHEN y2 > y1 THEN {_side(x, y)} > 0 ELSE {_side(x, y)} < 0 END)"


def _within(x: str, y: str, reach: str) -> str:
    dot, size = f"(({x} - x1) * (x2 - x1) + ({y} - y1) * (y2 - y1))", "((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
    to = lambda i: f"({x} - x{i}) * ({x} - x{i}) + ({y} - y{i}) * ({y} - y{i}) <= {reach} * {reach}"
    return f"CASE WHEN {dot} <= 0 THEN {to(1)} WHEN {dot} >= {size} THEN {to(2)} ELSE {_side(x, y)} * {_side(x, y)} <= {reach} * {reach} * {size} END"


def _inside(x: str, y: str, reach: str) -> str:
    return f"bool_or({_within(x, y, reach)}) OR sum(CAST({_crosses(x, y)} AS INT)) % 2 = 1"


_X, _Y = [f"c.col * {CELL}", f"(c.col * {CELL} + {CELL})"], [f"c.row * {CELL}", f"(c.row * {CELL} + {CELL})"]
_CORNERS = [(x, y) for y in _Y for x in _X]
_SIDES = ", ".join(_side(x, y) for x, y in _CORNERS)
_MET = f"(least(x1, x2) <= {_X[1]} AND greatest(x1, x2) >= {_X[0]} AND least(y1, y2) <= {_Y[1]} AND greatest(y1, y2) >= {_Y[0]} AND least({_SIDES}) <= 0 AND greatest({_SIDES}) >= 0)"


def _end(i: int) -> str:
    off = lambda v, a: f"greatest({a[0]} - {v}, {v} - {a[1]}, 0)"
    return f"{off(f'x{i}', _X)} * {off(f'x{i}', _X)} + {off(f'y{i}', _Y)} * {off(f'y{i}', _Y)} <= buffer_m * buffer_m"


_NEAR = " OR ".join([_MET, _end(1), _end(2), *[f"({_within(x, y, 'buffer_m')})" for x, y in _CORNERS]])
_LAYER_ID = "'L' || CASE WHEN layer % 23 = 0 THEN layer - 1 ELSE layer END"
_LENGTH = '("to" - "at")'
_LEGS = f"""{TURBINES}, near AS (SELECT project, feeder, k, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY project, feeder) AS n FROM turbines WINDOW w AS (PARTITION BY project, feeder ORDER BY k)),
  legs AS (SELECT *, coalesce(CAST(round(sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) * 1000) AS BIGINT), 0) AS leg, sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) AS la, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS lb, (x - x0) * (x2 - x) + (y - y0) * (y2 - y) AS dot FROM near),
  placed AS (SELECT *, CAST(sum(leg) OVER (PARTITION BY project, feeder ORDER BY k) AS BIGINT) AS "at", CASE WHEN x0 IS NOT NULL AND x2 IS NOT NULL AND la >= 1e-9 AND lb >= 1e-9 THEN round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, dot / (la * lb))))), 4) ELSE 0 END AS angle FROM legs),
  fixed AS (SELECT *, lead("at") OVER (PARTITION BY project, feeder ORDER BY k) AS "to" FROM placed WHERE k = 1 OR k = n OR angle >= 10),
  sections AS (SELECT *, CASE WHEN {_LENGTH} > {int(MIN_SPAN * 1000)} THEN greatest(1, CAST(round_even({_LENGTH} / {TARGET_SPAN * 1000}::DOUBLE, 0) AS INT), CAST(ceil({_LENGTH} / {MAX_SPAN * 1000 + 1e-6}::DOUBLE) AS INT)) ELSE 1 END AS spans FROM fixed),
  standing AS (SELECT project, feeder, "at", CASE WHEN k = 1 OR k = n THEN 'terminal' ELSE 'angle' END AS kind FROM fixed UNION ALL SELECT project, feeder, "at" + CAST(floor(i * {_LENGTH} / spans) AS BIGINT), 'intermediate' FROM (SELECT *, unnest(range(1, spans)) AS i FROM sections WHERE "to" IS NOT NULL AND spans > 1)),
  poles AS (SELECT project, feeder, "at", max(kind) AS kind FROM standing GROUP BY 1, 2, 3)"""
_N = 'row_number() OVER (PARTITION BY project, feeder ORDER BY "at")'

SQL = {
    "layer_scan": f"""WITH {RINGS}, area AS (SELECT layer, abs(sum(x1 * y2 - x2 * y1)) / 2.0::DOUBLE AS area_m2 FROM corners GROUP BY 1),
      s AS (SELECT layer, {_LAYER_ID} AS layer_id, CASE WHEN layer % 17 = 0 THEN 'UNSUPPORTED_TYPE' WHEN layer % 19 = 0 THEN 'TOO_FEW_POSITIONS' WHEN layer % 13 = 0 THEN 'NOT_CLOSED' WHEN count(*) OVER (PARTITION BY project, {_LAYER_ID}) > 1 THEN 'DUPLICATE_ID' WHEN is_hard AND layer % 29 = 0 THEN 'HARD_WITH_COST' END AS error FROM centres)
      SELECT layer, layer_id, error, CASE WHEN error IS NULL THEN area_m2 END AS area_m2 FROM s JOIN area USING (layer)""",
    "hard_endpoints": f"""WITH {TURBINES}, {RINGS}, c AS (SELECT turbine_id, layer FROM turbines t JOIN corners e ON e.project = t.project AND is_hard GROUP BY 1, 2 HAVING {_inside('x', 'y', 'buffer_m')})
      SELECT turbine_id, count(*) AS n_layers, string_agg(CAST(layer AS VARCHAR), ',' ORDER BY layer) AS layers FROM c GROUP BY 1""",
    "layer_raster": f"""WITH {RINGS}, boxed AS (SELECT *, least((cx - r - buffer_m) // {CELL}, {SITE // CELL - 1}) AS c0, (cx + r + buffer_m) // {CELL} AS c1, (cy - r - buffer_m) // {CELL} AS r0, (cy + r + buffer_m) // {CELL} AS r1 FROM corners),
      cells AS (SELECT b.*, c.col, r.row FROM boxed b, range(0, {SITE // CELL}) c(col), range(0, {SITE // CELL}) r(row) WHERE c.col BETWEEN c0 - 1 AND c1 + 1 AND r.row BETWEEN r0 - 1 AND r1 + 1),
      touched AS (SELECT project, layer, row, col, any_value(is_hard) AS is_hard, any_value(weight) AS weight FROM cells c GROUP BY 1, 2, 3, 4 HAVING bool_or({_NEAR}) OR sum(CAST({_crosses(_X[0], _Y[0])} AS INT)) % 2 = 1)
      SELECT project, row, col, bool_or(is_hard) AS blocked, CAST(coalesce(sum(weight), 0) AS BIGINT) AS soft_weight, count(*) AS n_layers FROM touched GROUP BY 1, 2, 3""",
    "land_layers": f"""WITH {OPTIONS}, best AS (SELECT parcel_id, min(present_value) AS value, bool_or(unavailable) AS unavailable FROM options WHERE parcel_id % 9 <> 0 GROUP BY 1)
      SELECT p_partkey AS parcel_id, p_partkey % 6 = 0 OR coalesce(unavailable, FALSE) AS is_hard, CASE WHEN NOT (p_partkey % 6 = 0 OR coalesce(unavailable, FALSE)) THEN round((1 + p_partkey % 4)::DOUBLE + CASE WHEN b.parcel_id IS NOT NULL THEN {OWNER_PENALTY} + coalesce(value * {VALUE_SHARE}::DOUBLE, 0) ELSE 0 END, 6) END AS weight
      FROM part LEFT JOIN best b ON b.parcel_id = p_partkey""",
    "bent_route_poles": f"""WITH {_LEGS} SELECT project, feeder, 'FDR-' || lpad(CAST(feeder + 1 AS VARCHAR), CAST(greatest(3, len(CAST(feeder + 1 AS VARCHAR))) AS INT), '0') || '-P' || CASE WHEN {_N} < 1000 THEN lpad(CAST({_N} AS VARCHAR), 3, '0') ELSE CAST({_N} AS VARCHAR) END AS pole_id, "at", kind FROM poles""",
    "pole_spans": f"""WITH {_LEGS}, s AS (SELECT *, lead("at") OVER (PARTITION BY project, feeder ORDER BY "at") - "at" AS span FROM poles)
      SELECT project, feeder, count(*) FILTER (kind = 'terminal') AS n_terminal, count(*) FILTER (kind = 'angle') AS n_angle, count(*) FILTER (kind = 'intermediate') AS n_intermediate, max(span) AS longest_mm, min(span) AS shortest_mm, coalesce(max(span) <= {int(MAX_SPAN * 1000) + 1} AND min(span) > 0, TRUE) AS is_valid FROM s GROUP BY 1, 2""",
    "parcel_poles": f"""WITH {TURBINES}, {RINGS}, o AS (SELECT turbine_id, layer FROM turbines t JOIN corners e ON e.project = t.project AND NOT is_hard GROUP BY 1, 2 HAVING {_inside('x', 'y', '0')})
      SELECT layer, CASE WHEN layer % 5 <> 0 THEN ['A', 'B', 'C'][CAST(layer % 3 + 1 AS INT)] || (layer % 40) END AS owner, count(*) AS n_poles FROM o GROUP BY 1, 2""",
}
