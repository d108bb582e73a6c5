"""Equivalent SQL of the network, geometry and survey queries."""

from __future__ import annotations

from windloom.operators.network import CABLES, EARTH_M, KV, MAX_SPAN, POLE_ANGLE, POWER_FACTOR, R_PER_KM, TARGET_SPAN, X_PER_KM
from windloom.operators.survey_rules import BOUNDARY, NOISE_FOLDERS, POINT_FOLDERS, POINT_NAMES
from windloom.plans.oracle import SEGMENTS, TURBINES

FEATURES = """features AS (
  SELECT p_partkey AS ordinal, p_size % 5 AS project, ['WTG-', 'T/', 'AP', 'GANTRY ', 'PSS ', 'BH-', 'CP_', 'Misc '][CAST(p_partkey % 8 + 1 AS INT)] || (p_partkey % 400) AS external_id,
    ['Project / Approved WTGs', 'My Places / Proposed WTG / Points', 'Survey / Boreholes', 'Evacuation / Towers', 'Grid / Substations', 'Documents', 'Rejected / Turbines', 'Temporary Places / Registration'][CAST(p_partkey // 8 % 8 + 1 AS INT)] AS folder FROM part)"""


def folder_kind(words: list) -> str:
    case = " ".join(f"WHEN {' OR '.join(f"contains(lower(x), '{w}')" for w in each)} THEN '{kind}'" for kind, each in words)
    return f"list_filter(list_transform(parts, lambda x: CASE {case} END), lambda t: t IS NOT NULL)[1]"


def name_kind(name: str, patterns: list) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(trim({name}), '{p}') THEN '{kind}'" for kind, p in patterns) + " END"


PARTS = (
    FEATURES
    + f""", split AS (SELECT *, list_filter(list_reverse(string_split(folder, ' / ')), lambda x: x <> '') AS p FROM features),
cut AS (SELECT * EXCLUDE (p), list_transform(p, lambda x: lower(x)) AS low, p FROM split),
short AS (SELECT * EXCLUDE (p, low), CASE WHEN list_contains(low, '{BOUNDARY}') THEN p[1:list_position(low, '{BOUNDARY}') - 1] ELSE p END AS p FROM cut),
parts AS (SELECT * EXCLUDE (p), list_filter(p, lambda x: lower(x) NOT IN ({", ".join(f"'{n}'" for n in NOISE_FOLDERS)})) AS parts FROM short)"""
)
CLASSIFIED = (
    PARTS
    + f""", typed AS (SELECT *, {folder_kind(POINT_FOLDERS)} AS by_folder, {name_kind("external_id", POINT_NAMES)} AS by_name FROM parts),
classified AS (SELECT *, coalesce(by_folder, by_name, 'UNKNOWN') AS asset_type, CASE WHEN by_folder IS NOT NULL THEN 'FOLDER' WHEN by_name IS NOT NULL THEN 'NAME' ELSE 'NONE' END AS rule FROM typed)"""
)
TREE = (
    TURBINES
    + """, above AS (SELECT project, feeder, k AS node, k AS above, 0 AS depth FROM turbines UNION ALL SELECT project, feeder, node, above // 2, depth + 1 FROM above WHERE above // 2 > 0),
loads AS (SELECT a.project, a.feeder, a.above AS node, CAST(sum(t.kw) AS BIGINT) AS downstream_kw, count(*) AS n_below FROM above a JOIN turbines t ON t.project = a.project AND t.feeder = a.feeder AND t.k = a.node GROUP BY ALL)"""
)
_AMPS = f"(downstream_kw / (sqrt(3.0::DOUBLE) * {KV}::DOUBLE * {POWER_FACTOR}::DOUBLE))"
_CABLE = " ".join(f"WHEN {a} >= round({_AMPS}, 6) - 1e-6::DOUBLE THEN '{n}'" for n, a in CABLES)
_CHANGE = f"sqrt(3.0::DOUBLE) * {_AMPS} * {R_PER_KM * POWER_FACTOR + X_PER_KM * (1 - POWER_FACTOR**2) ** 0.5}::DOUBLE * ((abs(t.x - coalesce(p.x, 10000)) + abs(t.y - coalesce(p.y, 10000))) / 1000.0::DOUBLE) / {KV * 1000}::DOUBLE * 100"
_HAV = f"2 * {EARTH_M}::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2))))"


def _inside() -> str:
    ring = [(2000, 2000), (15000, 4000), (18000, 16000), (9000, 11000), (3000, 17000)]
    edges, hits = [], []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        cross = f"({x2 - x1} * (y - {y1}) - {y2 - y1} * (x - {x1}))"
        edges.append(f"({cross} = 0 AND x BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND y BETWEEN {min(y1, y2)} AND {max(y1, y2)})")
        hits.append(f"CAST((({y1} > y) <> ({y2} > y)) AND {cross} {'>' if y2 > y1 else '<'} 0 AS INT)")
    return f"({' OR '.join(edges)}) OR (({' + '.join(hits)}) % 2 = 1)"


SQL = {
    "folder_segments": f"WITH {PARTS} SELECT ordinal, array_to_string(parts, ' < ') AS parts FROM parts",
    "classify_points": f"WITH {CLASSIFIED} SELECT ordinal, asset_type, rule FROM classified",
    "import_disposition": f"WITH {CLASSIFIED} SELECT project, CASE asset_type WHEN 'SURVEY_POINT' THEN 'DROPPED_SURVEY' WHEN 'UNKNOWN' THEN 'UNRESOLVED' ELSE 'IMPORTED' END AS disposition, count(*) AS n FROM classified GROUP BY ALL",
    "normalised_dedup": f"WITH {FEATURES}, keyed AS (SELECT *, regexp_replace(upper(trim(external_id)), '[\\s_.-]', '', 'g') AS key FROM features) SELECT project, ordinal, key FROM keyed WHERE NOT EXISTS (SELECT 1 FROM customer WHERE key = 'WTG' || c_custkey AND project = c_nationkey) QUALIFY row_number() OVER (PARTITION BY project, key ORDER BY ordinal) = 1",
    "geojson_parse": f"WITH {TURBINES} SELECT CAST(turbine_id AS VARCHAR) AS id, CAST(x // 100 AS INT) AS lon, CAST(y // 200 AS INT) AS lat, kw FROM turbines WHERE x // 100 <= 180 AND y // 200 <= 90",
    "complete_graph": f"WITH {TURBINES} SELECT a.project, a.feeder, count(*) AS n_edges, CAST(sum((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS BIGINT) AS sum_sq FROM turbines a JOIN turbines b ON a.project = b.project AND a.feeder = b.feeder AND a.k < b.k GROUP BY 1, 2",
    "downstream_power": f"WITH RECURSIVE {TREE} SELECT * FROM loads",
    "cable_sizing": f"WITH RECURSIVE {TREE} SELECT project, feeder, node, round(round({_AMPS}, 6), 3) AS amps, CASE {_CABLE} END AS cable FROM loads",
    "path_voltage": f"WITH RECURSIVE {TREE}, edge AS (SELECT t.project, t.feeder, t.k AS above, CAST(round(({_CHANGE}) * 1e6) AS BIGINT) AS change FROM turbines t LEFT JOIN turbines p ON p.project = t.project AND p.feeder = t.feeder AND p.k = t.k // 2 JOIN loads l ON l.project = t.project AND l.feeder = t.feeder AND l.node = t.k) SELECT project, feeder, node, CAST(sum(change) AS BIGINT) AS change_micropct, max(depth) AS depth FROM above JOIN edge USING (project, feeder, above) GROUP BY 1, 2, 3",
    "nearest_substation": f"WITH {TURBINES}, s AS (SELECT s_suppkey AS substation_id, s_nationkey AS project, s_suppkey * 6151 % 20000 AS sx, s_suppkey * 3079 % 20000 AS sy FROM supplier), d AS (SELECT turbine_id, substation_id, (x - sx) * (x - sx) + (y - sy) * (y - sy) AS distance_sq FROM turbines JOIN s USING (project)) SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY distance_sq, substation_id) = 1",
    "polyline_length": f"WITH {TURBINES}, v AS (SELECT *, x / 10000.0::DOUBLE AS lon, y / 10000.0::DOUBLE AS lat FROM turbines), l AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM v WINDOW w AS (PARTITION BY project, feeder ORDER BY k)) SELECT project, feeder, round(coalesce(sum({_HAV}), 0.0), 2) AS length_m, count(*) AS n_vertices FROM l GROUP BY 1, 2",
    "deflection_angles": f"WITH {TURBINES}, v AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM turbines WINDOW w AS (PARTITION BY project, feeder ORDER BY k)), l AS (SELECT *, sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) AS la, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS lb FROM v WHERE x0 IS NOT NULL AND x2 IS NOT NULL), a AS (SELECT *, round(CASE WHEN la < 1e-9 OR lb < 1e-9 THEN 0.0::DOUBLE ELSE degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((x - x0) * (x2 - x) + (y - y0) * (y2 - y)) / (la * lb))))) END, 4) AS angle FROM l) SELECT project, feeder, k, angle, angle >= {POLE_ANGLE} AS angle_pole FROM a",
    "span_plan": f"WITH {SEGMENTS}, n AS (SELECT segment_id, length_m::DOUBLE AS len, greatest(1, CAST(round_even(length_m::DOUBLE / {TARGET_SPAN}::DOUBLE, 0) AS INT), CAST(ceil(length_m::DOUBLE / ({MAX_SPAN}::DOUBLE + 1e-9::DOUBLE)) AS INT)) AS n_spans FROM segments) SELECT segment_id, n_spans, round(len / n_spans, 6) AS span_m FROM n",
    "grid_cells": f"WITH {TURBINES} SELECT project, CAST((20000 - y) // 500 AS INT) AS row, CAST(x // 500 AS INT) AS col, count(*) AS n, CAST(sum(kw) AS BIGINT) AS kw FROM turbines GROUP BY 1, 2, 3",
    "point_in_polygon": f"WITH {TURBINES} SELECT turbine_id, {_inside()} AS inside FROM turbines",
    "login_window": "SELECT event_id, count(*) FILTER (event_type = 'error') OVER w AS fails, count(*) FILTER (event_type = 'error') OVER w >= 5 AS locked FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW)",
}
