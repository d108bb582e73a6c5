"""Equivalent SQL of the feeder graph queries."""

from __future__ import annotations

from windloom.operators.network import CABLES, MAX_SPAN, TARGET_SPAN
from windloom.operators.topology import ALPHA, FEEDER_KW, MAX_CHANGE_PCT, REACH, utm
from windloom.plans import oracle_network
from windloom.plans.oracle import SEGMENTS, TURBINES
from windloom.plans.oracle_network import _AMPS, TREE

PAIRS = f"""{TURBINES}, load AS (SELECT project, feeder, sum(kw) AS load FROM turbines GROUP BY ALL), t AS (SELECT turbines.*, load FROM turbines JOIN load USING (project, feeder)),
pairs AS (SELECT a.project, a.turbine_id AS u, b.turbine_id AS v, a.feeder AS fu, b.feeder AS fv, a.kw AS ku, b.kw AS kv, a.load AS lu, b.load AS lv, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d
  FROM t a JOIN t b ON a.project = b.project AND a.feeder <> b.feeder WHERE d <= {REACH * REACH}),
moves AS (SELECT project, u, fv AS feeder, v, d FROM pairs WHERE lv + ku <= {FEEDER_KW} QUALIFY row_number() OVER (PARTITION BY project, u, fv ORDER BY d, v) = 1)"""
_EAST, _NORTH = utm("lon", "lat", "zone")

SQL = {
    "long_edge_weight": f"WITH {TURBINES}, e AS (SELECT a.project, a.feeder, a.k AS u, b.k AS v, sqrt(CAST(a.x - b.x AS DOUBLE) * (a.x - b.x) + CAST(a.y - b.y AS DOUBLE) * (a.y - b.y)) AS w FROM turbines a JOIN turbines b ON a.project = b.project AND a.feeder = b.feeder AND a.k < b.k) SELECT project, feeder, u, v, round(w * (1 + {ALPHA}::DOUBLE * w / max(w) OVER (PARTITION BY project, feeder)), 3) AS weight FROM e",
    "bfs_order": f"WITH RECURSIVE {TURBINES}, walk AS (SELECT project, feeder, k AS node, 0 AS depth, [k] AS path FROM turbines WHERE k = 1 UNION ALL SELECT t.project, t.feeder, t.k, depth + 1, list_append(path, t.k) FROM walk w JOIN turbines t ON t.project = w.project AND t.feeder = w.feeder AND t.k // 2 = w.node) SELECT project, feeder, node, depth, row_number() OVER (PARTITION BY project, feeder ORDER BY depth, path) AS place FROM walk",
    "feeder_screening": f"""WITH RECURSIVE {TREE}, volts AS ({{path}}), l AS (SELECT project, feeder, max(downstream_kw) AS kw, max(round({_AMPS}, 6)) AS amps FROM loads GROUP BY ALL), c AS (SELECT project, feeder, max(change_micropct) AS worst_micropct FROM volts GROUP BY ALL)
SELECT project, feeder, kw, round(amps, 3) AS amps, worst_micropct, array_to_string(list_filter([CASE WHEN amps > {CABLES[2][1]} THEN 'AMPACITY' END, CASE WHEN worst_micropct > {int(MAX_CHANGE_PCT * 1_000_000)} THEN 'VOLTAGE' END, CASE WHEN kw > {FEEDER_KW} THEN 'SUBSTATION_CAPACITY' END], lambda v: v IS NOT NULL), ',') AS violations FROM l JOIN c USING (project, feeder)""".replace("{path}", oracle_network.SQL["path_voltage"].removeprefix(f"WITH RECURSIVE {TREE}, ").join(["WITH ", ""])),
    "pole_positions": f"""WITH {SEGMENTS}, n AS (SELECT *, CAST(length_m AS DOUBLE) AS length, greatest(1, CAST(round_even(CAST(length_m AS DOUBLE) / {TARGET_SPAN}::DOUBLE, 0) AS INT), CAST(ceil(CAST(length_m AS DOUBLE) / ({MAX_SPAN}::DOUBLE + 1e-9::DOUBLE)) AS INT)) AS n FROM segments),
b AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n), e AS (SELECT *, unnest(range(0, n + 1)) AS i FROM b)
SELECT segment_id, CAST(i AS INT) AS ordinal, CAST(before + i + 1 AS BIGINT) AS number, round(length * i / n, 6) AS chainage_m, CASE WHEN i = 0 OR i = n THEN 'terminal' ELSE 'intermediate' END AS class FROM e""",
    "reassign_mutations": f"WITH {PAIRS} SELECT project, u, feeder, v, d FROM moves",
    "swap_mutations": f"WITH {PAIRS} SELECT project, u, v, d FROM pairs WHERE u < v AND lu - ku + kv <= {FEEDER_KW} AND lv - kv + ku <= {FEEDER_KW}",
    "topk_mutations": f"WITH {PAIRS} SELECT project, row_number() OVER (PARTITION BY project ORDER BY d, u, feeder) AS place, u, feeder, d FROM moves QUALIFY place <= 5",
    "feeder_spread": f"WITH {TURBINES}, c AS (SELECT project, feeder, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM turbines WINDOW w AS (PARTITION BY project, feeder)) SELECT project, feeder, round(avg(sqrt(dx * dx + dy * dy)), 3) AS mean_m, round(coalesce(stddev_samp(sqrt(dx * dx + dy * dy)), 0.0), 3) AS deviation_m FROM c GROUP BY ALL",
    "structure_check": f"WITH {TURBINES} SELECT t.project, t.feeder, count(*) FILTER (t.k // 2 > 0 AND p.k IS NULL) AS n_orphans, count(*) FILTER (t.k // 2 = 0) AS n_roots, sum(t.kw) <= {FEEDER_KW} AS within_capacity, count(*) FILTER (t.k // 2 > 0 AND p.k IS NULL) = 0 AND count(*) FILTER (t.k // 2 = 0) = 1 AS is_tree FROM turbines t LEFT JOIN turbines p ON p.project = t.project AND p.feeder = t.feeder AND p.k = t.k // 2 GROUP BY ALL",
    "utm_project": f"WITH {TURBINES}, g AS (SELECT turbine_id, x * 18 / 1000.0::DOUBLE - 180 AS lon, y * 8 / 1000.0::DOUBLE - 80 AS lat FROM turbines), z AS (SELECT *, CAST(least(floor((lon + 180) / 6) + 1, 60) AS INT) AS zone FROM g) SELECT turbine_id, zone, round({_EAST}, 2) AS easting, round({_NORTH}, 2) AS northing FROM z",
}
