"""SQL of the assembly queries."""

from __future__ import annotations

from windloom.operators.assembly import CACHE_ENTRIES
from windloom.operators.network import KV
from windloom.plans.oracle import CANDIDATES, TURBINES
from windloom.plans.oracle_network import TREE
from windloom.plans.oracle_topology import SQL as TOPOLOGY

EDGES = (
    TURBINES
    + """, edges AS (SELECT t.project, t.feeder, t.k // 2 AS u, t.k AS v, t.turbine_id, coalesce(p.x, 10000) AS ux, coalesce(p.y, 10000) AS uy, t.x AS vx, t.y AS vy, abs(t.x - coalesce(p.x, 10000)) + abs(t.y - coalesce(p.y, 10000)) AS length_m,
    least(t.k // 2, t.k) AS low, greatest(t.k // 2, t.k) AS high FROM turbines t LEFT JOIN turbines p ON p.project = t.project AND p.feeder = t.feeder AND p.k = t.k // 2)"""
)
ROUTES = (
    EDGES
    + """, ways AS (SELECT project, feeder, CASE WHEN turbine_id % 2 = 0 THEN v ELSE u END AS start_node, CASE WHEN turbine_id % 2 = 0 THEN u ELSE v END AS end_node,
    CASE WHEN turbine_id % 2 = 0 THEN vx ELSE ux END + CASE WHEN turbine_id % 83 = 0 THEN 1 ELSE 0 END AS sx, CASE WHEN turbine_id % 2 = 0 THEN vy ELSE uy END AS sy, CASE WHEN turbine_id % 2 = 0 THEN ux ELSE vx END AS ex, CASE WHEN turbine_id % 2 = 0 THEN uy ELSE vy END AS ey,
    length_m + CASE WHEN turbine_id % 79 = 0 THEN 5 ELSE 0 END AS route_m, turbine_id AS route_id FROM edges WHERE turbine_id % 97 <> 0),
  all_ways AS (SELECT * FROM ways UNION ALL SELECT * REPLACE (-route_id AS route_id) FROM ways WHERE route_id % 89 = 0 UNION ALL SELECT * REPLACE (start_node + 20 AS end_node, route_id + 1000000000 AS route_id) FROM ways WHERE route_id % 101 = 0),
  routes AS (SELECT *, least(start_node, end_node) AS low, greatest(start_node, end_node) AS high FROM all_ways)"""
)
SEGMENTS = (
    ROUTES
    + """, best AS (SELECT project, feeder, low, high, arg_min({'s': start_node, 'm': route_m}, route_id) AS r FROM routes GROUP BY 1, 2, 3, 4),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY project, feeder ORDER BY u, v) AS number FROM edges),
  assembled AS (SELECT e.project, 'SEG-FDR' || lpad(CAST(e.feeder + 1 AS VARCHAR), CAST(greatest(3, len(CAST(e.feeder + 1 AS VARCHAR))) AS INT), '0') || '-' || lpad(CAST(number AS VARCHAR), CAST(greatest(4, len(CAST(number AS VARCHAR))) AS INT), '0') AS segment_id, 'FDR-' || lpad(CAST(e.feeder + 1 AS VARCHAR), CAST(greatest(3, len(CAST(e.feeder + 1 AS VARCHAR))) AS INT), '0') AS feeder_id, u, v, r.m AS length_m,
    r.s <> u AS is_reversed, CASE WHEN u = 0 THEN 'substation_to_turbine' ELSE 'turbine_to_turbine' END AS segment_type FROM numbered e JOIN best b ON b.project = e.project AND b.feeder = e.feeder AND b.low = e.low AND b.high = e.high)"""
)
RESULTS = (
    TURBINES
    + """, nodes AS (SELECT project, feeder, CASE WHEN turbine_id % 59 = 0 THEN k + 30 ELSE k END AS node, 1000000 - turbine_id * 7919 % 60000 + 20000 AS micro_pu FROM turbines WHERE turbine_id % 61 <> 0),
  loaded AS (SELECT project, feeder, k AS node, turbine_id * 104729 % 120000 AS loading_milli, turbine_id * 31 % 5000 AS loss_w FROM turbines WHERE turbine_id % 67 <> 0)"""
)


def _compare(table: str, name: str) -> str:
    return f"""{name} AS (SELECT coalesce(t.project, r.project) AS project, count(*) FILTER (r.node IS NULL) AS {name}_missing, count(*) FILTER (t.k IS NULL) AS {name}_unknown
      FROM turbines t FULL JOIN {table} r ON r.project = t.project AND r.feeder = t.feeder AND r.node = t.k GROUP BY 1)"""


def _half_even(value: str, digits: int) -> str:
    """Of a whole number of millionths: half to even at so many digits."""
    unit = 10 ** (6 - digits)
    return f"CAST(CASE WHEN {value} % {unit} * 2 > {unit} OR ({value} % {unit} * 2 = {unit} AND {value} // {unit} % 2 = 1) THEN {value} // {unit} + 1 ELSE {value} // {unit} END AS DECIMAL(18,{digits})) / {10**digits}"


_KEY = "project = e.project AND b.feeder = e.feeder"
_ENDS = "CASE WHEN start_node = u THEN abs(sx - ux) <= 1e-6 AND abs(sy - uy) <= 1e-6 AND abs(ex - vx) <= 1e-6 AND abs(ey - vy) <= 1e-6 ELSE abs(sx - vx) <= 1e-6 AND abs(sy - vy) <= 1e-6 AND abs(ex - ux) <= 1e-6 AND abs(ey - uy) <= 1e-6 END"
_WHOLE = "failures = ''"

SQL = {
    "assembled_segments": f"WITH {SEGMENTS} SELECT * FROM assembled",
    "route_coverage": f"""WITH {ROUTES}, g AS (SELECT coalesce(r.project, e.project) AS project, coalesce(r.feeder, e.feeder) AS feeder, coalesce(r.low, e.low) AS low, coalesce(r.high, e.high) AS high, count(route_id) AS n_routes, count(u) AS n_edges, bool_and({_ENDS}) AS ends, bool_and(abs(route_m - e.length_m) <= 1e-3) AS length
        FROM routes r FULL JOIN edges e ON r.project = e.project AND r.feeder = e.feeder AND r.low = e.low AND r.high = e.high GROUP BY 1, 2, 3, 4),
      f AS (SELECT project, feeder, low, high, concat_ws(',', CASE WHEN n_edges = 0 THEN 'UNEXPECTED_ROUTE' END, CASE WHEN n_edges > 0 AND n_routes = 0 THEN 'MISSING_ROUTE' END, CASE WHEN n_edges > 0 AND n_routes > 1 THEN 'DUPLICATE_ROUTE' END,
        CASE WHEN n_edges > 0 AND NOT ends THEN 'ENDPOINT_MISMATCH' END, CASE WHEN n_edges > 0 AND NOT length THEN 'LENGTH_MISMATCH' END) AS faults FROM g) SELECT * FROM f WHERE faults <> ''""",
    "network_totals_by_feeder": f"WITH {SEGMENTS} SELECT project, feeder_id, string_agg(CAST(v AS VARCHAR), ' ' ORDER BY v) AS nodes, count(*) AS n_segments, CAST(sum(length_m) AS BIGINT) AS length_m, min(segment_id) AS first_segment FROM assembled GROUP BY 1, 2",
    "reconciliation": f"WITH {RESULTS}, {_compare('nodes', 'nodes_')}, {_compare('loaded', 'segments_')} SELECT project, nodes__missing AS nodes_missing, nodes__unknown AS nodes_unknown, segments__missing AS segments_missing, segments__unknown AS segments_unknown FROM nodes_ JOIN segments_ USING (project)",
    "feeder_extremes": f"""WITH {RESULTS}, v AS (SELECT project, feeder, min(micro_pu) AS min_micro_pu, max(micro_pu) AS max_micro_pu, arg_min(node, (-abs(micro_pu - 1000000), node)) AS worst_node FROM nodes GROUP BY 1, 2),
      s AS (SELECT project, feeder, max(loading_milli) AS max_loading_milli, arg_min(node, (-loading_milli, node)) AS most_loaded, CAST(sum(loss_w) AS BIGINT) AS loss_w FROM loaded GROUP BY 1, 2) SELECT * FROM v FULL JOIN s USING (project, feeder)""",
    "worst_turbines": f"""WITH {RESULTS}, v AS (SELECT project, max((abs(micro_pu - 1000000) // 1000, feeder, node)) AS w FROM nodes GROUP BY 1), s AS (SELECT project, max((loading_milli, feeder, node)) AS m FROM loaded GROUP BY 1)
      SELECT project, w[1] AS change_milli, w[2] AS worst_feeder, w[3] AS worst_node, m[2] AS loaded_feeder, m[3] AS loaded_node FROM v JOIN s USING (project)""",
    "enriched_features": f"""WITH {RESULTS} SELECT 'wtg-' || turbine_id AS id, CAST({_half_even('micro_pu', 4)} AS DECIMAL(10,4)) AS voltage_pu, CAST({_half_even(f'(micro_pu * {int(KV)})', 3)} AS DECIMAL(10,3)) AS voltage_kv, coalesce(abs(micro_pu - 1000000) > 50000, FALSE) AS is_violation
      FROM turbines t LEFT JOIN nodes n ON n.project = t.project AND n.feeder = t.feeder AND n.node = t.k""",
    "engineering_metrics": f"""WITH {CANDIDATES}, r AS (SELECT cohort, candidate_id, converged, CASE WHEN candidate_id % 29 = 0 THEN -length_m ELSE length_m END AS length_m, CASE WHEN candidate_id % 31 <> 0 THEN parcels END AS parcels, CASE WHEN candidate_id % 37 <> 0 THEN poles END AS poles,
        CASE WHEN candidate_id % 41 = 0 THEN -1 ELSE losses_kw END AS losses_kw, CASE WHEN candidate_id % 43 <> 0 THEN voltage_margin END AS voltage_margin FROM candidates),
      f AS (SELECT *, concat_ws(',', CASE WHEN length_m < 0 THEN 'PHYSICAL_METRICS_INVALID' END, CASE WHEN parcels IS NULL THEN 'SPATIAL_ANALYSIS_FAILED' END, CASE WHEN poles IS NULL THEN 'POLE_PLACEMENT_FAILED' END,
        CASE WHEN NOT converged THEN 'LOAD_FLOW_NOT_CONVERGED' WHEN voltage_margin IS NULL THEN 'ELECTRICAL_METRICS_MISSING' WHEN losses_kw < 0 THEN 'ELECTRICAL_METRICS_INVALID' END) AS failures FROM r)
      SELECT cohort, candidate_id, failures, CASE WHEN {_WHOLE} THEN length_m END AS length_m, CASE WHEN {_WHOLE} THEN parcels END AS parcels, CASE WHEN {_WHOLE} THEN poles END AS poles, CASE WHEN {_WHOLE} THEN losses_kw END AS losses_kw, CASE WHEN {_WHOLE} THEN voltage_margin END AS voltage_margin FROM f""",
    "topology_fingerprints": f"""WITH {EDGES}, h AS (SELECT project, feeder, sha256(string_agg(lpad(CAST(low AS VARCHAR), 3, '0') || '-' || lpad(CAST(high AS VARCHAR), 3, '0'), ',' ORDER BY low, high)) AS fingerprint FROM edges GROUP BY 1, 2)
      SELECT fingerprint, count(*) AS n_feeders, min((project, feeder))[1] AS first_project, min((project, feeder))[2] AS first_feeder FROM h GROUP BY 1""",
    "reconnect_mutations": f"""WITH RECURSIVE {TREE}, places AS (SELECT project, feeder, k AS node, x, y FROM turbines UNION ALL SELECT DISTINCT project, feeder, 0, 10000, 10000 FROM turbines),
      pairs AS (SELECT a.project, a.feeder, a.above AS cut, least(a.node, o.node) AS a, greatest(a.node, o.node) AS b, (i.x - o.x) * (i.x - o.x) + (i.y - o.y) * (i.y - o.y) AS d FROM above a JOIN places i ON i.project = a.project AND i.feeder = a.feeder AND i.node = a.node
        JOIN places o ON o.project = a.project AND o.feeder = a.feeder AND NOT (a.node = a.above AND o.node = a.above // 2)
        AND NOT EXISTS (SELECT 1 FROM above n WHERE n.project = a.project AND n.feeder = a.feeder AND n.above = a.above AND n.node = o.node))
      SELECT project, feeder, cut, min((d, a, b))[2] AS a, min((d, a, b))[3] AS b, min((d, a, b))[1] AS distance_sq FROM pairs GROUP BY 1, 2, 3""",
    "search_counters": f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY cohort, length_m, poles ORDER BY candidate_id) = 1 AS first FROM candidates), s AS (SELECT *, first AND NOT hard_violation AND candidate_id % 6 <> 0 AS run, converged AND violations = 0 AS good FROM r)
      SELECT cohort, count(*) AS proposed, count(*) FILTER (first) AS "unique", count(*) FILTER (NOT first) AS duplicate, count(*) FILTER (first AND hard_violation) AS rejected, count(*) FILTER (first AND NOT hard_violation AND candidate_id % 6 = 0) AS cache_hits,
        count(*) FILTER (run AND good) AS feasible, count(*) FILTER (run AND NOT good) AS failed FROM s GROUP BY 1""",
    "cached_evaluations": f"""WITH {CANDIDATES}, r AS (SELECT candidate_id, length_m || '/' || poles || '/' || (candidate_id % 2) AS key FROM candidates), held AS (SELECT key, min(candidate_id) AS entered FROM r WHERE candidate_id % 3 <> 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {CACHE_ENTRIES})
      SELECT r.key, count(*) AS n_proposals, min(candidate_id) AS first_id, bool_or(entered IS NOT NULL) AS is_hit FROM r LEFT JOIN held ON held.key = r.key WHERE candidate_id % 3 = 0 GROUP BY 1""",
    "candidate_summaries": f"""WITH {CANDIDATES} SELECT candidate_id, concat_ws('; ', 'SCN-' || CASE WHEN candidate_id < 1000 THEN lpad(CAST(candidate_id AS VARCHAR), 3, '0') ELSE CAST(candidate_id AS VARCHAR) END, length_m || ' m', poles || ' poles',
      CASE WHEN NOT converged THEN 'not converged' WHEN violations > 0 THEN violations || ' violations' ELSE 'feasible' END, coalesce(CAST(cost AS VARCHAR) || ' INR', 'Not costed')) AS summary FROM candidates""",
}
SQL["mutation_chain"] = f"""SELECT project, 'reassign' AS kind, d AS weight, u || '>' || feeder AS name FROM ({TOPOLOGY["reassign_mutations"]}) UNION ALL SELECT project, 'swap', d, u || '>' || v FROM ({TOPOLOGY["swap_mutations"]})
  UNION ALL SELECT project, 'reconnect', distance_sq, feeder || '>' || cut || '>' || a || '>' || b FROM ({SQL["reconnect_mutations"]})"""
