"""SQL of the endpoint clusters: each node's ends one after the other, by recursion."""

from __future__ import annotations

from windloom.operators.endpoints import TOLERANCE
from windloom.plans.oracle_routing import EDGES

_T2 = TOLERANCE * TOLERANCE

SQL = {
    "endpoint_clusters": f"""WITH RECURSIVE {EDGES}, numbered AS (SELECT *, feeder * 100 + node AS number FROM edges),
  ends AS (SELECT project, number AS route, number AS topology, x1 + number * 7 % 5 AS x, y1 + number * 11 % 4 AS y FROM numbered
    UNION SELECT project, number, CASE WHEN node // 2 > 0 THEN feeder * 100 + node // 2 ELSE 0 END, x2 + number * 13 % 6, y2 + number * 17 % 5 FROM numbered),
  placed AS (SELECT *, row_number() OVER (PARTITION BY project, topology ORDER BY route, x, y) AS i FROM ends),
  walk(project, topology, i, members) AS (
    SELECT DISTINCT project, topology, CAST(0 AS BIGINT), [{{'x': CAST(0 AS BIGINT), 'y': CAST(0 AS BIGINT), 'c': CAST(0 AS BIGINT)}}][2:] FROM ends
    UNION ALL
    SELECT w.project, w.topology, p.i, list_append(members, {{'x': CAST(p.x AS BIGINT), 'y': CAST(p.y AS BIGINT), 'c': CAST(coalesce(
        list_min(list_filter(list_transform(members, lambda m: m.c), lambda c: len(list_filter(members, lambda m: m.c = c AND (m.x - p.x) * (m.x - p.x) + (m.y - p.y) * (m.y - p.y) > {_T2})) = 0)), p.i) AS BIGINT)}})
    FROM walk w JOIN placed p ON p.project = w.project AND p.topology = w.topology AND p.i = w.i + 1),
  done AS (SELECT project, topology, arg_max(members, i) AS members FROM walk GROUP BY 1, 2),
  joined AS (SELECT p.*, d.members[p.i].c AS cluster FROM placed p JOIN done d USING (project, topology)),
  each AS (SELECT project, topology, cluster, count(DISTINCT route) AS n_routes, min({{'route': route, 'x': x, 'y': y}}) AS "at", array_to_string(list_sort(list_distinct(list(route))), ',') AS routes FROM joined GROUP BY 1, 2, 3)
SELECT project, topology, "at".route AS first_route, "at".x AS x, "at".y AS y, n_routes, CASE WHEN n_routes > 1 THEN 'junction' ELSE 'terminal' END AS kind, CASE WHEN n_routes > 1 THEN 'JUNCTION-' || substr(sha256(project || '|' || topology || '|' || routes), 1, 12) END AS pole_id FROM each""",
}
