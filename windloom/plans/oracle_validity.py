"""Equivalent SQL of the validity of rings: all pairs of edges, slabs over whole rings."""

from __future__ import annotations

_POINT = {c: f"{{'x': cx{x}, 'y': cy{y}}}" for c, x, y in (("a", " - r", " - r"), ("b", " + r", " - r"), ("c", " + r", " + r"), ("d", "", ""), ("e", " - r", " + r"))}


def _ring(names: str) -> str:
    return "[" + ", ".join(_POINT[n] for n in names) + "]"


_FORMS = " ".join(f"WHEN layer % 11 = {k} THEN {_ring(names)}" for k, names in ((7, "acbe"), (6, "abbcdea"), (5, "adceb"), (4, "abcbe"), (3, "abdced"), (2, "aca"), (1, "adc"), (8, "abceabcd")))


def _side(a: int, b: int, p: int) -> str:
    return f"sign((x{b} - x{a}) * (y{p} - y{a}) - (y{b} - y{a}) * (x{p} - x{a}))"


def _overlap(c: str) -> str:
    return f"least({c}1, {c}2) <= greatest({c}3, {c}4) AND least({c}3, {c}4) <= greatest({c}1, {c}2)"


_CROSS = "((x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3))"

SQL = {
    "ring_validity": f"""WITH centres AS (SELECT s_nationkey AS project, s_suppkey AS layer, s_suppkey * 6151 % 18000 + 1000 AS cx, s_suppkey * 3079 % 18000 + 1000 AS cy, 600 + s_suppkey % 5 * 400 AS r FROM supplier),
  rings AS (SELECT project, layer, CASE {_FORMS} ELSE {_ring("abcde")} END AS ring FROM centres),
  points AS (SELECT project, layer, len(list_distinct(ring)) AS n_points, unnest(ring) AS p, generate_subscripts(ring, 1) AS k, len(ring) AS size FROM rings),
  moves AS (SELECT a.project, a.layer, a.p.x AS x1, a.p.y AS y1, row_number() OVER (PARTITION BY a.layer ORDER BY a.k) - 1 AS i, count(*) OVER (PARTITION BY a.layer) AS n FROM points a JOIN points b ON a.layer = b.layer AND b.k = CASE WHEN a.k = 1 THEN a.size ELSE a.k - 1 END WHERE a.p <> b.p AND a.n_points > 2),
  edges AS (SELECT m.*, t.x1 AS x2, t.y1 AS y2 FROM moves m JOIN moves t ON m.layer = t.layer AND t.i = (m.i + 1) % m.n),
  pairs AS (SELECT a.*, b.i AS j, b.x1 AS x3, b.y1 AS y3, b.x2 AS x4, b.y2 AS y4 FROM edges a JOIN edges b ON a.layer = b.layer AND a.i < b.i),
  touches AS (SELECT project, layer, CASE WHEN {_CROSS} <> 0 THEN y1 + (((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3))::DOUBLE / {_CROSS}) * (y2 - y1) END AS y FROM pairs
    WHERE CASE WHEN j = i + 1 OR (i = 0 AND j = n - 1) THEN {_CROSS} = 0 AND (x2 - x1) * (x4 - x3) + (y2 - y1) * (y4 - y3) < 0
      ELSE {_overlap("x")} AND {_overlap("y")} AND {_side(1, 2, 3)} * {_side(1, 2, 4)} <= 0 AND {_side(3, 4, 1)} * {_side(3, 4, 2)} <= 0 END),
  heights AS (SELECT layer, y1::DOUBLE AS y FROM edges UNION SELECT layer, y FROM touches WHERE y IS NOT NULL),
  slabs AS (SELECT * FROM (SELECT layer, y AS low, lead(y) OVER (PARTITION BY layer ORDER BY y) AS high FROM heights) WHERE high IS NOT NULL),
  crossed AS (SELECT e.layer, low, high, x1 + ((low + high) / 2 - y1) / (y2 - y1) * (x2 - x1) AS x FROM edges e JOIN slabs s ON e.layer = s.layer AND y1 <> y2 AND least(y1, y2) <= low AND greatest(y1, y2) >= high),
  turns AS (SELECT layer, (high - low) * x AS part, row_number() OVER (PARTITION BY layer, low ORDER BY x) % 2 AS odd FROM crossed),
  areas AS (SELECT layer, sum(CASE WHEN odd = 1 THEN -part ELSE part END) AS area FROM turns GROUP BY 1),
  counted AS (SELECT layer, count(*) AS n_contacts FROM touches GROUP BY 1)
SELECT r.project, r.layer, CASE WHEN len(list_distinct(ring)) < 3 THEN 'TOO_FEW_POINTS' WHEN coalesce(round(area, 6), 0) <= 0 THEN 'NO_AREA' WHEN n_contacts > 0 THEN 'REPAIRED' ELSE 'VALID' END AS state, coalesce(n_contacts, 0) AS n_contacts, CASE WHEN round(area, 6) > 0 THEN round(area, 2) END AS area_m2
FROM rings r LEFT JOIN counted USING (layer) LEFT JOIN areas USING (layer)""",
}
