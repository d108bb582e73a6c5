"""Equivalent SQL of the decision reports and corridors."""

from __future__ import annotations

from windloom.operators.corridors import WIDTH
from windloom.operators.decision_report import COMPARED, EPSILON, REQUESTED
from windloom.plans.oracle import CANDIDATES, JOBS, SCORED
from windloom.plans.oracle_routing import EDGES, LAYERS

_ORDER = "(-total, length_m, losses_kw, candidate_id)"
_WINNERS = f"winners AS (SELECT cohort, arg_min(candidate_id, {_ORDER}) AS winner FROM scored GROUP BY 1)"
_REPORT = f"{SCORED}, {_WINNERS}, report AS (SELECT cohort, candidate_id, CASE WHEN len(reasons) > 0 THEN 'REJECTED' WHEN candidate_id = winner THEN 'RECOMMENDED' ELSE 'FEASIBLE' END AS standing, reasons[1] AS failure_code, array_to_string(reasons, ',') AS codes FROM judged LEFT JOIN winners USING (cohort))"


def _compare(others: str) -> str:
    part = lambda m, s: f"SELECT o.cohort, o.candidate_id, '{m}' AS metric, '{s}' AS significance, CAST(w.{m} AS DECIMAL(18,2)) AS own, CAST(o.{m} AS DECIMAL(18,2)) AS value FROM {others} o JOIN best w USING (cohort)"
    return f"""{SCORED}, {_WINNERS}, best AS (SELECT s.* FROM scored s JOIN winners w ON s.cohort = w.cohort AND candidate_id = winner), others AS (SELECT s.* FROM scored s JOIN winners w ON s.cohort = w.cohort AND candidate_id <> winner),
  seconds AS (SELECT * FROM others QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY total DESC, length_m, losses_kw, candidate_id) = 1), long AS ({" UNION ALL ".join(part(m, s) for m, s in COMPARED.items())}),
  compared AS (SELECT cohort, candidate_id, metric, significance, CAST(own - value AS DECIMAL(19,2)) AS delta, CASE WHEN abs(value) > {EPSILON} THEN round((own - value)::DOUBLE / value::DOUBLE, 6) END AS relative, CASE WHEN own < value THEN 'BETTER' WHEN own > value THEN 'WORSE' ELSE 'EQUAL' END AS outcome FROM long)"""


SQL = {
    "decision_report": f"WITH {_REPORT} SELECT * FROM report",
    "report_comparisons": f"WITH {_compare('others')} SELECT * FROM compared",
    "report_factors": f"WITH {_compare('seconds')} SELECT cohort, candidate_id AS second, metric, significance, CASE WHEN outcome = 'BETTER' THEN 'ADVANTAGE' ELSE 'DISADVANTAGE' END AS side, delta FROM compared WHERE outcome <> 'EQUAL'",
    "report_summary": f"WITH {_REPORT} SELECT cohort, count(*) AS n, count(*) FILTER (standing <> 'REJECTED') AS n_feasible, count(*) FILTER (standing = 'REJECTED') AS n_rejected, max(candidate_id) FILTER (standing = 'RECOMMENDED') AS recommended FROM report GROUP BY 1",
    "report_rejections": f"WITH {_REPORT} SELECT cohort, failure_code, count(*) AS n, min(candidate_id) AS first_id FROM report WHERE standing = 'REJECTED' GROUP BY 1, 2",
    "distinct_scenarios": f"WITH {CANDIDATES}, firsts AS (SELECT cohort, sha256(parcels || '|' || crossings) AS fingerprint, min(candidate_id) AS candidate_id, count(*) AS n_equal FROM candidates GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY cohort ORDER BY candidate_id) AS INT) AS place FROM firsts QUALIFY place <= {REQUESTED}",
    "stale_jobs": f"WITH {JOBS} SELECT job_id, project, CASE WHEN status IN ('PENDING', 'RUNNING') THEN 'FAILED' ELSE status END AS status, status IN ('PENDING', 'RUNNING') AS swept FROM jobs",
    "corridor_areas": f"""WITH {EDGES}, {LAYERS}, met AS (SELECT e.*, d.layer, d.lx, d.ly, d.r, d.hard, sqrt(((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))::DOUBLE) AS len FROM edges e JOIN layers d USING (project)),
  placed AS (SELECT *, ((x2 - x1) * (lx - x1) + (y2 - y1) * (ly - y1))::DOUBLE / len AS along, ((x2 - x1) * (ly - y1) - (y2 - y1) * (lx - x1))::DOUBLE / len AS beside FROM met WHERE len > 0),
  strips AS (SELECT *, (r * r)::DOUBLE - (beside - (strip - {(WIDTH - 1) / 2}::DOUBLE)) * (beside - (strip - {(WIDTH - 1) / 2}::DOUBLE)) AS h2 FROM placed, range({WIDTH}) AS s(strip)),
  summed AS (SELECT project, feeder, node, layer, hard, sum(floor(greatest(0.0::DOUBLE, least(len, along + sqrt(h2)) - greatest(0.0::DOUBLE, along - sqrt(h2))) * 1000 + 0.5::DOUBLE)) AS mm FROM strips WHERE h2 > 0 GROUP BY ALL)
  SELECT project, feeder, node, layer, hard, mm / 1000 AS area_m2 FROM summed WHERE mm > 0""",
    "shared_poles": f"""WITH {EDGES}, ends AS (SELECT project, x1 AS x, y1 AS y FROM edges UNION ALL SELECT project, x2, y2 FROM edges WHERE x1 <> x2 OR y1 <> y2), poles AS (SELECT project, x, y, count(*) AS n_routes FROM ends GROUP BY ALL)
  SELECT *, CASE WHEN n_routes > 1 THEN 'junction' ELSE 'terminal' END AS role, CASE WHEN n_routes > 1 THEN 'JUNCTION-' ELSE 'TERMINAL-' END || substr(sha256(project || '|' || x || '|' || y), 1, 12) AS pole_id FROM poles""",
}
