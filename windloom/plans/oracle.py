"""Equivalent SQL of the registered queries, for a second engine over the same tables."""

from __future__ import annotations

from windloom.operators.decide import COST_WEIGHT, DISCOUNT, ENGINEERING_WEIGHT, HOURS, LAND_FIXED, LAND_PER_M, LOSS_LOAD, PRICE_MWH, WEIGHTS, YEARS, annuity
from windloom.sources.bindings import METRICS

SEGMENTS = """segments AS (
  SELECT *, CASE WHEN feeder = 3 AND l_returnflag = 'N' THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(14,2)) END AS cost FROM (
    SELECT CASE WHEN l_suppkey % 11 <> 0 THEN l_suppkey % 7 END AS feeder, l_orderkey || '-' || l_linenumber AS segment_id,
      CAST(l_quantity * 37 AS DECIMAL(12,2)) AS length_m, l_linenumber % 8 AS cable, CAST(round(l_discount * 1000) AS INT) AS util_milli,
      CAST(round(l_tax * 1000) AS INT) AS loss_w, l_linestatus, l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM lineitem))"""
POLES = (
    SEGMENTS
    + """, poles AS (SELECT 'POLE-' || segment_id AS pole_id, l_linestatus, CASE WHEN l_linenumber > 1 THEN [segment_id, l_orderkey || '-' || (l_linenumber - 1)] ELSE [segment_id] END AS route_ids FROM segments)"""
)
TURBINES = """turbines AS (
  SELECT *, CAST(i // 10 AS INT) AS feeder, CAST(i % 10 + 1 AS INT) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY project ORDER BY x, y, turbine_id) - 1 AS i FROM (
      SELECT c_custkey AS turbine_id, c_nationkey AS project, c_custkey * 7919 % 20000 AS x, c_custkey * 104729 % 20000 AS y, 2000 + 100 * (c_custkey % 30) AS kw,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'APPROVED' WHEN 'MACHINERY' THEN 'REGISTRATION' WHEN 'FURNITURE' THEN 'PROPOSED' ELSE 'REJECTED' END AS status FROM customer)))"""
JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey % 25 AS project, o_orderpriority AS scenario, CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' AND o_orderkey % 10 = 0 THEN 'PENDING' WHEN o_orderstatus = 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
  o_orderdate AS created, CAST(o_totalprice AS DECIMAL(16,2)) AS capex FROM orders)"""
CANDIDATES = """candidates AS (
  SELECT o_custkey % 25 AS cohort, o_orderkey AS candidate_id, 60000 + o_orderkey * 7919 % 9000 AS length_m, 300 + o_orderkey * 104729 % 60 AS losses_kw, 560 + o_orderkey * 31 % 70 AS poles,
    o_orderkey * 17 % 9 AS parcels, o_orderkey * 13 % 5 AS crossings, 10 + o_orderkey * 101 % 40 AS voltage_margin, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_totalprice AS DECIMAL(16,2)) END AS cost,
    o_orderkey % 17 <> 0 AS converged, CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS violations, o_orderkey % 23 = 0 AS hard_violation, CASE WHEN o_orderkey % 5 = 0 THEN 'BASELINE' ELSE 'SEARCH' END AS strategy FROM orders),
judged AS (SELECT *, list_filter([CASE WHEN NOT converged THEN 'NOT_CONVERGED' END, CASE WHEN violations > 0 THEN 'LIMIT_VIOLATION' END, CASE WHEN hard_violation THEN 'HARD_CONSTRAINT' END, CASE WHEN cost IS NULL THEN 'INCOMPLETE_COST' END], lambda r: r IS NOT NULL) AS reasons FROM candidates)"""


def _benefit(m: str, up: bool) -> str:
    top = f"({m} - min({m}) OVER c)" if up else f"(max({m}) OVER c - {m})"
    return f"round(CASE WHEN max({m}) OVER c > min({m}) OVER c THEN {top}::DOUBLE / (max({m}) OVER c - min({m}) OVER c) ELSE 0.0 END, 9) AS b_{m}"


SCORED = (
    CANDIDATES
    + ", benefits AS (SELECT *, "
    + ", ".join(_benefit(m, up) for m, up in METRICS.items())
    + " FROM judged WHERE len(reasons) = 0 WINDOW c AS (PARTITION BY cohort)), scored AS (SELECT *, ("
    + " + ".join(f"CAST(round(b_{m} * 1000000000) AS BIGINT) * {round(w * 100)}" for m, w in WEIGHTS.items())
    + " + 50000) // 100000 / 1000000.0::DOUBLE AS total FROM benefits), ranked AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY total DESC, length_m, losses_kw, candidate_id) AS rank FROM scored)"
)
LATEST = JOBS + ", latest AS (SELECT * FROM jobs WHERE status = 'COMPLETED' QUALIFY row_number() OVER (PARTITION BY project, scenario ORDER BY created DESC, job_id DESC) = 1)"
_A20, _A25 = round(annuity(DISCOUNT, 20), 6), round(annuity(DISCOUNT, YEARS), 6)
OPTIONS = f"""options AS (
  SELECT p_partkey AS parcel_id, mode, p_partkey % 11 = 0 AS unavailable,
    CASE WHEN (p_partkey + length(mode)) % 7 <> 0 AND p_partkey % 11 <> 0 THEN round(price * up + price * yearly * factor, 2) END AS present_value
  FROM (SELECT p_partkey, CAST(round(p_retailprice) AS BIGINT) AS price FROM part),
    (VALUES ('EASEMENT', 20, 3, {_A20}::DOUBLE), ('LEASE', 0, 9, {_A25}::DOUBLE), ('PURCHASE', 100, 0, 0.0::DOUBLE)) o(mode, up, yearly, factor))"""
_MWH = f"(losses_kw * {HOURS} * {LOSS_LOAD}::DOUBLE / 1000)"

SQL = {
    "feeder_rollup": f"WITH {SEGMENTS} SELECT coalesce(CAST(feeder AS VARCHAR), 'Unassigned') AS feeder, count(*) AS n_segments, CAST(round(sum(length_m) / 1000, 3) AS DECIMAL(18,3)) AS length_km, CAST(sum(cost) AS DECIMAL(20,2)) AS cost, CAST(coalesce(sum(loss_w), 0) AS BIGINT) AS loss_w FROM segments GROUP BY 1",
    "conductor_totals": f"WITH {SEGMENTS} SELECT CASE WHEN cable = 0 THEN 'Not reported' ELSE 'cable-' || cable END AS conductor, count(*) AS n_segments, CAST(sum(length_m) AS DECIMAL(20,2)) AS length_m, max(util_milli) AS max_util_milli FROM segments GROUP BY 1",
    "poles_per_segment": f"WITH {POLES} SELECT segment_id, count(*) AS n_poles FROM (SELECT unnest(route_ids) AS segment_id FROM poles) GROUP BY 1",
    "count_by_role": f"WITH {POLES} SELECT role, count(*) AS n FROM (SELECT CASE WHEN len(route_ids) > 1 THEN 'junction' WHEN l_linestatus = 'O' THEN 'terminal' ELSE '' END AS role FROM poles) WHERE role <> '' GROUP BY 1",
    "network_totals": f"WITH {POLES} SELECT * FROM (SELECT count(*) AS n_segments, count(DISTINCT feeder) AS n_feeders, CAST(sum(length_m) AS DECIMAL(20,2)) AS length_m, CAST(sum(cost) AS DECIMAL(20,2)) AS cost, CAST(count(*) - count(cost) AS BIGINT) AS n_unpriced FROM segments), (SELECT count(DISTINCT pole_id) AS n_poles, CAST(sum(len(route_ids)) AS BIGINT) AS n_pole_places FROM poles)",
    "latest_completed_job": f"WITH {LATEST} SELECT project, scenario, job_id, capex FROM latest",
    "scenario_compare": f"WITH {LATEST}, base AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY project ORDER BY (scenario = '3-MEDIUM') DESC, created DESC, job_id DESC) = 1) SELECT l.project, l.scenario, l.capex, b.scenario AS base_scenario, CASE WHEN b.capex <> 0 THEN floor((l.capex - b.capex)::DOUBLE / b.capex::DOUBLE * 1000 + 0.5) / 10 END AS delta_pct FROM latest l JOIN base b USING (project)",
    "pending_or_running": f"WITH {JOBS} SELECT project, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'COMPLETED') AS completed FROM jobs GROUP BY 1",
    "audit_top50": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "route_pole_estimates": f"WITH {POLES}, counted AS (SELECT segment_id, count(*) AS counted FROM (SELECT unnest(route_ids) AS segment_id FROM poles WHERE len(route_ids) > 1) GROUP BY 1) SELECT counted IS NULL AS is_estimated, count(*) AS n_routes, CAST(sum(coalesce(counted, greatest(2, CAST(ceil(length_m / 150) AS INT) + 1))) AS BIGINT) AS n_poles FROM segments LEFT JOIN counted USING (segment_id) GROUP BY 1",
    "normalise_benefit": f"WITH {SCORED} SELECT candidate_id, {', '.join(f'b_{m}' for m in METRICS)} FROM scored",
    "eligibility_reasons": f"WITH {CANDIDATES} SELECT candidate_id, len(reasons) = 0 AS eligible, array_to_string(reasons, ',') AS reasons FROM judged",
    "cohort_rank": f"WITH {SCORED} SELECT cohort, candidate_id, total, CAST(rank AS INT) AS rank FROM ranked UNION ALL SELECT cohort, candidate_id, NULL, NULL FROM judged WHERE len(reasons) > 0",
    "cost_aware_rank": f"""WITH {SCORED}, saved AS (SELECT *, CASE WHEN max(cost) OVER c > min(cost) OVER c THEN CAST((2000000000 * CAST(100 * (max(cost) OVER c - cost) AS HUGEINT) + CAST(100 * (max(cost) OVER c - min(cost) OVER c) AS HUGEINT)) // (2 * CAST(100 * (max(cost) OVER c - min(cost) OVER c) AS HUGEINT)) AS BIGINT) ELSE 0 END AS saved FROM scored WINDOW c AS (PARTITION BY cohort)),
  final AS (SELECT *, ({round(ENGINEERING_WEIGHT * 10) * 1000} * CAST(round(total * 1000000) AS BIGINT) + {round(COST_WEIGHT * 10)} * saved + 5000) // 10000 / 1000000.0::DOUBLE AS final FROM saved)
  SELECT cohort, candidate_id, final, CAST(row_number() OVER (PARTITION BY cohort ORDER BY final DESC, total DESC, cost, length_m, losses_kw, candidate_id) AS INT) AS rank FROM final""",
    "runner_up": f"WITH {SCORED} SELECT cohort, max(CASE WHEN rank = 1 THEN candidate_id END) AS winner, max(CASE WHEN rank = 2 THEN candidate_id END) AS second, round(max(CASE WHEN rank = 1 THEN total END) - max(CASE WHEN rank = 2 THEN total END), 6) AS lead FROM ranked WHERE rank <= 2 GROUP BY 1",
    "baseline_delta": f"WITH {SCORED}, base AS (SELECT * FROM scored WHERE strategy = 'BASELINE' QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY total DESC, length_m, losses_kw, candidate_id) = 1) SELECT r.cohort, r.candidate_id AS winner, b.candidate_id AS baseline, r.length_m - b.length_m AS length_delta, r.losses_kw - b.losses_kw AS losses_delta, CASE WHEN r.losses_kw < b.losses_kw THEN 'BETTER' WHEN r.losses_kw > b.losses_kw THEN 'WORSE' ELSE 'EQUAL' END AS losses_verdict FROM ranked r LEFT JOIN base b USING (cohort) WHERE r.rank = 1",
    "score_share": f"WITH {SCORED}, points AS ("
    + " UNION ALL ".join(f"SELECT cohort, '{m}' AS metric, sum(CAST(round(b_{m} * {w}::DOUBLE * 1000000) AS BIGINT)) AS points FROM scored GROUP BY 1" for m, w in WEIGHTS.items())
    + ") SELECT cohort, metric, round(CASE WHEN sum(points) OVER c > 0 THEN points * 100.0::DOUBLE / sum(points) OVER c ELSE 0.0 END, 6) AS share_pct FROM points WINDOW c AS (PARTITION BY cohort)",
    "conductor_capex": f"WITH {SEGMENTS}, rates AS (SELECT k AS cable, 400000 + 50000 * k AS rate FROM range(1, 7) t(k)) SELECT feeder, CASE WHEN count(*) = count(rate) THEN CAST(sum(CAST(length_m * rate / 1000 AS DECIMAL(20,2))) AS DECIMAL(24,2)) END AS capex, CAST(count(*) - count(rate) AS BIGINT) AS n_without_rate FROM segments LEFT JOIN rates USING (cable) GROUP BY 1",
    "land_option_value": f"WITH {OPTIONS} SELECT * FROM options",
    "land_decision": f"WITH {OPTIONS} SELECT parcel_id, CASE WHEN bool_or(unavailable) THEN 'UNAVAILABLE' WHEN min(present_value) IS NULL THEN 'UNPRICED' ELSE 'DECIDED' END AS status, arg_min(mode, (present_value, mode)) FILTER (present_value IS NOT NULL) AS mode, min(present_value) AS present_value FROM options GROUP BY 1",
    "loss_opex": f"WITH {CANDIDATES} SELECT candidate_id, round({_MWH}, 4) AS mwh, round({_MWH} * {PRICE_MWH}, 2) AS cost_per_year, round({_MWH} * {PRICE_MWH} * {_A25}::DOUBLE, 2) AS present_value FROM candidates",
    "lifecycle_total": f"WITH {CANDIDATES} SELECT candidate_id, parcels * {LAND_FIXED} + parcels * 10 * {LAND_PER_M} AS land, round(cost::DOUBLE + {_MWH} * {PRICE_MWH} * {_A25}::DOUBLE + (parcels * {LAND_FIXED} + parcels * 10 * {LAND_PER_M}), 2) AS lifecycle_cost FROM candidates",
}
