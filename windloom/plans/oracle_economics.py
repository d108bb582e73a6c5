"""Equivalent SQL of the pole, land, scoring and trade-off queries."""

from __future__ import annotations

from windloom.operators.decide import LAND_FIXED, LAND_PER_M
from windloom.operators.economics import COMPENSATION_PER_M2, GROUP_WEIGHTS, GROUPS, POLE_RATES, ROUTE_WEIGHTS
from windloom.plans.oracle import CANDIDATES, OPTIONS, SCORED, SEGMENTS

_RATES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in POLE_RATES.items())
EXPOSURES = "exposures AS (SELECT l_orderkey % 500 AS scenario, l_partkey AS parcel_id, CAST(l_quantity AS BIGINT) AS overlap_m FROM lineitem)"
DECIDED = f"""{OPTIONS}, {EXPOSURES},
decision AS (SELECT parcel_id, bool_or(unavailable) AS unavailable, min(present_value) AS present_value FROM options GROUP BY 1),
decided AS (SELECT scenario, e.parcel_id, e.overlap_m, CASE WHEN p_size % 10 <> 0 THEN p_size END AS owner, CASE WHEN p_size % 3 = 0 THEN 'QUOTED' ELSE 'ESTIMATED' END AS basis, d.unavailable, CASE WHEN NOT d.unavailable THEN d.present_value END AS present_value
  FROM (SELECT scenario, parcel_id, sum(overlap_m) AS overlap_m FROM exposures GROUP BY ALL) e LEFT JOIN part ON p_partkey = e.parcel_id LEFT JOIN decision d ON d.parcel_id = e.parcel_id)"""
_ROUTE = " + ".join(f"CASE WHEN max({m}) OVER c > min({m}) OVER c THEN round(({m} - min({m}) OVER c)::DOUBLE / (max({m}) OVER c - min({m}) OVER c), 9) ELSE 0.0 END * {w}::DOUBLE" for m, w in ROUTE_WEIGHTS.items())
_GROUP = ", ".join(" + ".join(f"CAST(round(b_{m} * 1e9::DOUBLE) AS BIGINT) * {round(w * 10)}" for m, w in inside.items()) + f" AS g_{g}" for g, inside in GROUPS.items())
_UNIFIED = " + ".join(f"g_{g} * {round(w * 100)}" for g, w in GROUP_WEIGHTS.items())
UNIFIED = f"""{SCORED}, grouped AS (SELECT *, {_GROUP} FROM scored), unified AS (SELECT *, {_UNIFIED} AS unified FROM grouped),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY unified DESC, g_ELECTRICAL DESC, g_SPATIAL DESC, g_INFRA DESC, length_m, losses_kw, candidate_id) AS place FROM unified)"""
_LONG = " UNION ALL ".join(f"SELECT cohort, candidate_id, place, '{g}' AS metric_group, g_{g} AS score FROM placed" for g in GROUPS)


def _delta(m: str, up: bool) -> str:
    d = f"(c.{m} - b.{m})"
    return f"{d} AS {m}_delta, round(CASE WHEN b.{m} <> 0 THEN {d} * 100.0::DOUBLE / b.{m} END, 6) AS {m}_pct, CASE WHEN {d} = 0 THEN 'EQUAL' WHEN {d} {'>' if up else '<'} 0 THEN 'BETTER' ELSE 'WORSE' END AS {m}_verdict"


SQL = {
    "pole_capex": f"WITH {SEGMENTS}, rated AS (SELECT l_orderkey AS network, CASE CASE WHEN l_linenumber > 1 THEN 'junction' WHEN l_linestatus = 'O' THEN 'terminal' WHEN l_returnflag = 'R' THEN 'angle' ELSE 'intermediate' END {_RATES} END AS rate FROM segments) SELECT network, CASE WHEN count(*) = count(rate) THEN CAST(sum(rate) AS BIGINT) END AS capex, count(*) - count(rate) AS n_unpriced FROM rated GROUP BY 1",
    "parcel_impact": f"WITH {EXPOSURES} SELECT parcel_id, CAST(sum(overlap_m) * 18 AS BIGINT) AS area_m2, CAST(sum(overlap_m) * 18 * {COMPENSATION_PER_M2} AS DECIMAL(20,2)) AS compensation FROM exposures GROUP BY 1",
    "land_rollup": f"""WITH {DECIDED} SELECT scenario, count(*) AS n_parcels, count(DISTINCT owner) + count(*) FILTER (owner IS NULL) AS n_owner_interactions, bool_and(owner IS NOT NULL) AS owners_known,
  CASE WHEN count(*) = count(present_value) THEN CAST(sum(CAST(round(present_value * 100) AS BIGINT)) AS BIGINT) END AS value_cents, CAST(sum(CAST(round(present_value * 100) AS BIGINT)) AS BIGINT) AS known_cents, NOT bool_or(coalesce(unavailable, FALSE)) AS feasible,
  CASE WHEN count(present_value) FILTER (basis = 'QUOTED') > 0 AND count(present_value) FILTER (basis = 'ESTIMATED') > 0 THEN 'MIXED' WHEN count(present_value) FILTER (basis = 'QUOTED') > 0 THEN 'QUOTED' WHEN count(present_value) > 0 THEN 'ESTIMATED' ELSE 'UNKNOWN' END AS basis FROM decided GROUP BY 1""",
    "fallback_land": f"WITH {DECIDED} SELECT scenario, count(*) AS n_parcels, CAST(count(*) * {LAND_FIXED} + sum(overlap_m) * {LAND_PER_M} AS BIGINT) AS cost FROM decided WHERE present_value IS NULL GROUP BY 1",
    "legacy_route_rank": f"WITH {CANDIDATES}, totals AS (SELECT *, round(0.0::DOUBLE + {_ROUTE}, 6) AS total FROM candidates WINDOW c AS (PARTITION BY cohort)) SELECT cohort, candidate_id, total, row_number() OVER (PARTITION BY cohort ORDER BY total, length_m, candidate_id) AS rank FROM totals",
    "unified_rank": f"WITH {UNIFIED} SELECT cohort, candidate_id, unified / 1e12::DOUBLE AS unified, place AS rank FROM placed",
    "group_tradeoffs": f"WITH {UNIFIED}, long AS MATERIALIZED ({_LONG}), own AS (SELECT * FROM long WHERE place = 1), rival AS (SELECT * FROM long WHERE place > 1 QUALIFY row_number() OVER (PARTITION BY cohort, metric_group ORDER BY score DESC, candidate_id) = 1) SELECT own.cohort, own.metric_group, rival.candidate_id AS rival, (rival.score - own.score) / 1e10::DOUBLE AS lead FROM own JOIN rival ON rival.cohort = own.cohort AND rival.metric_group = own.metric_group WHERE rival.score > own.score",
    "metric_deltas": f"WITH {CANDIDATES}, b AS (SELECT * FROM candidates WHERE cost IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY cost, candidate_id) = 1) SELECT c.cohort, c.candidate_id, {_delta('length_m', False)}, {_delta('losses_kw', False)}, {_delta('voltage_margin', True)} FROM candidates c JOIN b ON b.cohort = c.cohort",
    "engineering_best": f"WITH {SCORED} SELECT cohort, arg_min(candidate_id, (-total, length_m, losses_kw, candidate_id)) AS best, arg_min(candidate_id, (cost, -total, length_m, losses_kw, candidate_id)) AS cheapest FROM scored GROUP BY 1",
    "workflow_status": f"WITH {CANDIDATES}, n AS (SELECT cohort, count(*) AS n, count(*) FILTER (converged) AS n_converged, count(*) FILTER (len(reasons) = 0) AS n_eligible FROM judged GROUP BY 1) SELECT *, CASE WHEN n_converged = 0 THEN 'FAILED' WHEN n_eligible = 0 THEN 'NO_FEASIBLE' WHEN n_eligible < n THEN 'PARTIAL' ELSE 'SUCCESS' END AS state FROM n",
}
