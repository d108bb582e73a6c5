"""SQL of the scoring queries; money by whole numbers and an explicit half-to-even rule."""

from __future__ import annotations

from windloom.operators.decide import HOURS, LAND_FIXED, PRICE_MWH
from windloom.operators.scoring import ENGINEERING, FACTOR, GROUPS, ROUTE, SCALE
from windloom.plans.oracle import CANDIDATES, TURBINES

MEASURED = CANDIDATES + ", measured AS (SELECT *, length_m * 3 + candidate_id * 71 % 5000 AS traversal, candidate_id * 37 % 400 AS overlap_m, candidate_id * 11 % 7 AS owners, 40 + candidate_id * 53 % 60 AS loading FROM candidates)"
_GOOD = "converged AND violations = 0 AND NOT hard_violation"


def _share(m: str) -> str:
    return f"CAST(CASE WHEN max({m}) OVER c > min({m}) OVER c THEN round(({m} - min({m}) OVER c)::DOUBLE / (max({m}) OVER c - min({m}) OVER c) * {SCALE}) ELSE 0 END AS BIGINT)"


def _best(m: str) -> str:
    return _share(m) if ENGINEERING[m][2] else f"CASE WHEN max({m}) OVER c > min({m}) OVER c THEN {SCALE} - {_share(m)} ELSE 0 END"


_GROUPS = ", ".join("CAST(" + " + ".join(f"({_best(m)}) * {w}" for m, (of, w, _) in ENGINEERING.items() if of == g) + f" AS BIGINT) AS g_{g}" for g in GROUPS)
_TOTAL = " + ".join(f"g_{g} * {w}" for g, w in GROUPS.items())
_NAMES = ", ".join(f"g_{g}" for g in GROUPS)
_NULLS = ", ".join(["CAST(NULL AS BIGINT)"] * (len(GROUPS) + 1))


def _cents(numerator: str, divisor: int) -> str:
    """numerator / divisor in hundredths, half to even, as a decimal of two digits."""
    n = f"CAST({numerator} AS HUGEINT)"
    return f"CAST(CAST(CASE WHEN {n} % {divisor} * 2 > {divisor} OR ({n} % {divisor} * 2 = {divisor} AND {n} // {divisor} % 2 = 1) THEN {n} // {divisor} + 1 ELSE {n} // {divisor} END AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2))"


_LOSS = "CASE WHEN candidate_id % 47 = 0 THEN NULL WHEN candidate_id % 53 = 0 THEN -losses_kw ELSE losses_kw END"
OPEX = f"""{CANDIDATES}, states AS (SELECT *, CASE WHEN NOT converged THEN 'NOT_CONVERGED' WHEN ({_LOSS}) IS NULL THEN 'LOSS_MISSING' WHEN ({_LOSS}) < 0 THEN 'LOSS_NEGATIVE' ELSE 'OK' END AS state FROM candidates),
  opex AS (SELECT candidate_id, state, CASE WHEN state = 'OK' THEN CAST(CAST(losses_kw * {HOURS * 35} AS DECIMAL(20,5)) / 100000 AS DECIMAL(20,5)) END AS mwh, CASE WHEN state = 'OK' THEN {_cents(f'losses_kw * {HOURS * 35 * PRICE_MWH}', 1000)} END AS cost_per_year,
    CASE WHEN state = 'OK' THEN {_cents(f'CAST(losses_kw AS HUGEINT) * {HOURS * 35 * PRICE_MWH} * {FACTOR}', 10**9)} END AS present_value FROM states)"""
LIFE = f"""{OPEX}, life AS (SELECT c.cohort, c.candidate_id, c.cost AS capex, present_value AS opex, CASE WHEN parcels < 8 THEN CAST(parcels * {LAND_FIXED} AS DECIMAL(20,2)) END AS land,
    CAST(c.cost + present_value + CASE WHEN parcels < 8 THEN CAST(parcels * {LAND_FIXED} AS DECIMAL(20,2)) END AS DECIMAL(20,2)) AS lifecycle_cost FROM candidates c JOIN opex USING (candidate_id))"""

SQL = {
    "unified_scoring": f"""WITH {MEASURED}, g AS (SELECT *, {_GROUPS} FROM measured WHERE {_GOOD} WINDOW c AS (PARTITION BY cohort)), t AS (SELECT *, {_TOTAL} AS total FROM g)
      SELECT cohort, candidate_id, {_NAMES}, total, row_number() OVER (PARTITION BY cohort ORDER BY total DESC, g_electrical DESC, g_spatial DESC, g_infra DESC, length_m, losses_kw, candidate_id) AS rank FROM t
      UNION ALL SELECT cohort, candidate_id, {_NULLS}, NULL FROM measured WHERE NOT ({_GOOD})""",
    "route_scoring": f"""WITH {MEASURED}, t AS (SELECT *, CAST({" + ".join(f"{_share(m)} * {w}" for m, w in ROUTE.items())} AS BIGINT) AS total FROM measured WHERE NOT hard_violation WINDOW c AS (PARTITION BY cohort))
      SELECT cohort, candidate_id, total, row_number() OVER (PARTITION BY cohort ORDER BY total, length_m, candidate_id) AS rank, CAST(NULL AS VARCHAR) AS reason FROM t UNION ALL SELECT cohort, candidate_id, NULL, NULL, 'HARD_CONSTRAINT' FROM measured WHERE hard_violation""",
    "opex_states": f"WITH {OPEX} SELECT * FROM opex",
    "lifecycle_costs": f"WITH {LIFE} SELECT * FROM life",
    "cost_context": f"""WITH {LIFE}, n AS (SELECT cohort, count(DISTINCT candidate_id % 400 = 0) AS n_contexts FROM life GROUP BY 1)
      SELECT * FROM (SELECT cohort, candidate_id, concat_ws(',', CASE WHEN lifecycle_cost IS NULL THEN 'INCOMPLETE_LIFECYCLE_COST' END, CASE WHEN n_contexts > 1 THEN 'ECONOMIC_CONTEXT_MISMATCH' END) AS reasons FROM life JOIN n USING (cohort)) WHERE reasons <> ''""",
    "mutation_features": f"""WITH {TURBINES}, moves AS (SELECT t.project, t.feeder AS "from", t.feeder + 1 AS "to", t.turbine_id, t.x AS mx, t.y AS my, t.kw AS mkw FROM turbines t
        WHERE t.k = (SELECT max(k) FROM turbines o WHERE o.project = t.project AND o.feeder = t.feeder) AND EXISTS (SELECT 1 FROM turbines o WHERE o.project = t.project AND o.feeder = t.feeder + 1)),
      after AS (SELECT m.project, m."from" AS move, 'from' AS side, t.x, t.y, t.kw FROM moves m JOIN turbines t ON t.project = m.project AND t.feeder = m."from" AND t.turbine_id <> m.turbine_id
        UNION ALL SELECT m.project, m."from", 'to', t.x, t.y, t.kw FROM moves m JOIN turbines t ON t.project = m.project AND t.feeder = m."to" UNION ALL SELECT project, "from", 'to', mx, my, mkw FROM moves),
      centre AS (SELECT project, move, side, avg(x) AS cx, avg(y) AS cy, sum(kw) AS side_kw FROM after GROUP BY 1, 2, 3),
      spread AS (SELECT a.project, a.move, a.side, CAST(round(coalesce(stddev_samp(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 0) * 1000) AS BIGINT) AS spread, any_value(side_kw) AS side_kw FROM after a JOIN centre c ON c.project = a.project AND c.move = a.move AND c.side = a.side GROUP BY 1, 2, 3),
      sides AS (SELECT project, move, CAST(sum(spread) AS BIGINT) AS spread_mm, CAST(sum(CASE WHEN side = 'to' THEN side_kw ELSE -side_kw END) AS BIGINT) AS kw_difference FROM spread GROUP BY 1, 2)
      SELECT m.project, m."from" AS feeder, 'reassign' AS mutation, any_value(m.turbine_id) AS turbine_id, any_value(mkw) AS kw, min((mx - x) * (mx - x) + (my - y) * (my - y)) AS link_sq, any_value(spread_mm) AS spread_mm, any_value(kw_difference) AS kw_difference
      FROM moves m JOIN turbines t ON t.project = m.project AND t.feeder = m."to" JOIN sides s ON s.project = m.project AND s.move = m."from" GROUP BY 1, 2""",
}
