"""SQL of the catalogue and settings queries."""

from __future__ import annotations

from windloom.operators.catalogue import CLEARANCE_M, HIGH_UTILISATION, LABELS, PROFILES, SOFT_COST
from windloom.operators.network import KV, POWER_FACTOR
from windloom.plans.oracle import TURBINES

CABLES = """cables AS (SELECT 'CAB-' || s_suppkey AS cable_type_id, s_nationkey AS catalogue, [11, 33, 66][CAST(s_suppkey % 3 + 1 AS INT)] AS kv, 100 + s_suppkey * 37 % 900 AS max_current_a, 800 + s_suppkey % 5 * 50 AS derating_milli,
  1 + s_suppkey % 4 AS parallel_count, s_suppkey % 6 <> 0 AS enabled, ['VERIFIED', 'SEED', 'UNVERIFIED', 'VENDOR'][CAST(s_suppkey % 4 + 1 AS INT)] AS provenance FROM supplier)"""
RATES = "rates AS (SELECT 'CAB-' || (p_partkey % 1000) AS cable_type_id, min(CAST(p_retailprice AS DECIMAL(14,2))) AS rate FROM part WHERE p_size > 20 GROUP BY 1)"
CATALOGUES = """catalogues AS (SELECT *, CAST(try_strptime(text, '%Y-%m-%d') AS DATE) AS date FROM (SELECT n_nationkey AS catalogue, ['INR', 'inr ', 'EUR'][n_nationkey % 3 + 1] AS currency, ['Inr', 'USD'][n_nationkey % 2 + 1] AS land_currency,
  '2024-0' || (n_nationkey % 9 + 1) || '-' || (n_nationkey * 7 % 24 + 10) AS text, n_nationkey % 5 <> 0 AS enabled FROM nation))"""
ITEMS = """items AS (SELECT l_orderkey AS job_id, l_orderkey || '-' || l_linenumber AS segment_id, l_linestatus = 'O' AS is_conductor, 'C' || (l_suppkey % 9) AS item_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  CASE WHEN l_linenumber % 7 <> 0 THEN (l_partkey * 37 + l_linenumber * 1013) % 10007 END AS load, l_partkey AS parcel_id, ['PURCHASE', 'LEASE', 'EASEMENT'][CAST(l_partkey % 3 + 1 AS INT)] AS mode
  FROM lineitem WHERE l_orderkey % 9 <> 0 AND l_linenumber % 2 = l_orderkey % 3 % 2)"""


def _of(i: int) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {p[i]}::DOUBLE" for name, p in PROFILES.items())
    return f"CASE lower(trim(label)) {cases} ELSE {PROFILES['balanced'][i]}::DOUBLE END"


_LABELS = ", ".join(f"('{x}')" for x in LABELS)
_A = "round(max_current_a * derating_milli * parallel_count / 1000.0::DOUBLE, 3)"
_BAD = "count(*) FILTER (provenance IN ('SEED', 'UNVERIFIED'))"
_P = "(kw / 1000.0::DOUBLE)"
_S = f"({_P} / {POWER_FACTOR}::DOUBLE)"
_Q = f"(sqrt({_S} * {_S} - {_P} * {_P}) * CASE turbine_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)"
_W = [f"(n_nationkey * {k} % 7)::DOUBLE" for k in (3, 5, 2, 1)]
_E = f"({_W[1]} + {_W[2]} + {_W[3]})"


def _share(w: str) -> str:
    return f"round(CASE WHEN n_nationkey % 4 <> 0 THEN CASE WHEN {_E} > 0 THEN {w} / {_E} ELSE 0 END ELSE 0.25::DOUBLE END, 9)"


def _group(legacy: str, own: float) -> str:
    return f"CASE WHEN n_nationkey % 4 <> 0 THEN {legacy} ELSE {own}::DOUBLE END"


SQL = {
    "enabled_cables": f"WITH {CABLES} SELECT kv, row_number() OVER (PARTITION BY kv ORDER BY max_current_a, cable_type_id) AS place, cable_type_id, max_current_a FROM cables WHERE enabled",
    "effective_ampacity": f"WITH {CABLES} SELECT cable_type_id, {_A} AS effective_a, round(sqrt(3) * kv * {_A} / 1000 * {POWER_FACTOR}::DOUBLE, 3) AS feeder_mw FROM cables",
    "assigned_cables": f"""WITH {CABLES}, defaults AS (SELECT catalogue, cable_type_id AS default_id FROM cables WHERE enabled QUALIFY row_number() OVER (PARTITION BY catalogue ORDER BY max_current_a, cable_type_id) = 1),
      rows_ AS (SELECT CAST(l_suppkey % 25 AS INT) AS catalogue, CASE WHEN l_suppkey % 4 <> 0 THEN 'CAB-' || (l_suppkey + l_linenumber % 2 * 5000) END AS assigned FROM lineitem)
      SELECT r.catalogue, CASE WHEN c.cable_type_id IS NOT NULL THEN assigned ELSE default_id END AS cable_type_id, count(*) AS n_segments, count(*) FILTER (c.cable_type_id IS NULL) AS n_default
      FROM rows_ r LEFT JOIN cables c ON c.cable_type_id = assigned LEFT JOIN defaults d ON d.catalogue = r.catalogue GROUP BY 1, 2""",
    "offered_unpriced": f"WITH {CABLES}, {RATES} SELECT cable_type_id, catalogue FROM cables WHERE enabled AND cable_type_id NOT IN (SELECT cable_type_id FROM rates)",
    "provenance_summary": f"WITH {CABLES} SELECT catalogue, {_BAD} AS n_unverified, count(*) AS n_types, CASE WHEN {_BAD} = 0 THEN 'all ' || count(*) || ' verified' ELSE {_BAD} || ' of ' || count(*) || ' unverified' END AS summary FROM cables GROUP BY 1",
    "catalogue_scan": f"""WITH {CABLES}, {RATES}, {CATALOGUES}, lists AS (SELECT catalogue, string_agg(cable_type_id || '=' || rate, ' | ' ORDER BY cable_type_id || '=' || rate) AS conductors FROM cables JOIN rates USING (cable_type_id) GROUP BY 1)
      SELECT row_number() OVER (ORDER BY date DESC NULLS LAST, c.catalogue) AS place, c.catalogue, coalesce(conductors, '') AS conductors,
        'angle=' || (500 + c.catalogue) || ' | intermediate=' || (1200 + c.catalogue) || ' | junction=' || (800 + c.catalogue) || ' | terminal=' || (800 + c.catalogue) AS poles FROM catalogues c LEFT JOIN lists l ON l.catalogue = c.catalogue WHERE enabled""",
    "price_dates": f"WITH {CATALOGUES} SELECT catalogue, strftime(date, '%Y/%m/%d') AS price_date, date IS NULL AS is_invalid FROM catalogues",
    "currency_mismatches": f"""WITH {CATALOGUES} SELECT catalogue, concat_ws(',', CASE WHEN lower(trim(currency)) <> 'inr' THEN 'CATALOGUE_CURRENCY' END, CASE WHEN lower(trim(land_currency)) <> 'inr' THEN 'LAND_CURRENCY' END) AS mismatches,
      lower(trim(currency)) = 'inr' AND lower(trim(land_currency)) = 'inr' AS accepted FROM catalogues""",
    "result_costs": f"WITH {ITEMS} SELECT item_id, count(DISTINCT job_id) AS n_jobs, CAST(sum(cents) AS BIGINT) AS cents FROM items WHERE is_conductor GROUP BY 1",
    "result_cables": f"""WITH {ITEMS} SELECT job_id, segment_id, item_id AS cable, pct AS utilisation_pct, coalesce(pct >= {HIGH_UTILISATION}, FALSE) AS is_high
      FROM (SELECT *, CAST(floor(load * 1000000::HUGEINT / 10007 / 100 + 0.5) / 100 AS DECIMAL(10,2)) AS pct FROM items WHERE is_conductor)""",
    "recommended_land": f"WITH {ITEMS} SELECT mode, count(DISTINCT parcel_id) AS n_parcels, count(DISTINCT job_id) AS n_jobs, count(*) AS n_decisions FROM items GROUP BY 1",
    "scenario_settings": f"""SELECT layer, label, CASE kind WHEN 0 THEN coalesce(imported, {SOFT_COST}) * {_of(4)} WHEN 1 THEN coalesce(imported, {SOFT_COST}) * {_of(6)} WHEN 2 THEN {SOFT_COST} * {_of(5)} END AS cost,
      CASE WHEN kind = 3 THEN coalesce(imported, {CLEARANCE_M}) + {_of(7)} END AS clearance_m, {_of(0)} AS length_weight
      FROM (SELECT n_nationkey AS layer, n_nationkey % 4 AS kind, CASE WHEN n_nationkey % 3 <> 0 THEN (n_nationkey + 5)::DOUBLE END AS imported FROM nation), (VALUES {_LABELS}) l(label)""",
    "request_settings": "SELECT n_nationkey AS project, round(greatest(0.001::DOUBLE, 1 - n_nationkey * 0.05::DOUBLE), 6) AS min_pu, round(1 + n_nationkey * 0.05::DOUBLE, 6) AS max_pu, round((100 + n_nationkey * 5)::DOUBLE * 100 / 120, 6) AS target_span_m, round((100 + n_nationkey * 5)::DOUBLE * 30 / 120, 6) AS min_span_m FROM nation",
    "operating_points": f"WITH {TURBINES} SELECT turbine_id, round({_P}, 6) AS p_mw, round({_Q}, 6) AS q_mvar, round(CASE WHEN {_Q} <> 0 THEN sqrt({_P} * {_P} + {_Q} * {_Q}) ELSE {_S} END * 1000 / (sqrt(3) * {KV}::DOUBLE), 4) AS amps FROM turbines",
    "policy_weights": f"""SELECT n_nationkey AS request, CASE WHEN n_nationkey % 4 <> 0 THEN 'LEGACY_COMPATIBILITY' ELSE 'UNIFIED_ENGINEERING' END AS policy, {_group(_W[0], 0.3)} AS physical, {_group('0', 0.3)} AS spatial, {_group(_E, 0.25)} AS electrical,
      {_share(_W[1])} AS loss_share, {_share(_W[2])} AS loading_share, {_share(_W[3])} AS margin_share FROM nation""",
}
