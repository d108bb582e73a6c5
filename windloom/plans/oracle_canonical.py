"""Equivalent SQL of the fingerprints: the canonical texts are written out, keys in order."""

from __future__ import annotations

from windloom.operators.canonical import CONTEXTS, NO_LAND
from windloom.operators.decide import DISCOUNT, HOURS, PRICE_MWH, YEARS
from windloom.plans.oracle_routing import EDGES

_OPTIONS = """'[{"mode":"EASEMENT","price_date":null,"upfront":' || (k * 7 % 900) || '},{"mode":"PURCHASE","price_date":null,"upfront":' || (k * 31 % 900) || '}]'"""
_MEMBERS = f"""members AS (
    SELECT project, 'topology' AS context, '{{"edges":[' || string_agg(format('"{{:03d}}:{{:03d}}"', node // 2, node), ',' ORDER BY format('{{:03d}}:{{:03d}}', node // 2, node)) || '],"wtgs":[' || string_agg(node::VARCHAR, ',' ORDER BY node) || ']}}' AS text FROM edges GROUP BY project, feeder
    UNION ALL SELECT project, 'electrical', '{{"active_kw":' || kw || ',"node":' || turbine_id || '}}' FROM turbines
    UNION ALL SELECT s_nationkey, 'electrical', '{{"cable":"CAB-' || s_suppkey || '","derating":' || rtrim(rtrim(((800 + s_suppkey % 5 * 50) / 1000)::DECIMAL(9,3)::VARCHAR, '0'), '.') || ',"max_current_a":' || (100 + s_suppkey * 37 % 900) || ',"parallel":' || (1 + s_suppkey % 4) || '}}' FROM supplier
    UNION ALL SELECT project, 'evaluation', '{{"route":[[' || x1 || ',' || y1 || '],[' || x2 || ',' || y2 || ']],"segment":"' || feeder || '-' || node || '"}}' FROM edges
    UNION ALL SELECT n_nationkey, 'economic', '{{"catalogue_id":"' || n_name || '","currency":"' || upper(trim(['INR', 'inr ', 'EUR'][n_nationkey % 3 + 1])) || '","discount":"{DISCOUNT}","hours":{HOURS},"price":"{PRICE_MWH}","price_date":"2024-0' || (n_nationkey % 9 + 1) || '-' || (n_nationkey * 7 % 24 + 10) || '","years":{YEARS}}}' FROM nation
    UNION ALL SELECT project, 'land_routing', '{{"parcel":' || k || '}}' FROM land WHERE k % 6 = 0
    UNION ALL SELECT project, 'land_economic', '{{"availability":"' || CASE WHEN k % 6 = 0 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END || '","options":' || {_OPTIONS} || ',"owner":' || CASE WHEN k % 5 <> 0 THEN '"' || ['A', 'B', 'C'][k % 3 + 1] || '"' ELSE 'null' END || ',"parcel":' || k || '}}' FROM land)"""
_EACH = ", ".join(f"max(fingerprint) FILTER (context = '{c}') AS {c}" for c in CONTEXTS)
_OR_NONE = ", ".join(f"""coalesce({c}, sha256('"{NO_LAND[c]}"')) AS {c}""" if c in NO_LAND else c for c in CONTEXTS)
_STATE = " || ',' || ".join(f"""'"{c}":' || coalesce('"' || {c} || '"', 'null')""" for c in sorted(CONTEXTS))

SQL = {
    "context_fingerprints": f"""WITH {EDGES}, land AS (SELECT s_nationkey AS project, s_suppkey AS k FROM supplier WHERE s_suppkey % 4 = 0), {_MEMBERS},
  sets AS (SELECT project, context, sha256(string_agg(sha256(text), ',' ORDER BY sha256(text))) AS fingerprint FROM members GROUP BY 1, 2),
  named AS (SELECT project, {_EACH} FROM sets GROUP BY 1), filled AS (SELECT project, {_OR_NONE} FROM named)
SELECT *, sha256('{{' || {_STATE} || '}}') AS state FROM filled""",
    "canonical_layer_ids": """WITH r AS (SELECT o_orderkey AS k, o_orderpriority AS mode FROM orders),
  t AS (SELECT k, '{"geometry":{"coordinates":[' || (k % 40) || ',5.5],"type":"Point"},"properties":{' || concat_ws(',', CASE WHEN k % 9 = 0 THEN '"constraint_id":null' WHEN k % 3 = 0 THEN '"constraint_id":"c' || (k % 5000) || '"' END, CASE WHEN k % 5 = 0 THEN '"id":" "' END, CASE WHEN k % 4 = 0 THEN '"layer_id":" l' || k || '"' END, '"mode":"' || mode || '"') || '},"type":"Feature"}' AS text FROM r),
  n AS (SELECT k AS feature, CASE WHEN k % 31 <> 0 THEN trim(coalesce(CASE WHEN k % 9 = 0 THEN NULL WHEN k % 3 = 0 THEN 'c' || (k % 5000) WHEN k % 4 = 0 THEN ' l' || k WHEN k % 5 = 0 THEN ' ' END, 'constraint-' || substr(sha256(text), 1, 16))) END AS layer_id FROM t)
SELECT feature, layer_id, CASE WHEN layer_id IS NULL THEN 'MALFORMED' WHEN layer_id = '' THEN 'EMPTY_ID' WHEN count(*) OVER (PARTITION BY layer_id) > 1 THEN 'DUPLICATE_ID' END AS error FROM n""",
}
