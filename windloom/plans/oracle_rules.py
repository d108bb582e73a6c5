"""Equivalent SQL of the survey rules."""

from __future__ import annotations

from windloom.operators import survey_rules as rules
from windloom.plans.oracle_network import FEATURES, PARTS, folder_kind, name_kind

SHAPES = """features AS (SELECT p_partkey AS ordinal,
  ['Penna River', 'NH- 42', '133 KV', 'PSS Land = 9 Acres', 'Path Measure 3', 'Untitled Polygon', 'Survey No 143/2', 'Bukkapatnam BT ROAD', 'Sanctuary', 'Sector', 'Plot', 'HT LINE'][CAST(p_partkey % 12 + 1 AS INT)] AS name,
  ['Project / Areas', 'Survey / Village settlement', 'My Places / Land acquisition / Points', 'PCN / Feeder 1', 'EHV', 'B.T.Road', 'Documents', 'Canal / Temporary Places', 'Misc'][CAST(p_partkey // 12 % 9 + 1 AS INT)] AS folder FROM part)"""
SHAPE_PARTS = SHAPES + PARTS.removeprefix(FEATURES)


def _kind(folders: list, names: list) -> str:
    return f"WITH {SHAPE_PARTS}, typed AS (SELECT ordinal, {folder_kind(folders)} AS f, {name_kind("name", names)} AS n FROM parts) SELECT ordinal, coalesce(f, n, 'UNKNOWN') AS kind, CASE WHEN f IS NOT NULL THEN 'FOLDER' WHEN n IS NOT NULL THEN 'NAME' ELSE 'NONE' END AS rule FROM typed"


_ALIAS = " ".join(f"WHEN t IN ({', '.join(repr(a) for a in each)}) THEN '{kind}'" for kind, each in rules.TYPE_ALIASES.items())

SQL = {
    "classify_polygons": _kind(rules.AREA_FOLDERS, rules.AREA_NAMES),
    "classify_lines": _kind(rules.LINE_FOLDERS, rules.LINE_NAMES),
    "folder_status": f"WITH {PARTS} SELECT ordinal, coalesce({folder_kind(rules.STATUS_FOLDERS)}, 'UNKNOWN') AS status FROM parts",
    "constraint_rules": f"""WITH c AS (SELECT p_partkey AS layer, [NULL, 'track', 'ehv_line', 'water', 'land', 'settlement_exclusion', 'tree'][CAST(p_partkey % 7 + 1 AS INT)] AS t,
  [NULL, 'hard', 'soft_penalty', NULL, 'other'][CAST(p_partkey // 7 % 5 + 1 AS INT)] AS m, p_partkey // 35 % 2 = 0 AS linear, p_partkey % 11 = 0 AS no_go FROM part),
k AS (SELECT *, CASE WHEN t IS NULL THEN CASE WHEN linear THEN 'ROAD' ELSE 'RESTRICTED_AREA' END WHEN t = 'water' THEN CASE WHEN linear THEN 'WATERCOURSE' ELSE 'RESTRICTED_AREA' END {_ALIAS} END AS kind FROM c)
SELECT layer, kind, CASE WHEN kind IS NULL THEN NULL WHEN no_go THEN 'HARD' WHEN m IS NULL THEN CASE WHEN linear OR kind <> 'RESTRICTED_AREA' THEN 'SOFT' ELSE 'HARD' END WHEN m = 'hard' THEN 'HARD' WHEN m = 'soft_penalty' THEN 'SOFT' END AS mode FROM k""",
    "asset_key_collapse": f"WITH {FEATURES}, keyed AS (SELECT *, upper(regexp_replace(regexp_replace(external_id, '-[0-9]+$', ''), '[\\s_.-]', '', 'g')) AS key FROM features) SELECT project, key, arg_min(ordinal, (length(external_id), ordinal)) AS kept, count(*) AS n FROM keyed GROUP BY ALL",
    "reclassify_anti": f"WITH {FEATURES}, n AS (SELECT *, regexp_extract(external_id, '[0-9]+$') AS number FROM features) SELECT project, ordinal, number FROM n WHERE NOT starts_with(external_id, 'WTG') AND NOT EXISTS (SELECT 1 FROM n w WHERE w.project = n.project AND w.number = n.number AND starts_with(w.external_id, 'WTG'))",
    "generated_ids": f"WITH {FEATURES}, b AS (SELECT *, CAST(starts_with(external_id, 'Misc') AS INT) AS blank FROM features) SELECT ordinal, CASE WHEN blank = 1 THEN format('WTG-{{:03d}}', CAST(sum(1 - blank) OVER (PARTITION BY project) + sum(blank) OVER (PARTITION BY project ORDER BY ordinal) AS BIGINT)) ELSE external_id END AS asset_id FROM b",
}
