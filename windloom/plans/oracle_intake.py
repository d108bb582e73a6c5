"""SQL of the intake queries."""

from __future__ import annotations

from windloom.operators import intake
from windloom.plans.oracle import CANDIDATES, SEGMENTS, TURBINES
from windloom.plans.oracle_network import FEATURES


def _alias(value: str, names, aliases) -> str:
    known = {n: t for t, spelled in aliases.items() for n in spelled} | {n: n for n in names}
    cases = " ".join(f"WHEN '{n}' THEN '{t}'" for n, t in known.items())
    return f"coalesce(CASE replace(replace(upper(trim({value})), ' ', '_'), '-', '_') {cases} END, 'UNKNOWN')"


def _asset(value: str) -> str:
    return _alias(value, intake.ASSET_TYPES, intake.ASSET_ALIASES)


def _line(value: str) -> str:
    return _alias(value, intake.LINE_TYPES, intake.LINE_ALIASES)


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


NAMED = f"""named AS (SELECT p_partkey AS ordinal, {_list(intake.NAMES)}[CAST(p_partkey % {len(intake.NAMES)} + 1 AS INT)] AS name, {_list(intake.SPELLINGS)}[CAST(p_partkey % {len(intake.SPELLINGS)} + 1 AS INT)] AS spelled,
  ['Site / Canal', 'Site / Towers', 'Wildlife / Areas', NULL][CAST(p_partkey % 4 + 1 AS INT)] AS folder FROM part)"""
_SECTION = "CASE WHEN regexp_matches(trim(name), '^\\d+\\s*/\\s*\\d+(-\\d+)?$') THEN regexp_extract(trim(name), '^(\\d+)\\s*/', 1) END"
_TEXT = "upper(name || ' ' || coalesce(folder, ''))"
_RESTRICTION = "CASE " + " ".join(f"WHEN regexp_matches({_TEXT}, '{'|'.join(words)}') THEN '{kind}'" for kind, words in intake.RESTRICTIONS) + " ELSE 'RESTRICTED' END"
_MOVES = "regexp_matches(trim(name), '^\\d+\\s*/\\s*\\d+(-\\d+)?$|^AP[\\s_-]*\\d+(-\\d+)?$|^GANTRY(-\\d+)?$|^TOWER[\\s_-]*\\d+(-\\d+)?$', 'i')"
_CROSSED = ", ".join(f"'{x}'" for x in intake.CROSSED)
_NUMBER = "try_cast(capacity AS DOUBLE)"
_CELLS = "ceil(w::DOUBLE / {r}) * ceil(h::DOUBLE / {r})"


def _errors(*cases: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {when} THEN '{name}' END" for when, name in cases) + ")"


SQL = {
    "type_aliases": f"WITH {NAMED} SELECT spelled, {_asset('spelled')} AS asset_type, {_line('spelled')} AS line_type, count(*) AS n FROM named GROUP BY 1, 2, 3",
    "name_attributes": f"""WITH {NAMED} SELECT name, folder, CASE WHEN upper(trim(name)) = 'GANTRY' THEN 'GANTRY' WHEN regexp_matches(trim(name), '^AP[\\s_-]*\\d+(-\\d+)?$', 'i') THEN 'ANGLE_POINT' WHEN {_SECTION} IS NOT NULL THEN 'SUSPENSION' END AS tower_type,
      {_SECTION} AS line_section, CASE WHEN regexp_matches(name, '\\d+\\s*kv', 'i') THEN CAST(regexp_extract(name, '(?i)(\\d+)\\s*kv', 1) AS INT) END AS voltage_kv, {_RESTRICTION} AS restriction, count(*) AS n FROM named GROUP BY 1, 2, 3, 4, 5, 6""",
    "optimisable_turbines": f"WITH {TURBINES} SELECT project, count(*) AS n_turbines, CAST(sum(kw) AS BIGINT) AS kw, count(*) <= {intake.MAX_TURBINES} AS accepted FROM turbines WHERE status IN ('APPROVED', 'REGISTRATION', 'PROPOSED') GROUP BY 1",
    "crossing_lines": f"WITH {NAMED} SELECT ordinal, {_line('spelled')} AS line_type FROM named WHERE {_line('spelled')} IN ({_CROSSED})",
    "request_violations": f"""WITH p AS (SELECT c_nationkey AS project, c_custkey AS ordinal, CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 2 = 1 AND c_custkey % 23 = 0 THEN '' ELSE 'T' || (c_custkey % 997) END AS id,
        CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'NaN' WHEN c_custkey % 13 = 0 THEN 'true' WHEN c_custkey % 17 = 0 THEN '-1' WHEN c_custkey % 19 <> 0 THEN CAST(2 + c_custkey % 4 AS VARCHAR) END AS capacity,
        c_custkey * 7919 % 400 - 200 AS lon, c_custkey * 104729 % 200 - 100 AS lat FROM customer), q AS (SELECT *, count(*) OVER (PARTITION BY project, id) AS same FROM p)
      SELECT ordinal, id, {_errors(("coalesce(id, '') = ''", "BLANK_ID"), ("id <> '' AND same > 1", "DUPLICATE_ID"), (f"capacity IS NOT NULL AND ({_NUMBER} IS NULL OR isnan({_NUMBER}) OR {_NUMBER} <= 0)", "CAPACITY"), ("abs(lon) > 180 OR abs(lat) > 90", "COORDINATES"))} AS violations FROM q""",
    "raster_guard": f"""WITH {TURBINES}, box AS (SELECT project, max(x) - min(x) + 2000 AS w, max(y) - min(y) + 2000 AS h FROM turbines GROUP BY 1),
      r AS (SELECT *, CAST(CASE WHEN {_CELLS.format(r=1)} > {intake.MAX_CELLS} THEN ceil(sqrt({_CELLS.format(r=1)} / {intake.MAX_CELLS})) ELSE 1 END AS BIGINT) AS resolution_m FROM box)
      SELECT project, resolution_m, CAST({_CELLS.format(r='resolution_m')} AS BIGINT) AS cells, {_CELLS.format(r='resolution_m')} <= {intake.MAX_CELLS} AS accepted FROM r""",
    "cohort_guard": f"""WITH {CANDIDATES}, e AS (SELECT cohort, count(*) AS n, count(DISTINCT candidate_id % 900) AS ids, count(DISTINCT (length_m, poles)) AS topologies, count(DISTINCT candidate_id % 7 = 0) AS contexts FROM candidates GROUP BY 1)
      SELECT cohort, {_errors(("n > ids", "DUPLICATE_ID"), ("n > topologies", "DUPLICATE_TOPOLOGY"), ("contexts > 1", "MIXED_COHORT"))} AS errors, n - ids AS n_repeated FROM e""",
    "unresolved_sample": f"WITH {NAMED}, u AS (SELECT ordinal FROM named WHERE {_asset('spelled')} = 'UNKNOWN') SELECT (SELECT count(*) FROM u) AS n_unresolved, (SELECT string_agg(CAST(ordinal AS VARCHAR), ', ' ORDER BY ordinal) FROM (SELECT ordinal FROM u ORDER BY ordinal LIMIT 10)) AS sample",
    "overridden_types": f"""WITH {FEATURES}, chosen AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'WTG-' ELSE 'bh ' END || (p_partkey % 400) AS name, ['wec', 'pss', 'nonsense'][CAST(p_partkey % 3 + 1 AS INT)] AS spelled FROM part WHERE p_partkey % 5 = 0),
      exact AS (SELECT name, min(spelled) AS exact FROM chosen GROUP BY 1), loose AS (SELECT regexp_replace(upper(trim(name)), '[\\s_.-]', '', 'g') AS key, min(spelled) AS loose FROM chosen GROUP BY 1),
      j AS (SELECT f.ordinal, exact, {_asset('coalesce(exact, loose)')} AS o FROM features f LEFT JOIN exact ON external_id = name LEFT JOIN loose ON key = regexp_replace(upper(trim(external_id)), '[\\s_.-]', '', 'g'))
      SELECT CASE WHEN o <> 'UNKNOWN' THEN o ELSE 'classified' END AS resolved, exact IS NOT NULL AS is_exact, count(*) AS n, min(ordinal) AS first_ordinal FROM j GROUP BY 1, 2""",
    "moved_towers": f"""WITH {NAMED} SELECT ordinal, CASE WHEN {_MOVES} THEN 'evacuation_towers' ELSE 'wtg_locations' END AS stored_in,
      CASE WHEN NOT {_MOVES} THEN NULL WHEN regexp_matches(trim(name), '^GANTRY(-\\d+)?$', 'i') THEN 'GANTRY' WHEN regexp_matches(trim(name), '^AP[\\s_-]*\\d+(-\\d+)?$', 'i') THEN 'ANGLE_POINT' ELSE 'SUSPENSION' END AS tower_type,
      CASE WHEN {_MOVES} AND regexp_matches(trim(name), '^\\d+\\s*/') THEN regexp_extract(trim(name), '^(\\d+)\\s*/', 1) END AS line_section FROM named""",
    "translated_features": f"""WITH {SEGMENTS} SELECT segment_id, 'FDR-' || coalesce(CAST(feeder AS VARCHAR), 'X') AS "feederName", CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey || '-' || l_linenumber END AS edge,
      CASE WHEN l_linenumber % 3 = 0 THEN length_m END AS traversal_cost FROM segments WHERE l_linenumber % 3 <> 2""",
    "enabled_admins": "SELECT c_nationkey AS tenant, count(*) FILTER (c_custkey % 7 = 0 AND c_acctbal > 0) AS n_admins, count(*) FILTER (c_custkey % 7 = 0 AND c_acctbal > 0) > 1 AS may_disable FROM customer GROUP BY 1",
    "constraint_union": f"WITH {NAMED} SELECT 'line-' || ordinal AS layer_id, 'soft' AS mode FROM named WHERE {_line('spelled')} IN ({_CROSSED}) UNION ALL SELECT 'parcel-' || s_suppkey, 'soft' FROM supplier UNION ALL SELECT 'restricted-' || n_nationkey, 'hard' FROM nation",
    "layer_ids": """WITH r AS (SELECT o_orderkey AS feature, trim(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'c' || (o_orderkey % 5000) END, CASE WHEN o_orderkey % 4 = 0 THEN ' l' || o_orderkey END, CASE WHEN o_orderkey % 5 = 0 THEN ' ' END,
        'constraint-' || left(sha256('order|' || o_orderkey || '|' || o_orderpriority), 16))) AS layer_id FROM orders)
      SELECT feature, layer_id, CASE WHEN layer_id = '' THEN 'EMPTY_ID' WHEN count(*) OVER (PARTITION BY layer_id) > 1 THEN 'DUPLICATE_ID' END AS error FROM r""",
    "same_point_collapse": """WITH r AS (SELECT c_nationkey AS project, 'WTG ' || (c_custkey % 40) || CASE WHEN c_custkey % 3 = 0 THEN '-' || (c_custkey % 9) ELSE '' END AS external_id, c_custkey % 4 AS x, c_custkey % 3 AS y, c_custkey AS row_id FROM customer),
      k AS (SELECT *, upper(regexp_replace(regexp_replace(external_id, '-\\d+$', ''), '[\\s_.-]', '', 'g')) AS key FROM r)
      SELECT project, key, x, y, external_id, row_id FROM k QUALIFY row_number() OVER (PARTITION BY project, key, x, y ORDER BY length(external_id), external_id, row_id) = 1""",
}
