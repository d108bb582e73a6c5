"""SQL of the corpus queries that a second engine can express over whole tables."""

from __future__ import annotations

_PLAIN = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _moves() -> str:
    """Rows of (state, initial, next state, cost, edits, lines before, role given): up to two insertions, then one edit."""
    rows = []
    for state, name in enumerate("-sua"):
        at, lines = name, ""
        for inserted in range(3):
            edits, cost = "I" * inserted, 3 * inserted
            other = "user" if at in "-sa" else "assistant"
            keeps = {"-": "su", "s": "u", "u": "a", "a": "u"}[at]
            rows += [(state, k, "-sua".index(k), cost, edits + "K", lines, "") for k in keeps]
            rows += [(state, "*", "-sua".index(other[0]), cost + 3, edits + "R", lines, other), (state, "*", "-sua".index(at), cost + 4, edits + "D", lines, "")]
            at, lines = other[0], f"{lines}|{other}:"
    return ", ".join(str(row) for row in rows)


SQL = {
    "op7_substring_doubling": """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
  firsts AS (SELECT h, min(doc_id) AS lo FROM windows GROUP BY 1),
  removed AS (SELECT DISTINCT doc_id, i + j AS k FROM windows JOIN firsts USING (h), range(0, 50) r(j) WHERE doc_id > lo),
  words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
  kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN removed USING (doc_id, k) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_decontamination": f"""WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents), b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_PLAIN} AS w FROM benchmark),
  tests AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS h FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(13, len(w)) AS size FROM b WHERE len(w) > 0))),
  found AS (SELECT doc_id, i, size, item_id FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS h FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM tests))) JOIN tests USING (size, h)),
  hits AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, size)) AS j FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY 1),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_hirschberg_repair": f"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS crc FROM conversations),
  dealt AS (SELECT *, xor(crc, 4294967295) % 20 AS fate FROM named),
  damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM dealt),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS tail FROM damaged),
  faulty AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, substr(role, 1, 1) AS initial, substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) AS before FROM placed),
  moves(p, initial, q, cost, edits, lines, given) AS (VALUES {_moves()}),
  walk(conv_id, i, q, best) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'cost': 0, 'audit': '', 'lines': ''}} FROM conversations
    UNION ALL
    SELECT w.conv_id, f.i, m.q, min({{'cost': CAST(w.best.cost + m.cost + CASE WHEN f.fault = 'truncated' AND right(m.edits, 1) <> 'D' THEN 3 ELSE 0 END AS INTEGER), 'audit': w.best.audit || m.edits,
        'lines': w.best.lines || translate(m.lines, '|', chr(10)) || CASE right(m.edits, 1) WHEN 'K' THEN chr(10) || f.role || ':' || f.text WHEN 'R' THEN chr(10) || m.given || ':' || f.text ELSE '' END}})
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN moves m ON m.p = w.q AND (m.initial = '*' OR m.initial = f.initial) AND (coalesce(f.fault, '') NOT IN ('blank', 'duplicate') OR right(m.edits, 1) = 'D') GROUP BY ALL),
  sums AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY 1),
  ends AS (SELECT w.conv_id, min({{'cost': w.best.cost + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': w.best.audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END, 'lines': w.best.lines || CASE q WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 2 THEN chr(10) || 'assistant:' ELSE '' END}}) AS best
    FROM walk w LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(s.n, 0) GROUP BY 1)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(e.best.cost AS BIGINT) AS cost, e.best.audit AS audit, sha256(substr(e.best.lines, 2)) AS repaired_sha256
FROM ends e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op12_tree_hard_negatives": """WITH valid AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score FROM valid a JOIN valid r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
  positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3""",
    "op13_suffix_array_dedup": """WITH d AS (SELECT doc_id, row_number() OVER () AS k, encode(coalesce(text, '')) AS b FROM documents),
  windows AS (SELECT k, i, md5(b[i:i + 399]) AS h FROM (SELECT k, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
  again AS (SELECT h FROM windows GROUP BY 1 HAVING count(*) > 1),
  hits AS (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before, lead(i) OVER (PARTITION BY k ORDER BY i) AS after FROM windows JOIN again USING (h)),
  runs AS (SELECT k, i AS low, before + 400 AS gone FROM hits WHERE before IS NULL OR i > before + 400),
  ends AS (SELECT k, i + 400 AS high FROM hits WHERE after IS NULL OR after > i + 400),
  spans AS (SELECT k, low, gone, high FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY low) AS n FROM runs) JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY high) AS n FROM ends) USING (k, n)),
  sums AS (SELECT k, sum(high - low) AS n_removed, count(*) AS n_spans, max(high) AS last, list(low ORDER BY low) AS lows, list(high ORDER BY low) AS highs FROM spans GROUP BY 1)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, coalesce(n_spans, 0) + 1), lambda j: hex(b[CASE j WHEN 0 THEN 1 ELSE highs[j] END:coalesce(lows[j + 1] - 1, octet_length(b))])), ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (k)""",
}
