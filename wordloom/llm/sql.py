"""SQL for DuckDB, by plain definitions, of the corpus operators that SQL can express; doc_id is taken for unique."""

from __future__ import annotations

SUBSTRING_DEDUP = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM texts)),
firsts AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM windows JOIN firsts USING (h), range(50) AS r(k) WHERE doc_id > m),
placed AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM texts),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY pos) AS t FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT texts.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept ON texts.doc_id = kept.doc_id
"""

def _any_case(pattern: str) -> str:
    """A-Z and a-z alike, and no other letters (a fold of DuckDB's goes beyond ASCII)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


SECRET_SCAN = r"""
WITH texts AS (SELECT row_number() OVER () AS nr, doc_id, source, coalesce(text, '') AS t FROM documents),
kinds AS (SELECT * FROM (VALUES
  ('assign', 0, 6, '(KEYWORDS)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 20, '(AKIA[A-Z0-9]+)'), ('hex', 2, 24, '([0-9a-f]+)'), ('generic', 3, 24, '([A-Za-z0-9+/_=-]{24,})')) AS k(kind, nth, least, pattern)),
cut AS (
  SELECT nr, kind, nth, least, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern, 0) AS found,
    CASE WHEN kind = 'assign' THEN regexp_extract_all(t, pattern, 2) ELSE regexp_extract_all(t, pattern, 1) END AS vals
  FROM texts, kinds),
placed AS (SELECT nr, kind, nth, least, unnest(gaps[1 : len(found)]) AS gap, unnest(found) AS f, unnest(vals) AS v, generate_subscripts(found, 1) AS i FROM cut),
ended AS (SELECT *, sum(length(gap) + length(f)) OVER (PARTITION BY nr, kind ORDER BY i) AS e FROM placed),
spans AS (SELECT nr, kind, nth, (e - length(f))::BIGINT AS s, e::BIGINT AS e, v FROM ended WHERE length(v) >= least),
held AS (
  SELECT v, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos, count(DISTINCT CASE WHEN source IS NULL THEN coalesce(doc_id::VARCHAR, md5(t)) END) AS unowned
  FROM spans JOIN texts USING (nr) GROUP BY v),
judged AS (
  SELECT spans.*, owners, repos, owners >= 3 OR repos >= 10 AS copied,
    NOT copied AND owners + unowned < 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 9 AS live
  FROM spans JOIN held USING (v)),
base AS (SELECT * FROM judged WHERE kind <> 'generic'),
kept AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM judged AS g WHERE kind = 'generic' AND live AND NOT EXISTS (SELECT 1 FROM base AS b WHERE b.nr = g.nr AND b.s < g.e AND g.s < b.e)),
told AS (
  SELECT nr, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) FILTER (kind <> 'generic') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) AS spans, count(DISTINCT v) FILTER (live) AS n_live, count(DISTINCT v) FILTER (copied) AS n_copied,
    max(owners) AS most_owners, max(repos) AS most_repos
  FROM kept GROUP BY nr)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM texts LEFT JOIN told USING (nr)
""".replace("KEYWORDS", _any_case("password|passwd|secret|token|api_?key"))

LINE_DEDUP = r"""
WITH texts AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
placed AS (SELECT doc_id, generate_subscripts(ls, 1) AS place, unnest(ls) AS line FROM texts WHERE doc_id IS NOT NULL),
lines AS (SELECT doc_id, place, regexp_extract_all(line, '[^\x20\x09\x0B-\x0D]+') AS ws FROM placed),
worded AS (SELECT doc_id, place, array_to_string(ws, ' ') AS line, ws FROM lines WHERE len(ws) > 0),
firsts AS (SELECT line, min({'doc_id': doc_id, 'place': place}) AS f, any_value(ws) AS ws FROM worded GROUP BY line),
halves AS (
  SELECT line, f, ws, unnest([md5('0 ' || n || ' ' || array_to_string(ws[1 : n // 2], ' ')), md5('1 ' || n || ' ' || array_to_string(ws[len(ws) - n + n // 2 + 1 :], ' '))]) AS half
  FROM (SELECT *, unnest([len(ws), len(ws) - 1]) AS n FROM firsts WHERE len(ws) >= 4)),
likely AS (SELECT DISTINCT line, f, ws FROM halves WHERE half IN (SELECT half FROM halves GROUP BY half HAVING count(DISTINCT line) > 1)),
variants AS (SELECT line, f, i, md5(array_to_string(ws[1 : i - 1] || ws[i + 1 :], ' ')) AS v FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM likely)),
same AS (SELECT i, v, min(f) AS m FROM variants GROUP BY i, v),
wholes AS (SELECT line, f, md5(line) AS v FROM likely),
near AS (
  SELECT line FROM variants JOIN same USING (i, v) WHERE m < f
  UNION SELECT variants.line FROM variants JOIN wholes USING (v) WHERE wholes.f < variants.f
  UNION SELECT wholes.line FROM wholes JOIN variants USING (v) WHERE variants.f < wholes.f),
gone AS (
  SELECT doc_id, place, {'doc_id': doc_id, 'place': place} <> f AS exact FROM worded JOIN firsts USING (line)
  WHERE {'doc_id': doc_id, 'place': place} <> f OR line IN (SELECT line FROM near)),
counts AS (SELECT doc_id, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact) AS n_near FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS t FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT texts.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near,
  sha256(CASE WHEN texts.doc_id IS NULL THEN coalesce(text, '') ELSE coalesce(t, '') END) AS kept_sha256
FROM texts LEFT JOIN counts ON texts.doc_id = counts.doc_id LEFT JOIN kept ON texts.doc_id = kept.doc_id
"""

JACCARD_JOIN = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM texts WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM shingles GROUP BY doc_id),
nodes AS (SELECT h, min(doc_id) AS node, any_value(n) AS n FROM sizes GROUP BY h),
held AS (SELECT node, n, s FROM shingles JOIN nodes ON doc_id = node),
common AS (SELECT a.node AS a, b.node AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS shared FROM held AS a JOIN held AS b ON a.s = b.s AND a.node <> b.node GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * shared >= 90 * (total - shared)),
reached AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT a AS node, min(b) AS component_id FROM reached GROUP BY a)
SELECT texts.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, coalesce(component_id, texts.doc_id)::BIGINT AS component_id
FROM texts LEFT JOIN sizes ON texts.doc_id = sizes.doc_id LEFT JOIN nodes USING (h) LEFT JOIN least USING (node)
"""

SQL = {"op4_substring_dedup": SUBSTRING_DEDUP, "op5_secret_scan": SECRET_SCAN, "op7_line_dedup": LINE_DEDUP, "op10_jaccard_join": JACCARD_JOIN}
