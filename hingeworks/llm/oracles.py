"""DuckDB SQL of the text queries that SQL can express."""

ORACLES: dict[str, str] = {}

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLES["op11_shared_search"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), {_TERM}) AS terms
  FROM documents),
i AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), {_TERM}) AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT q, item_id, term, count(*) AS repeats
          FROM (SELECT q, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
totals AS (SELECT count(*) AS docs, CAST(coalesce(sum(len(terms)), 0) AS BIGINT) AS words
           FROM d WHERE len(terms) > 0),
posted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM posted GROUP BY term), totals),
sized AS (SELECT r, doc_id, 75 + (25 * len(terms) * docs) // words AS m FROM d, totals WHERE len(terms) > 0),
scored AS (
  SELECT q, item_id, r, doc_id,
         CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN posted USING (term) JOIN weights USING (term) JOIN sized USING (r)
  GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT item_id, doc_id, score,
                  row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS place
           FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 20
"""

ORACLES["op12_url_filter"] = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id, url,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {_UPPER}) AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule_host, rule_path, action) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fitted AS (
  SELECT r, rule_host || rule_path AS rule, action,
         row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
addressed AS (
  SELECT r, url, regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/$', '') AS address FROM parts),
listed AS (
  SELECT address FROM addressed WHERE address <> '' GROUP BY address HAVING min(url) <> max(url))
SELECT p.page_id, p.host, p.path, f.rule,
       CASE WHEN f.rule IS NOT NULL THEN f.action WHEN l.address IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM parts p JOIN addressed a USING (r) LEFT JOIN listed l ON l.address = a.address
LEFT JOIN fitted f ON f.r = p.r AND f.place = 1
"""

ORACLES["op13_fill_in_middle"] = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex
  FROM documents),
drawn AS (
  SELECT *, len(lines) AS n,
         CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4
  FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT doc_id, n, form, text, array_to_string(list_slice(lines, 1, low), '') AS prefix,
         array_to_string(list_slice(lines, low + 1, high), '') AS middle,
         array_to_string(list_slice(lines, high + 1, n), '') AS suffix
  FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

ORACLES["op5_near_duplicates"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE
      WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
           FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
          WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS id, least(a, b) AS low FROM both_ways
            UNION SELECT e.a, r.low FROM reached r JOIN both_ways e ON e.b = r.id),
parts AS (SELECT id, min(low) AS low FROM reached GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id,
       coalesce(low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN parts ON parts.id = d.doc_id
"""
