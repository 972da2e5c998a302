"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from roomtide.llm.licenses import BLANK_LINES, TEMPLATES, THRESHOLD, WORD
from roomtide.llm.url_rules import RULES, UNMATCHED


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BIGRAMS = "list_distinct(list_zip(w[:-2], w[2:]))"

#: Windows are made of all lengths for every start; the picked ones are taken one by one.
LICENSES = f"""
WITH RECURSIVE templates(license, body) AS (VALUES
  {", ".join(f"({_literal(name)}, {_literal(body)})" for name, body in TEMPLATES.items())}),
template_words AS (
  SELECT license, regexp_extract_all(lower(body), {_literal(WORD)}) AS w FROM templates),
template_bigrams AS (
  SELECT license, {_BIGRAMS} AS b, len(w) - 1 AS places,
         floor((len(w) - 1) * (2 - {THRESHOLD}::DOUBLE) / {THRESHOLD}::DOUBLE + 1e-9)::BIGINT AS most
  FROM template_words WHERE len(w) > 1),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
blocks AS (
  SELECT doc_id, string_split_regex(text, {_literal(BLANK_LINES)}) AS parts, text FROM documents),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(generate_series(0, len(parts) - 1)) AS unit_no,
         unnest(parts) AS body FROM lines
  UNION ALL
  SELECT * FROM (
    SELECT doc_id, 'block' AS unit, unnest(generate_series(0, len(parts) - 1)) AS unit_no,
           unnest(parts) AS body FROM blocks)
  WHERE contains(body, chr(10))
  UNION ALL
  SELECT doc_id, 'text', 0, text FROM blocks WHERE len(parts) > 1),
unit_words AS (
  SELECT doc_id, unit, unit_no, regexp_extract_all(lower(body), {_literal(WORD)}) AS w FROM units),
unit_bigrams AS (
  SELECT doc_id, unit, unit_no, len(w) AS n_words, {_BIGRAMS} AS b FROM unit_words
  WHERE len(w) > 1),
compared AS (
  SELECT doc_id, unit, unit_no, n_words, license, len(u.b) AS n_bigrams,
         2.0::DOUBLE * len(list_intersect(u.b, t.b)) / (len(u.b) + len(t.b)) AS dice
  FROM unit_bigrams u JOIN template_bigrams t
    ON len(t.b) BETWEEN len(u.b) * 0.66 AND len(u.b) * 1.51),
like_units AS (
  SELECT * FROM compared WHERE dice >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, license) = 1),
texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(lower(text), {_literal(WORD)}) AS w
  FROM documents),
paired AS (
  SELECT r, doc_id, list_zip(w[:-2], w[2:]) AS pairs FROM texts WHERE len(w) > 1),
placed AS (
  SELECT r, unnest(generate_series(1, len(pairs))) AS place, unnest(pairs) AS pair FROM paired),
template_pairs AS (SELECT license, places, most, len(b) AS size, unnest(b) AS pair
  FROM template_bigrams),
starts AS (
  SELECT r, license, place, count(*) OVER (PARTITION BY r, license ORDER BY place
           RANGE BETWEEN CURRENT ROW AND most - 1 FOLLOWING) AS shared,
         size * {THRESHOLD}::DOUBLE / (2 - {THRESHOLD}::DOUBLE) - 1e-9 AS least_shared
  FROM placed JOIN template_pairs USING (pair)),
stretches AS (
  SELECT r, doc_id, license, place, t.b AS b, places, pairs[place:place + most - 1] AS stretch
  FROM starts JOIN paired USING (r) JOIN template_bigrams t USING (license)
  WHERE shared >= least_shared),
lengths AS (
  SELECT r, doc_id, license, place, b, stretch,
         unnest(generate_series(least(places, len(stretch)), len(stretch))) AS length
  FROM stretches),
measured AS (
  SELECT r, doc_id, license, place, length, len(b) AS size,
         len(list_distinct(stretch[:length])) AS n_bigrams,
         len(list_intersect(stretch[:length], b)) AS common
  FROM lengths),
windows AS (
  SELECT r, doc_id, license, place, length, n_bigrams, common,
         2.0::DOUBLE * common / (n_bigrams + size) AS dice
  FROM measured WHERE 2.0::DOUBLE * common / (n_bigrams + size) >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY r, license, place ORDER BY dice DESC, length) = 1),
remaining AS (
  SELECT r, doc_id, list_sort(list({{'fewer': -common, 'minus': -dice, 'first': place - 1,
           'n_words': length + 1, 'license': license, 'n_bigrams': n_bigrams}})) AS rest
  FROM windows GROUP BY r, doc_id
  UNION ALL
  SELECT r, doc_id, list_filter(rest, lambda x: x.first >= rest[1].first + rest[1].n_words
           OR x.first + x.n_words <= rest[1].first)
  FROM remaining WHERE len(rest) > 0),
picked AS (SELECT doc_id, rest[1] AS x FROM remaining WHERE len(rest) > 0)
SELECT doc_id, unit, unit_no::INTEGER AS unit_no, n_words::INTEGER AS n_words, license, dice,
       n_bigrams::INTEGER AS n_bigrams
FROM like_units
UNION ALL
SELECT doc_id, 'window', x.first::INTEGER, x.n_words::INTEGER, x.license, -x.minus,
       x.n_bigrams::INTEGER
FROM picked
"""

URL_RULES = f"""
WITH rules(host, path, verdict) AS (VALUES
  {", ".join(f"({_literal(h)}, {_literal(p)}, {_literal(v)})" for h, p, v in RULES)}),
cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN
           substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
located AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
numbered AS (SELECT row_number() OVER () AS n, * FROM located),
fitting AS (
  SELECT l.n, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY l.n
           ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM numbered l JOIN rules r
    ON (l.host = r.host OR ends_with(l.host, '.' || r.host)) AND starts_with(l.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, {_literal(UNMATCHED)}) AS verdict
FROM numbered l LEFT JOIN (SELECT * FROM fitting WHERE place = 1) f ON l.n = f.n
"""

LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines),
shared AS (
  SELECT line_key, max(doc_id) AS keeper FROM keyed WHERE length(line_key) >= 40
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, s.keeper IS NULL OR s.keeper = k.doc_id AS stays
  FROM keyed k LEFT JOIN shared s ON k.line_key = s.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""

HARD_NEGATIVES = """
WITH finite AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) = len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)])),
rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM finite),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a, rows b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM scored
  WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id,
         s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id
           ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND s.label <> p.anchor_label
    AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 3
"""

INFILL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
numbers AS (
  SELECT doc_id, body, n,
         CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1,
         CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3,
         CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4
  FROM drawn),
cut AS (
  SELECT doc_id, body, n, least(h1 % (n + 1), h2 % (n + 1)) AS a,
         greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>')
                OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (
  SELECT *, substr(body, 1, a) AS prefix, substr(body, a + 1, b - a) AS middle,
         substr(body, b + 1) AS suffix
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END)
         AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""

SQL: dict[str, str] = {
    "op1_licenses": LICENSES,
    "op8_url_rules": URL_RULES,
    "op10_line_dedup": LINE_DEDUP,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_infill": INFILL,
}
