"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) AS place,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM r
"""

#: Lines of ``documents`` after line dedup; the column kept_text.
LINE_DEDUP_CTE = r"""
lines AS (
  SELECT doc_id, i AS pos, parts[i] AS line,
    translate(regexp_replace(parts[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {docs}))
), repeated AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.pos, l.line, r.key IS NOT NULL AND l.doc_id <> r.last AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key
), kept AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text
  FROM marked GROUP BY doc_id
)
"""
LINE_DEDUP = f"WITH {LINE_DEDUP_CTE.format(docs='documents')} SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256 FROM kept"

#: Copies that the mix takes of each row of {docs}.
MIXING_CTE = r"""
sized AS (
  SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM sized GROUP BY source
), bounds AS (
  SELECT *, source_size * 3.0::DOUBLE AS most, source_size * 3.0::DOUBLE / weight AS bound, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM per_source
), levels AS (
  SELECT *, (total - coalesce(sum(most) OVER before, 0)) / (weights - coalesce(sum(weight) OVER before, 0)) AS level
  FROM bounds WINDOW before AS (ORDER BY bound, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(most, weight * (SELECT arg_min(level, bound) FROM levels WHERE level <= bound)) AS target FROM levels
), rated AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
    CAST(concat('0x', substr(md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', coalesce(text, ''))), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), mixed AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rated
)
"""
MIXING = f"WITH {MIXING_CTE.format(docs='documents')} SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM mixed"


SOURCE_AUDIT = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT row_id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3
), langs AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), counted AS (
  SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept USING (lang, term) GROUP BY ALL
), pairs_of AS (
  SELECT DISTINCT lang, source FROM d
), sized AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(c) FROM counted x WHERE x.lang = g.lang AND x.source = g.source), 0) AS n FROM pairs_of g
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000 * CAST(coalesce(c.c, 0) + 1 AS HUGEINT)) // (s.n + l.v) AS BIGINT) AS p,
    CAST(1 + (1000000000 * CAST(k.total + 1 AS HUGEINT)) // (l.n + l.v) AS BIGINT) AS whole
  FROM sized s JOIN kept k ON s.lang = k.lang JOIN langs l ON l.lang = s.lang LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM pairs_of a JOIN pairs_of b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - whole) * (p - whole) // whole FROM shares WHERE c > 0 AND p > whole
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": EXACT_DEDUP, "op6_line_dedup": LINE_DEDUP, "op7_mixing": MIXING, "op13_source_audit": SOURCE_AUDIT}
