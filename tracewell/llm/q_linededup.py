"""Registered query: line deduplication."""

from __future__ import annotations

from tracewell.llm.linededup import dedup_lines
from tracewell.llm.registry import query, table

SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, n, t[n] AS raw, trim(t[n], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line,
    len(regexp_extract_all(t[n], '[^\x20\x09-\x0D]+')) AS w
  FROM split, unnest(range(1, len(t) + 1)) u(n)),
upto AS (
  SELECT *, row_number() OVER o AS i, CAST(sum(w) OVER o AS BIGINT) AS a,
    CAST(sum(w) OVER o AS BIGINT) - w AS b
  FROM lines WHERE w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
runs AS (
  SELECT 0 AS way, doc_id, i AS pos, n AS first_line, max(n) OVER f AS last_line,
    string_agg(line, chr(10)) OVER f AS content, sum(w) OVER f AS words
  FROM upto WINDOW f AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT 1, doc_id, min(i) OVER g, min(n) OVER g, n, string_agg(line, chr(10)) OVER g, sum(w) OVER g
  FROM upto WINDOW g AS (PARTITION BY doc_id ORDER BY a RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
later AS (
  SELECT * FROM runs WHERE words >= 50
  QUALIFY row_number() OVER (PARTITION BY way, content ORDER BY doc_id, pos) > 1),
gone AS (
  SELECT DISTINCT l.doc_id, l.n FROM lines l JOIN later r
    ON l.doc_id = r.doc_id AND l.n BETWEEN r.first_line AND r.last_line),
marked AS (
  SELECT l.*, w > 0 AS worded, w > 0 AND g.n IS NOT NULL AS out
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n),
around AS (
  SELECT *, CASE WHEN worded THEN out ELSE
    coalesce(last_value(CASE WHEN worded THEN out END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
    AND coalesce(first_value(CASE WHEN worded THEN out END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) END AS goes
  FROM marked),
kept AS (
  SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (NOT goes), '') AS text,
    count(*) FILTER (goes) AS lines_removed
  FROM around GROUP BY doc_id)
SELECT doc_id, k.text, coalesce(lines_removed, 0) AS lines_removed
FROM documents LEFT JOIN kept k USING (doc_id)
"""


@query("op6_line_dedup", SQL)
def op6_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "text", "lines_removed")
