"""Registered query: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm.mixing import mix, one_by_one
from tracewell.llm.registry import query, table
from tracewell.llm.words import word_count

SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
units AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS repeat FROM sized),
sizes AS (SELECT source, sum(size) AS source_size FROM units GROUP BY source),
placed AS (
  SELECT *, row_number() OVER w AS place,
    sum(source_size) OVER w - source_size AS start,
    CASE (row_number() OVER w - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes WINDOW w AS (ORDER BY source NULLS LAST)),
shared AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget,
    sum(2 * source_size) OVER u - 2 * source_size AS filled,
    sum(weight) OVER () - (sum(weight) OVER u - weight) AS still
  FROM placed WINDOW u AS (ORDER BY source_size::DOUBLE / weight, place)),
rate AS (
  SELECT max((budget - CAST(filled AS DOUBLE)) / CAST(still AS DOUBLE)) AS per_weight FROM shared),
targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, place, start,
    least(weight * per_weight, CAST(2 * source_size AS DOUBLE)) AS target FROM shared, rate),
served AS (
  SELECT u.*, t.* EXCLUDE (source), size AS words, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    sum(size) OVER (PARTITION BY place ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')),
      doc_id NULLS FIRST, size, repeat) AS until
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CAST(round * source_size + until AS DOUBLE) / target AS finish
  FROM served, (VALUES (0), (1)) r(round) WHERE words > 0),
queue AS (
  SELECT *, sum(words) OVER (ORDER BY finish, place, round, key, doc_id NULLS FIRST, size, repeat) AS total
  FROM copies),
taken AS (
  SELECT doc_id, place, size, repeat, count(*) AS copies FROM queue
  WHERE CAST(total AS DOUBLE) <= (SELECT sum(target) FROM targets) GROUP BY ALL)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, s.source_size, s.target,
  CAST(s.size * coalesce(copies, 0) AS BIGINT) AS taken
FROM served s LEFT JOIN taken t ON s.doc_id IS NOT DISTINCT FROM t.doc_id AND s.place = t.place
  AND s.size = t.size AND s.repeat = t.repeat
"""


@query("op10_source_mix", SQL)
def op10_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = mix(docs, "doc_id", "source", word_count(F.col("text")))
    return one_by_one(out).select("doc_id", "size", "source_size", "target", "taken")
