"""Registered query: web archives, written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm.registry import query, table
from tracewell.llm.warc import archive_round_trip

SQL = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
g AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) ELSE page_id END AS first
  FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to,
  '' AS problem
FROM g
"""


@query("op2_warc_round_trip", SQL)
def op2_warc_round_trip(spark, sf_dir):
    out = archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.drop("segments").withColumn("problem", F.coalesce("problem", F.lit("")))
