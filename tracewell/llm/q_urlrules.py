"""Registered query: URL filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.llm.registry import query, table
from tracewell.llm.urlrules import judge_urls

RULES = [("org", "/", False), ("example.org", "/es/", True), ("example.org", "/en/1", True),
         ("com", "/fr/", False), ("com", "/de/", True)]

SQL = r"""
WITH parts AS (
  SELECT row_number() OVER () AS n, page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
      ELSE '' END AS path
  FROM pages),
rules(r_host, r_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host))
  AND starts_with(path, r_path)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC NULLS LAST) = 1
"""


@query("op9_url_rules", SQL)
def op9_url_rules(spark, sf_dir):
    rules = None
    for host, path, block in RULES:
        one = spark.range(1).select(F.lit(host).alias("host"), F.lit(path).alias("path"),
                                    F.lit(block).alias("block"))
        rules = one if rules is None else rules.unionByName(one)
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("row.page_id", "host", "path", "rule", "verdict")
