"""Registered query: clusters of the embeddings."""

from __future__ import annotations

from tracewell.llm.clusters import CLUSTERS, LARGEST, ROUNDS, cluster_vectors
from tracewell.llm.registry import query, table


def _nearest(k: int) -> str:
    """SQL of the nearest centroid of each vector after ``k`` rounds."""
    return f"""
  a{k} AS MATERIALIZED (
    SELECT row, vec_id, v, arg_min(c, d * {CLUSTERS} + c) AS c, min(d) AS d FROM (
      SELECT v.row, v.vec_id, v.v, c{k}.c,
        list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c{k}.v[i]) * (v.v[i] - c{k}.v[i])))::BIGINT AS d
      FROM v CROSS JOIN c{k}) GROUP BY row, vec_id, v)"""


def _moved(k: int) -> str:
    """SQL of the centroids after round ``k``."""
    return f"""
  m{k} AS MATERIALIZED (
    SELECT c, list(s ORDER BY i) AS v FROM (
      SELECT c, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS s FROM (
        SELECT c, v, unnest(range(1, 65)) AS i FROM a{k - 1}) GROUP BY c, i) GROUP BY c),
  c{k} AS MATERIALIZED (
    SELECT c{k - 1}.c, coalesce(m{k}.v, c{k - 1}.v) AS v FROM c{k - 1} LEFT JOIN m{k} ON m{k}.c = c{k - 1}.c)"""


SQL = f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding::DOUBLE[], lambda x:
      greatest(-{LARGEST}, least({LARGEST}, floor(256 * x)))::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
  c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM v
    QUALIFY c < {CLUSTERS}),{_nearest(0)},
  {",".join(_moved(k) + "," + _nearest(k) for k in range(1, ROUNDS + 1))}
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)
"""


@query("op12_clusters", SQL)
def op12_clusters(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
