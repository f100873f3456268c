"""Registered query: phrase collocations of each language."""

from __future__ import annotations

from tracewell.llm.phrases import collocations
from tracewell.llm.registry import query, table

SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws, i, unnest([1, 2, 3, 4, 5]) AS size FROM s),
f AS (
  SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM g WHERE i + size - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
cuts AS (
  SELECT k.lang, k.phrase, k.k, k.f AS a, x.f AS l, y.f AS r, t.n,
    (1000 * k.f::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM k JOIN t ON t.lang = k.lang
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1:k.size], ' ')),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
lengths AS (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2),
places AS (SELECT *, unnest(range(1, size - m + 2)) AS i FROM lengths),
inner_ AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS most FROM places GROUP BY ALL),
kept AS (
  SELECT worst.* FROM worst LEFT JOIN inner_ USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
  score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


@query("op11_phrases", SQL)
def op11_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
