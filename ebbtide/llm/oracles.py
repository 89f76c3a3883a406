"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op5_nearest"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e,
         row_number() OVER () AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.r AS query, c.vec_id AS vec_id,
         list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1),
                                 lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r
)
SELECT query_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INTEGER
         AS rank, vec_id, score
FROM scored
QUALIFY rank <= 20
"""

ORACLES["op11_filter_audit"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), flags AS (
  SELECT doc_id, part, (len(w) < 100)::INT AS a,
         (100 * len(list_distinct(w)) < 80 * len(w))::INT AS b,
         (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e
  FROM texts
), known AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
  FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS m, count(*) AS n,
         sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM flags LEFT JOIN known USING (doc_id) GROUP BY ALL
), letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order,
         [v.l, w.l, x.l, y.l, z.l] AS ls, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM letters v, letters w, letters x, letters y, letters z
  WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31
), steps AS (
  SELECT filter_order, s AS step, ls[s] AS letter, bits[s] AS f,
         coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before
  FROM orders, range(1, 6) r(s)
), found AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (m & (before | f) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (m & f > 0 AND m & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (m & f > 0 AND m & before > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (m = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (m & f > 0 AND m & before = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (m & f > 0 AND m & before = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM found
"""
