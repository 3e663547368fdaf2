"""DuckDB SQL for the queries that SQL can express: whole tables, all rows.

Fingerprints, fitted models, merges, images and slots have none; tests hold them against
brute force.
"""

from __future__ import annotations

from .common import LOWER, UPPER
from .linededup import LEAST_CHARS, LEAST_DOCS
from .mixing import MOST, SEED

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':{SEED}') AS digest
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT source, source_size, n, ((k - 1) % 3 + 1)::DOUBLE AS weight, source_size * {float(MOST)}::DOUBLE AS cap FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         sum(source_size) OVER () AS total
  FROM w
), c AS (
  SELECT arg_min((total - before) / rest, ratio) AS level FROM l WHERE (total - before) / rest <= ratio
), t AS (
  SELECT source, source_size, n, least(cap, coalesce(level, 'inf'::DOUBLE) * weight) AS target FROM w, c
), e AS (
  SELECT d.*, t.source_size, t.n, t.target, ('0x' || substr(digest, 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, floor(rate)::BIGINT AS sure, rate - floor(rate) AS p FROM e
), q AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / ((p / (1 - p)) * sqrt(sqrt(size::DOUBLE * n / source_size))) END AS rank FROM p
), r AS (
  SELECT *, rank / (rank + (1 - p) / p) AS place, target - sum(sure * size) OVER (PARTITION BY source) AS need FROM q
), g AS (
  SELECT source, place, digest, sum(size) AS words, any_value(need) AS need FROM r WHERE place IS NOT NULL GROUP BY source, place, digest
), o AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place, digest ROWS UNBOUNDED PRECEDING) AS upto FROM g
), f AS (
  SELECT r.*, sure + CASE WHEN 2 * upto - words < 2 * o.need THEN 1 ELSE 0 END AS copies
  FROM r LEFT JOIN o ON r.source IS NOT DISTINCT FROM o.source AND r.place = o.place AND r.digest = o.digest
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM f
"""

LINE_DEDUP = f"""
WITH l AS (
  SELECT r, doc_id, line, pos, translate(trim(line, {_STRIP}), '{UPPER}', '{LOWER}') AS k
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents))
), f AS (
  SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}
), m AS (
  SELECT l.*, f.k IS NOT NULL AND doc_id <> last AS gone FROM l LEFT JOIN f USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""


def llm_oracles() -> dict[str, str]:
    return {"op2_mixing": MIXING, "op4_line_dedup": LINE_DEDUP, "op9_exact_dedup": EXACT_DEDUP}
