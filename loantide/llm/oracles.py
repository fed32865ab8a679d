"""DuckDB SQL of the registered queries that SQL can express, over the same tables."""

from __future__ import annotations

#: DuckDB's lower() would change letters beyond A-Z as well.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# CRC-32 (reflected polynomial 0xEDB88320) from a table of 256 entries, each by eight shifts of its index.
_STEP = "CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END"
_CRC_TABLE = f"""
    SELECT list(c ORDER BY i) AS t FROM (
      WITH RECURSIVE s(i, k, c) AS (
        SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, {_STEP} FROM s WHERE k < 8)
      SELECT i, c FROM s WHERE k = 8)"""
_BYTES = "list_transform(range(0, length(hex(encode(w))), 2), lambda j: ('0x' || substr(hex(encode(w)), j::INT + 1, 2))::BIGINT)"

OP11 = f"""
WITH crc AS ({_CRC_TABLE}),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
bench AS (SELECT {_TERMS} AS ws FROM benchmark),
raw AS (SELECT r, unnest(ws) AS w FROM doc),
tgt AS (SELECT unnest(ws) AS w FROM bench),
word AS (SELECT w, list_prepend(4294967295::BIGINT, {_BYTES}) AS b FROM (SELECT DISTINCT w FROM (SELECT w FROM raw UNION ALL SELECT w FROM tgt))),
hashed AS (SELECT w, xor(4294967295::BIGINT, list_reduce(b, lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1]))) % 10000 AS k FROM word, crc),
s AS (SELECT k, count(*) AS n FROM raw JOIN hashed USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM tgt JOIN hashed USING (w) GROUP BY k),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS tt),
gain AS (
  SELECT k, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (ss + 10000)) / ((coalesce(s.n, 0) + 1)::DOUBLE * (tt + 10000))))::BIGINT AS g
  FROM s FULL JOIN t USING (k), tot),
weight AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM raw JOIN hashed USING (w) JOIN gain USING (k) GROUP BY r),
scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, r,
    ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM doc LEFT JOIN weight USING (r)),
final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
place AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS p, count(*) OVER () AS n
  FROM final WHERE n_features >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= 10 * n // 100 THEN p END::BIGINT AS rank
FROM final LEFT JOIN place USING (r)
"""

OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
e AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, ((5 * i) // 4)::INT + 1, 2))::BIGINT >> (3 - (5 * i) % 4)::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
    row_number() OVER (PARTITION BY hex, payload_bytes ORDER BY page_id DESC NULLS LAST) AS n,
    first(page_id) OVER (PARTITION BY hex, payload_bytes ORDER BY page_id DESC NULLS LAST) AS best
  FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 THEN best END AS refers_to
FROM e
"""

OP13 = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
item AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS ws FROM benchmark),
stats AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, coalesce(sum(len(ws)), 0)::BIGINT AS total FROM doc),
tf AS (SELECT r, doc_id, w, n, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS w FROM doc) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
want AS (SELECT q, item_id, w, count(*) AS c FROM (SELECT q, item_id, unnest(ws) AS w FROM item) GROUP BY ALL),
part AS (
  SELECT q, item_id, r, doc_id, c * floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total))) AS x
  FROM want JOIN df USING (w) JOIN tf USING (w), stats),
score AS (SELECT q, item_id, r, doc_id, sum(x)::BIGINT AS score FROM part GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM top WHERE rank <= 20
"""
