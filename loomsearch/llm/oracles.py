"""DuckDB SQL for the queries that SQL can express."""

from .mixing import BLOCK_WORDS, SEED

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"

OP2 = f"""
WITH d AS (SELECT doc_id, source, {_WORDS} AS size FROM documents),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy_of FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s0),
s2 AS (SELECT *, z * 3 AS cap, (z * 3)::DOUBLE / w AS ratio, sum(z) OVER ()::BIGINT AS t, sum(w) OVER ()::BIGINT AS ws FROM s1),
s3 AS (SELECT *, t - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remain,
          ws - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS openw FROM s2),
s4 AS (SELECT *, cap * openw <= w * remain AS capped FROM s3),
s5 AS (SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE (w * (t - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)::BIGINT))::DOUBLE
          / (ws - coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0)::BIGINT)::DOUBLE END AS target FROM s4),
s AS (SELECT source, z, target, least(floor(target + 0.5)::BIGINT, cap) AS quota,
          CASE WHEN z > 0 THEN least(floor(target + 0.5)::BIGINT, cap) // z ELSE 0 END AS epochs FROM s5),
b AS (SELECT doc_id, source, size, copy_of, unnest(range(((size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS})::BIGINT)) AS block FROM u WHERE size > 0),
k AS (SELECT *, least({BLOCK_WORDS}, size - block * {BLOCK_WORDS}) AS words,
          md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, ''), size::VARCHAR, copy_of::VARCHAR, block::VARCHAR)) AS key FROM b),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key, size ROWS UNBOUNDED PRECEDING)::BIGINT - words AS before FROM k),
x AS (SELECT c.doc_id, c.source, c.size, c.copy_of, sum(greatest(0, least(c.words, s.quota - s.epochs * s.z - c.before)))::BIGINT AS extra
      FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source GROUP BY ALL)
SELECT u.doc_id, u.size, s.z AS source_size, s.target, (s.epochs * u.size + coalesce(x.extra, 0))::BIGINT AS taken
FROM u JOIN s ON u.source IS NOT DISTINCT FROM s.source
LEFT JOIN x ON u.doc_id IS NOT DISTINCT FROM x.doc_id AND u.source IS NOT DISTINCT FROM x.source AND u.size = x.size AND u.copy_of = x.copy_of
"""

OP6 = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
t AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM t
"""

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_DIGITS}', (('0x' || substr(hash, {5 * k + 1}, 5))::BIGINT >> {5 * (3 - j)} & 31)::INTEGER + 1, 1)" for k in range(8) for j in range(4))
OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hash, max(page_id) OVER (PARTITION BY body) AS newest FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to FROM h
"""

OP9 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP5 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
       AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)) AS kept
FROM v LEFT JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + least(len(ws), 5) - 1], ' ') AS sh
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n na ON p.a = na.doc_id JOIN n nb ON p.b = nb.doc_id WHERE 100 * p.both >= 85 * (na.n + nb.n - p.both)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.low, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c.low, w.doc_id)) AS kept
FROM w LEFT JOIN c ON w.doc_id = c.a LEFT JOIN n ON w.doc_id = n.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op2_source_mix": OP2, "op5_vector_dedup": OP5, "op6_url_rules": OP6, "op8_warc": OP8, "op9_exact_dedup": OP9, "op10_minhash": OP10}
