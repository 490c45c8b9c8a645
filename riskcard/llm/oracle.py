"""DuckDB SQL for the queries that SQL can express on the same tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# words covered by a 50-word window that also starts in a document with a smaller id
_COVERED = f"""
w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(ws, p + 1, p + 50), ' ') AS s
        FROM w, LATERAL unnest(range(len(ws) - 49)) AS t(p) WHERE len(ws) >= 50),
lows AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p + k AS p
         FROM win JOIN lows USING (s), LATERAL unnest(range(50)) AS t(k) WHERE doc_id > lo)
"""

SUFFIX_DEDUP = f"""
WITH {_COVERED},
runs AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM gone),
parts AS (SELECT doc_id, min(p) AS a, max(p) + 1 AS b FROM runs GROUP BY doc_id, run)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, '') AS spans
FROM w LEFT JOIN (SELECT doc_id, sum(b - a) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS spans
                  FROM parts GROUP BY doc_id) x ON x.doc_id = w.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH {_COVERED},
each AS (SELECT w.doc_id, u.i - 1 AS p, u.x AS word
         FROM w, LATERAL (SELECT unnest(ws) AS x, generate_subscripts(ws, 1) AS i) u)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT each.doc_id, count(*) FILTER (gone.p IS NOT NULL) AS n,
                         string_agg(word, ' ' ORDER BY each.p) FILTER (gone.p IS NULL) AS kept
                  FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.p
                  GROUP BY each.doc_id) x ON x.doc_id = w.doc_id
"""

_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
need AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n,
                array_to_string(list_slice(ws, p + 1, p + least(10, len(ws))), ' ') AS s
         FROM b, LATERAL unnest(range(greatest(len(ws) - 9, 1))) AS t(p) WHERE len(ws) > 0),
size AS (SELECT DISTINCT n FROM need),
win AS (SELECT doc_id, p, n, array_to_string(list_slice(ws, p + 1, p + n), ' ') AS s
        FROM d, size, LATERAL unnest(range(len(ws) - n + 1)) AS t(p) WHERE len(ws) >= n),
found AS (SELECT doc_id, p, n, item_id FROM win JOIN need USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit
         FROM found, LATERAL unnest(range(n)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

EXACT_TOP_K = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)])::BIGINT AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

# base32 of the 160 bits, 20 bits (5 hex digits, 4 letters) at a time
_BASE32 = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (5 * (i // 4) + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)
    FOR i IN range(32)], '')"""
WARC = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h
           FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

URL_FILTERS = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
p AS (SELECT row_number() OVER () AS n, page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
u AS (SELECT n, page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
      FROM p),
m AS (SELECT u.n, rules.host || rules.path AS rule, verdict,
             row_number() OVER (PARTITION BY u.n ORDER BY length(rules.host || rules.path) DESC, verdict DESC,
                                rules.host || rules.path) AS k
      FROM u JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host))
                       AND starts_with(u.path, rules.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) x ON x.n = u.n
"""

# the shortest prefix of the 60 hash bits whose documents fit the limit
SHARDING = """
WITH d AS (SELECT row_number() OVER () AS n, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS b,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
lv AS (SELECT n, h >> (60 - k) AS prefix, k, sum(b) OVER w AS bytes, count(*) OVER w AS docs
       FROM d, LATERAL unnest(range(61)) AS t(k) WINDOW w AS (PARTITION BY k, h >> (60 - k))),
best AS (SELECT n, min(k) AS k FROM lv WHERE bytes <= {limit} OR docs = 1 GROUP BY n)
SELECT doc_id, b AS doc_bytes,
       's' || CASE WHEN best.k = 0 THEN '' ELSE lpad(bin(lv.prefix), best.k::INTEGER, '0') END AS shard,
       best.k::INTEGER AS shard_depth, lv.bytes::BIGINT AS shard_bytes, lv.docs::BIGINT AS shard_docs
FROM d JOIN best USING (n) JOIN lv ON lv.n = d.n AND lv.k = best.k
"""

ORACLES = {"op1_suffix_dedup": SUFFIX_DEDUP, "op4_exact_top_k": EXACT_TOP_K,
           "op5_benchmark_decontamination": DECONTAMINATION, "op6_substring_dedup": SUBSTRING_DEDUP,
           "op7_warc": WARC, "op8_url_filters": URL_FILTERS,
           "op10_extendible_hash_sharding": SHARDING.format(limit=64 << 20)}
