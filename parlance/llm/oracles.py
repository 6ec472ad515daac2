"""SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.m = e.x),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, CASE WHEN n.n IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY n.k) END AS n_equal_sets FROM c LEFT JOIN n USING (doc_id)
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = rf"""
WITH bw AS (SELECT item_id, {_WORDS} AS w, least(10, len(w)) AS z FROM benchmark WHERE len(w) > 0),
b AS (SELECT item_id, z, i - 1 AS k, array_to_string(w[i:i + z - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - z + 2)) AS i FROM bw)),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
d AS (SELECT doc_id, z, i - 1 AS pos, array_to_string(w[i:i + z - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - z + 2)) AS i FROM dw, (SELECT DISTINCT z FROM b))),
m AS (SELECT doc_id, item_id, pos, k, z FROM d JOIN b USING (z, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + z)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id),
u AS (SELECT doc_id, item_id::VARCHAR AS item, pos - k AS diagonal, min(pos) AS start, count(*) + any_value(z) - 1 AS words FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, pos - k ORDER BY pos) AS run FROM m) GROUP BY doc_id, item_id, pos - k, run),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, item, diagonal, start) AS rn FROM u)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(words, 0) AS longest_words, coalesce(start, -1) AS longest_start, coalesce(item, '') AS longest_item
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN (SELECT * FROM t WHERE rn = 1) USING (doc_id)
"""

_TEXT = "coalesce(text, '')"
SECRETS = rf"""
SELECT doc_id, len(list_filter(regexp_extract_all({_TEXT}, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all({_TEXT}, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 20)) AS n_access, len(list_filter(regexp_extract_all({_TEXT}, '[0-9a-f]+'), lambda v: length(v) >= 24)) AS n_hex FROM documents
"""

_RULES = "(VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS r(verdict, site, start)"
URLS = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
f AS (SELECT page_id, host, path, site || start AS rule, verdict, length(site || start) AS n FROM p JOIN {_RULES} ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start)),
b AS (SELECT page_id, host, path, arg_max(rule, n) AS rule, arg_max(verdict, n) AS rule_verdict FROM f GROUP BY ALL)
SELECT page_id, host, path, rule, rule_verdict FROM p LEFT JOIN b USING (page_id, host, path)
"""

MEDIA = f"""
WITH p AS (SELECT doc_id, {_TEXT} AS t, strlen({_TEXT}) AS n FROM documents), q AS (SELECT *, greatest(192, (n + 191) // 192 * 192) AS m FROM p)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(t || repeat(' ', m - n)) AS payload_sha256 FROM q
"""
