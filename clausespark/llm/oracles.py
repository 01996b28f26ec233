"""DuckDB SQL whose rows the queries of this folder must give, stated without their methods."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents),
win AS (
  SELECT r, doc_id, unnest(range(1, len(ws) - 48)) AS i,
         unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS k
  FROM w WHERE len(ws) >= 50),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (
  SELECT r, list(DISTINCT i + o) AS g
  FROM win JOIN low USING (k), (SELECT unnest(range(0, 50)) AS o)
  WHERE m < doc_id GROUP BY r),
kept AS (SELECT w.*, g, list_filter(ws, lambda x, i: g IS NULL OR NOT list_contains(g, i)) AS ks FROM w LEFT JOIN gone USING (r))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(ks))::BIGINT AS n_removed,
       sha256(array_to_string(ks, ' ')) AS kept_sha256
FROM kept
"""

_ITEM_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), " + r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_ITEM_WORDS} AS ws, least(10, len(ws)) AS n FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS k
  FROM items WHERE n > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS ws FROM documents),
dw AS (
  SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS i,
         unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS k
  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n),
hit AS (SELECT r, i, dw.n AS n, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.n = iw.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS h
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

MINHASH = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh
  FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS k FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM u a JOIN u b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT x, b FROM reach JOIN both_ways ON y = a),
part AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN part USING (doc_id)
"""

LINE_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, source, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM d WHERE text IS NOT NULL),
bad AS (
  SELECT line, min({'d': doc_id, 'i': i}) AS f FROM l WHERE trim(line, ' ') <> ''
  GROUP BY line HAVING count(DISTINCT source) >= 8),
gone AS (SELECT r, list(DISTINCT i) AS g FROM l JOIN bad USING (line) WHERE {'d': doc_id, 'i': i} <> f GROUP BY r)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN g IS NULL THEN coalesce(text, '')
              ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(g, i - 1)), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

EMBEDDING_DEDUP = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
n AS (SELECT a AS vec_id, count(*) AS c FROM link GROUP BY a),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT x, b FROM reach JOIN link ON y = a),
part AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, coalesce(c, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN part USING (vec_id) LEFT JOIN n USING (vec_id)
"""
