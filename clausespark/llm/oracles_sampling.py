"""SQL of resampling and of the conversation trie: the same results by plainer ways."""

#: crc32 in SQL: a table of 256 remainders from the polynomial, then one step per byte.
CRC = """
crc_table AS (SELECT list(list_reduce(list_prepend(b, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY b) AS remainders
  FROM (SELECT unnest(range(256))::UBIGINT AS b))"""


def crc32(text: str) -> str:
    """The unsigned crc32 of a text, for a query that joins ``crc_table``."""
    code = f"hex(encode({text}))"
    byte = f"('0x' || substr({code}, (2 * i + 1)::INT, 2))::UBIGINT"
    step = "xor(c >> 8, remainders[((xor(c, b) & 255) + 1)::BIGINT])"
    return (
        f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, "
        f"list_transform(range(length({code}) // 2), lambda i: {byte})), lambda c, b: {step}))"
    )


RESAMPLING = f"""
WITH {CRC},
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
doc_words AS (SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM docs),
item_words AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
word_buckets AS MATERIALIZED (SELECT word, {crc32("word")} % 10000 AS bucket
  FROM (SELECT word FROM doc_words UNION SELECT word FROM item_words), crc_table),
doc_buckets AS MATERIALIZED (SELECT r, bucket FROM doc_words JOIN word_buckets USING (word)),
source AS (SELECT bucket, count(*) AS s FROM doc_buckets GROUP BY 1),
target AS (SELECT bucket, count(*) AS t FROM item_words JOIN word_buckets USING (word) GROUP BY 1),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM doc_words) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM item_words) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM source FULL JOIN target USING (bucket)),
weights AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM doc_buckets JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT docs.r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)),
ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS rank, 10 * count(*) OVER () // 100 AS k
  FROM scored WHERE n_features >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank
FROM scored LEFT JOIN ranks USING (r)"""

TRIE = f"""
WITH {CRC},
said AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS n,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
original AS (SELECT conv_id, list({{'id': id, 'n': n}} ORDER BY place) AS turns FROM said GROUP BY conv_id),
asked AS (SELECT conv_id, turns, {crc32("conv_id::VARCHAR")} % 6 AS h FROM original, crc_table),
rebuilt AS MATERIALIZED (SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM asked a LEFT JOIN original b ON b.conv_id = a.conv_id - a.conv_id % 100),
depths AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt),
paths AS MATERIALIZED (SELECT conv_id, depth, list_transform(turns[1:depth], lambda t: t.id) AS path,
    list_transform(turns[1:depth - 1], lambda t: t.id) AS up, len(turns) = depth AS ends, coalesce(turns[depth].n, 0) AS n FROM depths),
nodes AS MATERIALIZED (SELECT path, depth, any_value(up) AS up, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY path, depth),
children AS (SELECT up AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path, depth)),
below AS (SELECT path, depth, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * n)::BIGINT AS saved_tokens
  FROM (SELECT f.path[1:d] AS path, d AS depth, n_children, n_convs, n FROM full_nodes f, unnest(range(f.depth + 1)) AS x(d)) GROUP BY 1, 2)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below USING (path, depth) LEFT JOIN nodes p ON f.depth > 0 AND p.path = f.up AND p.depth = f.depth - 1"""
