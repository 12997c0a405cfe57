"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from corpuscle.llm.licenses import BASE, COMMON, DRIFT, NOTICES, SHORT

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {10 * k + 1}, 10))::BIGINT >> {5 * j}) & 31) + 1)::INT, 1)" for k in range(4) for j in range(7, -1, -1))

OP2 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages), f AS (SELECT html, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, n::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (html)"""

_DOT = "list_reduce(list_transform(list_zip(q.embedding, c.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE), lambda s, x: s + x)"

OP4 = f"""WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT} AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

_TEMPLATES = ", ".join(f"('{t}', '{label}', {str(base).lower()})" for names, base in ((BASE, True), (NOTICES, False)) for t, label in names.items())

_COMMON = ", ".join(f"'{w}'" for w in COMMON)

OP5 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), t AS (SELECT text AS template, label, base, string_split(text, ' ') AS w FROM (VALUES {_TEMPLATES}) AS x(text, label, base)),
tp AS (SELECT template, label, base, p AS place, w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT *, unnest(range(0, len(w) - 1)) AS p FROM t) WHERE base OR NOT (w[p + 1] IN ({_COMMON}) AND w[p + 2] IN ({_COMMON}))),
tg AS (SELECT *, count(*) OVER (PARTITION BY template, base) AS total FROM tp),
dg AS (SELECT doc_id, p AS spot, w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT *, unnest(range(0, len(w) - 1)) AS p FROM d)),
v AS (SELECT doc_id, template, label, base, total, spot - place AS diagonal, list(place) AS places FROM dg JOIN tg USING (g) GROUP BY ALL),
ph AS (SELECT doc_id, label, diagonal FROM v WHERE base AND len(places) = total),
f AS (SELECT doc_id, label, total, flatten(list(list_transform(places, lambda p: [p, p + diagonal])) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {DRIFT} FOLLOWING)) AS met FROM v WHERE NOT base),
s AS (SELECT *, len(list_distinct(list_transform(met, lambda x: x[1]))) AS seen FROM f), n AS (SELECT *, seen / total AS share FROM s WHERE seen / total >= CASE WHEN total < {SHORT} THEN 1 ELSE 0.8 END),
c AS (SELECT doc_id, label, share, seen, unnest(list_distinct(list_transform(met, lambda x: x[2]))) AS spot FROM n), won AS (SELECT doc_id, label, share FROM c QUALIFY rank() OVER (PARTITION BY doc_id, spot ORDER BY share DESC, seen DESC) = 1),
k AS (SELECT doc_id, label, diagonal, 1.0 AS share, true AS phrase FROM ph UNION ALL SELECT doc_id, label, NULL, share, false FROM won)
SELECT d.doc_id, len(w) AS n_words, count(*) FILTER (phrase) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0)::DOUBLE AS score FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, d.w"""

OP7 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i)), n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1),
g AS (SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i))),
h AS (SELECT doc_id, item_id, count(*) AS shared FROM g JOIN s USING (k, s) GROUP BY 1, 2)
SELECT doc_id, item_id, shared / n AS containment, shared::INT AS n_shared, n::INT AS n_shingles FROM h JOIN n USING (item_id) WHERE shared >= 0.8 * n - 1e-9"""

#: crc32 of a text of ASCII characters: bits of every byte go through the register one by one.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295)"

OP11 = f"""WITH r AS (SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS s, octet_length(encode(coalesce(text, ''))) AS n FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(s || ':' || n ORDER BY turn NULLS FIRST, s) AS t FROM r GROUP BY 1),
b AS (SELECT o.conv_id, o.t, coalesce(h.t, []) AS head, {_CRC.format('o.conv_id::VARCHAR')} % 9 AS h FROM own o LEFT JOIN own h ON h.conv_id = o.conv_id - o.conv_id % 5),
c AS (SELECT conv_id, list_concat(head[1:h], t[h + 1:]) AS t FROM b),
m AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM c),
n AS (SELECT array_to_string(t[1:d], ',') AS path, d AS depth, CASE WHEN d > 0 THEN array_to_string(t[1 : d - 1], ',') END AS up, any_value(t[1:d]) AS turns, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(t) = d), '') AS ends,
  CASE WHEN d > 0 THEN (count(*) - 1) * any_value(string_split(t[d], ':')[2]::BIGINT) ELSE 0 END AS saved FROM m GROUP BY path, d, up),
k AS (SELECT up AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path AND k.depth = n.depth),
s AS (SELECT array_to_string(turns[1:e], ',') AS path, e AS depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM a) GROUP BY ALL)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN s ON s.path = a.path AND s.depth = a.depth LEFT JOIN a p ON p.path = a.up AND p.depth = a.depth - 1"""

OP13 = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS other, a.label = o.label AS same, list_reduce(list_transform(list_zip(a.v, o.v), lambda x: x[1] * x[2]), lambda s, x: s + x) AS score FROM r a JOIN r o ON a.vec_id <> o.vec_id OR a.label <> o.label WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other))::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
