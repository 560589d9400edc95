"""DuckDB SQL for the operators whose results SQL can state, written from their definitions.

The others (a trained classifier, hashes that SQL engines do not share, entropy
spans, diagonal votes) are tested against brute force in ``tests/llm``.
"""

OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
         AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
         AND len([x FOR x IN embedding IF x <> 0]) > 0 AS ok
  FROM embeddings),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp.c AS component_id, comp.c = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN comp ON comp.a = v.vec_id
"""

OP6 = r"""
WITH cap AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00'
         + to_minutes(('0x' || substr(md5('fetch:' || page_id || ':' || url), 1, 7))::BIGINT % 525600) AS fetched,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host
  FROM pages),
suf AS (
  SELECT DISTINCT host, array_to_string(l[i:], '.') AS pattern, len(l) - i + 1 AS n
  FROM (SELECT host, string_split(host, '.') AS l, unnest(generate_series(1, len(string_split(host, '.')))) AS i
        FROM (SELECT DISTINCT host FROM cap WHERE host IS NOT NULL))),
names AS (
  SELECT pattern, ('0x' || substr(md5('list:' || pattern), 1, 4))::BIGINT AS u
  FROM (SELECT DISTINCT pattern FROM suf WHERE n >= 3)),
ent AS (
  SELECT pattern, CASE WHEN u % 5 = 0 THEN 'allow' ELSE 'block' END AS kind, a AS action, DATE '2024-01-01' + (u % 120 + d)::INT AS dated
  FROM names, (VALUES ('add', 0, 3), ('remove', 60, 6), ('add', 150, 12)) AS t(a, d, m) WHERE u % m = 0),
act AS (
  SELECT cap.page_id, cap.url, suf.pattern, e.kind, e.action
  FROM cap JOIN suf USING (host) JOIN ent e ON e.pattern = suf.pattern AND e.dated <= cap.fetched
  QUALIFY row_number() OVER (PARTITION BY cap.page_id, cap.url, suf.pattern ORDER BY e.dated DESC) = 1),
best AS (
  SELECT page_id, url, count(*) AS n, arg_max(pattern, length(pattern)) AS matched, arg_max(kind, length(pattern)) AS kind
  FROM act WHERE action = 'add' GROUP BY page_id, url)
SELECT cap.page_id, host, coalesce(n, 0)::BIGINT AS n_active, matched, coalesce(kind = 'block', false) AS blocked
FROM cap LEFT JOIN best USING (page_id, url)
"""

_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""
WITH items AS (
  SELECT DISTINCT item_id, {_WORDS.format(t="text")} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT item_id, 13 AS n, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM items WHERE len(w) >= 13)
  UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM items WHERE len(w) BETWEEN 1 AND 12),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, sizes WHERE len(w) >= n)),
found AS (SELECT grams.r, grams.i, grams.n, wins.item_id FROM grams JOIN wins ON wins.n = grams.n AND wins.g = grams.g),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT docs.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS ss,
         [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
-- sources in the order in which a rising level of words per weight fills them up to twice their size
o AS (SELECT *, row_number() OVER (ORDER BY 2 * ss / w, source) AS k FROM s),
l AS (
  SELECT k, 1.5 * (SELECT sum(ss) FROM s) - 2 * coalesce(sum(ss) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, 2 * ss / w AS level
  FROM o),
f AS (SELECT rest, ws, k FROM l WHERE rest / ws <= level ORDER BY k LIMIT 1),
t AS (
  SELECT o.source, ss, CASE WHEN o.k < f.k THEN 2 * ss ELSE least(w * rest / ws, 2 * ss) END AS target FROM o, f),
p AS (
  SELECT d.doc_id, d.size, t.ss, t.target, least(round(t.target), 2 * t.ss) AS words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, ss::BIGINT AS source_size, target,
       (greatest(0, least(size, words - pos)) + greatest(0, least(size, words - ss - pos)))::BIGINT AS taken
FROM p
"""

#: One bit of a CRC-32 (the reflected polynomial of the standard), on the accumulator ``a``.
_CRC_BIT = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
_CRC_BYTE = f"list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: {_CRC_BIT})"
_CRC = (f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        f"lambda a, b: {_CRC_BYTE}), 4294967295)")

OP11 = f"""
WITH t AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS n,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS id
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (
  SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS k, list(n ORDER BY turn NULLS FIRST, id) AS n,
         ({_CRC} % 6)::INT AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT s.conv_id, list_concat(coalesce(b.k, [])[1:s.h], s.k[s.h + 1:]) AS k, list_concat(coalesce(b.n, [])[1:s.h], s.n[s.h + 1:]) AS n
  FROM s LEFT JOIN s b ON b.conv_id = s.conv_id - s.conv_id % 100),
pre AS (
  SELECT conv_id, d, md5(array_to_string(k[1:d], '')) AS p, coalesce(n[d], 0) AS l, d = len(k) AS ends
  FROM (SELECT conv_id, k, n, unnest(generate_series(0, len(k))) AS d FROM r)),
node AS (
  SELECT p, d, min(conv_id) AS c, count(*) AS n, max(l) AS l,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS e
  FROM pre GROUP BY p, d),
up AS (SELECT node.p, pre.p AS parent FROM node JOIN pre ON pre.conv_id = node.c AND pre.d = node.d - 1),
kids AS (SELECT parent, count(*) AS n FROM up GROUP BY parent),
below AS (
  SELECT pre.p, count(*) FILTER (kids.n IS NULL) AS leaves, sum((node.n - 1) * node.l) AS saved
  FROM node JOIN pre ON pre.conv_id = node.c AND pre.d <= node.d LEFT JOIN kids ON kids.parent = node.p
  GROUP BY pre.p)
SELECT node.c AS conv_id, node.d::BIGINT AS depth, above.c AS parent_conv_id, node.n AS n_convs,
       coalesce(kids.n, 0)::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens,
       node.e AS ends_sha256
FROM node JOIN below USING (p) LEFT JOIN kids ON kids.parent = node.p
LEFT JOIN up ON up.p = node.p LEFT JOIN node above ON above.p = up.parent
"""

SQL = {"op2_embedding_near_dedup": OP2, "op6_url_filter": OP6, "op8_decontamination": OP8, "op10_source_mix": OP10, "op11_prefix_trie": OP11}
