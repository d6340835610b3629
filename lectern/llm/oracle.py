"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 2.0::DOUBLE * source_size AS lim,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM s),
budget AS (SELECT 1.5::DOUBLE * sum(source_size) AS b FROM s),
o AS (
  SELECT *, coalesce(sum(lim) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w
  WINDOW p AS (ORDER BY lim / weight, source)),
unit AS (SELECT min_by((b - capped) / open_weight, lim / weight) AS u FROM o, budget WHERE (b - capped) / open_weight <= lim / weight),
t AS (SELECT source, source_size, CASE WHEN lim < u * weight THEN lim ELSE u * weight END AS target FROM w, unit),
r AS (
  SELECT d.doc_id, d.source, d.size, d.key, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size, d.doc_id ROWS UNBOUNDED PRECEDING) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, (source_size * copy + run) / target AS finish
  FROM r, (VALUES (0), (1)) c(copy) WHERE size > 0 AND target > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, size, doc_id, copy ROWS UNBOUNDED PRECEDING) AS upto FROM q),
n AS (SELECT doc_id, source, size, count(*) AS copies FROM g, budget WHERE upto <= b GROUP BY ALL)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST(r.size * coalesce(n.copies, 0) AS BIGINT) AS taken
FROM r LEFT JOIN n ON r.doc_id = n.doc_id AND r.source IS NOT DISTINCT FROM n.source
"""

OP3 = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : least(i + 4, len(w))], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
c(doc_id, root) AS (SELECT x, x FROM u UNION SELECT u.y, c.root FROM c JOIN u ON u.x = c.doc_id)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.root, t.doc_id) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM c GROUP BY doc_id) m USING (doc_id)
"""

OP4 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS origin FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN origin = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN origin <> page_id THEN origin END AS refers_to
FROM m
"""

_WORDS9 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS9} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS9} AS w FROM benchmark),
k AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
g AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM k) WHERE len(w) >= size)),
h AS (SELECT g.doc_id, g.i, k.size, k.item FROM g JOIN k ON g.s = k.s AND g.size = k.size),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY encode(item)) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP11 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents),
seen AS (SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(bytes) // 2), lambda i: CAST('0x' || bytes[2 * i + 1 : 2 * i + 2] AS BIGINT))),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM seen, crc_table),
typed AS (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % len(run)] || run[h % len(run) + 2 :] ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, unnest(range(len(word))) AS i FROM v),
wild AS (SELECT word, n, i, word[1 : i] AS a, word[i + 2 :] AS z FROM cut),
short AS (SELECT DISTINCT word, n, word[1 : i] || word[i + 2 :] AS s FROM cut),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM wild x JOIN wild y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION ALL SELECT s.word, v.word, v.n FROM short s JOIN v ON v.word = s.s
  UNION ALL SELECT v.word, s.word, s.n FROM short s JOIN v ON v.word = s.s),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m FROM near GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word),
chain(word, stop, up) AS (SELECT word, word, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON f.word = c.up)
SELECT f.word, f.form, chain.stop AS root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND chain.up IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1, "op3_ngram_jaccard": OP3, "op4_warc": OP4, "op9_decontaminate": OP9, "op11_spelling_variants": OP11}
