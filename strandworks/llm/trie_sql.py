"""SQL of the queries op12 and op13; the checksum is computed bit by bit from a string's bytes."""

from strandworks.llm.conversation_trie import HEADS, SHARED
from strandworks.llm.spelling import DELETES, LEAST_CHARS, LEAST_COUNT, TIMES

#: The reversed polynomial of the checksum and the mask it starts and ends with: fixed values.
POLYNOMIAL, MASK = 3988292384, 4294967295


def crc32(text: str) -> str:
    data = f"hex(encode({text}))"
    steps = f"flatten(list_transform(range(1, length({data}) // 2 + 1), lambda i: [CAST('0x' || substr({data}, 2 * i - 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(CAST({MASK} AS BIGINT), {steps}), lambda c, x: xor(xor(c, x) >> 1, {POLYNOMIAL} * (xor(c, x) & 1))), {MASK})"


OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS r FROM documents),
l AS (SELECT k, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM d WHERE length(r) >= {LEAST_CHARS} GROUP BY ALL),
h AS (SELECT r, c, {crc32("k || ':' || r")} AS h FROM l),
w AS (SELECT CASE WHEN h % {DELETES} = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, c FROM h),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word UNION SELECT x.word, v.word FROM x JOIN v ON x.less = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.less = v.word),
m AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(o := -v.n, b := b)) AS best FROM p JOIN v ON v.word = b GROUP BY a),
f AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.o >= {TIMES} * v.n THEN best.b END AS form, CASE WHEN -best.o >= {TIMES} * v.n THEN -best.o END AS form_n FROM v LEFT JOIN m USING (word)),
o AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT o.word, f.form FROM o JOIN f ON f.word = o.at WHERE f.form IS NOT NULL),
e AS (SELECT o.word, o.at FROM o JOIN f ON f.word = o.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(e.at, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN e USING (word)
"""

OP13_SQL = f"""
WITH o AS (SELECT CAST(conv_id AS BIGINT) AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
h AS (SELECT c, l, c - c % {SHARED} AS b, CASE WHEN c % {SHARED} = 0 THEN 0 ELSE {crc32("CAST(c AS VARCHAR)")} % {HEADS} END AS h FROM o),
s AS (SELECT h.c, list_concat(coalesce(o.l[1:CAST(h AS INTEGER)], h.l[1:0]), h.l[CAST(h AS INTEGER) + 1:]) AS l FROM h LEFT JOIN o ON o.c = h.b),
m AS (SELECT c, d, l[1:d] AS p, d = len(l) AS ends FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM s)),
n AS (SELECT d, p, min(c) AS c, count(*) AS n, coalesce(sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends)), sha256('')) AS e,
  CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(p[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS s FROM m GROUP BY d, p),
k AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL),
q AS (SELECT n.*, coalesce(k.k, 0) AS k FROM n LEFT JOIN k ON k.d = n.d AND k.p = n.p),
a AS (SELECT p[1:i] AS p, i AS d, CAST(sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS BIGINT) AS leaves, CAST(sum(s) AS BIGINT) AS saved FROM (SELECT p, k, s, unnest(range(0, d + 1)) AS i FROM q) GROUP BY ALL)
SELECT q.c AS conv_id, q.d AS depth, u.c AS parent_conv_id, q.n AS n_convs, q.k AS n_children, a.leaves AS n_leaves, a.saved AS saved_tokens, q.e AS ends_sha256
FROM q JOIN a ON a.d = q.d AND a.p = q.p LEFT JOIN n u ON u.d = q.d - 1 AND u.p = q.p[1:q.d - 1]
"""
