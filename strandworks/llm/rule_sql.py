"""SQL of the query op11: counts, exact binomial tails and the choice of cutoffs in plain aggregates."""

from strandworks.llm.quality_rules import DELTA, LADDER, LEAST_WORDS, MOST_REPEATED, RISK, RULES

SHARES = ", ".join(f"CASE WHEN {b} > 0 THEN least(floor({t} * {a} / {b}), 1000) ELSE 0 END AS {name}" for name, (a, b, t) in RULES.items())

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
p AS (SELECT rid, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s) WINDOW o AS (PARTITION BY rid ORDER BY i)),
a AS (SELECT rid, i FROM p WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, w, w2, w3) > 1),
m AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM a) GROUP BY rid),
c AS (SELECT doc_id, lang, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(m.n, 0) AS n_repeat_words, len(ls) AS n_lines FROM s LEFT JOIN m USING (rid)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {SHARES} FROM c),
k AS (SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
u AS (SELECT lang, md5(CAST(doc_id AS VARCHAR)) >= '8' AS held, good, {", ".join(RULES)} FROM f JOIN k USING (doc_id) WHERE NOT base_failed),
l AS (SELECT * FROM u UNPIVOT (value FOR rule IN ({", ".join(RULES)}))),
t AS (SELECT lang, rule, cutoff, count(*) FILTER (WHERE held AND good = 1) AS n, count(*) FILTER (WHERE held AND good = 1 AND value > cutoff) AS k,
  count(*) FILTER (WHERE NOT held AND good = 0 AND value > cutoff) AS bad, count(*) FILTER (WHERE NOT held AND good = 1 AND value > cutoff) AS lost FROM l, (SELECT unnest({list(LADDER)}) AS cutoff) GROUP BY ALL),
b AS (SELECT *, CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - lgamma(n - i + 1) + i * ln({RISK / len(RULES)}) + (n - i) * ln(1 - {RISK / len(RULES)})))) END
  <= {DELTA} / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM l)) * {len(RULES)}) AS passes FROM t),
o AS (SELECT * FROM b QUALIFY bool_and(passes) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC)),
h AS (SELECT lang, rule, cutoff FROM o WHERE bad > lost QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY bad - lost DESC, cutoff DESC) = 1),
g AS (SELECT lang, {", ".join(f"max(cutoff) FILTER (WHERE rule = '{r}') AS cut_{r}" for r in RULES)} FROM h GROUP BY lang),
v AS (SELECT f.*, list_filter([{", ".join(f"CASE WHEN {r} > cut_{r} THEN '{r}' END" for r in RULES)}], lambda x: x IS NOT NULL) AS fired FROM f LEFT JOIN g ON f.lang IS NOT DISTINCT FROM g.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND len(fired) = 0 AS kept, CASE WHEN len(fired) > 0 THEN array_to_string(fired, ',') END AS rejected_by FROM v
"""
