"""Queries on trial scores, clinical recodes, plates, primers and screens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.columns import nearest, rounded
from strandworks.operators import expression as ex
from strandworks.operators import qpcr as qp
from strandworks.operators import screen as sc
from strandworks.operators import sequence as sq
from strandworks.operators import trial as tr
from strandworks.plans import sql_parts as parts
from strandworks.plans.views import view, with_views

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (lambda spark, sf_dir, fn=fn: rounded(fn(spark, lambda v: view(spark, sf_dir, v))), with_views(sql) if sql else None)
        return fn

    return add


@query("SELECT id, er, her2_a, her2_b FROM (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative' END AS er, CASE c_custkey % 5 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative' END AS her2_a, CASE c_custkey % 7 WHEN 0 THEN 'positive' END AS her2_b, c_acctbal AS time, CASE WHEN c_custkey % 11 <> 0 THEN 1 END AS event FROM customer) WHERE er = 'Positive' AND coalesce(her2_a, '') <> 'Positive' AND her2_b IS NULL AND time > 0 AND event IS NOT NULL")
def f4_receptor_cohort(spark, v):
    k = F.col("c_custkey")
    rows = v("customer").select(k.alias("id"), F.when(k % 3 == 0, "Positive").when(k % 3 == 1, "Negative").alias("er"), F.when(k % 5 == 0, "Positive").when(k % 5 == 1, "Negative").alias("her2_a"), F.when(k % 7 == 0, "positive").alias("her2_b"), F.col("c_acctbal").alias("time"), F.when(k % 11 != 0, 1).alias("event"))
    return tr.receptor_cohort(rows, "er", ["her2_a", "her2_b"]).select("id", "er", "her2_a", "her2_b")


@query("SELECT id, CASE WHEN stage LIKE '%IV%' OR stage LIKE '%III%' THEN 'III-IV' WHEN stage LIKE '%II%' THEN 'II' WHEN stage LIKE '%Stage I%' THEN 'I' END AS stage, CAST(event AS VARCHAR)[1] AS status FROM v_cohort")
def f5_recode(spark, v):
    return v("v_cohort").select("id", tr.stage_group(F.col("stage")).alias("stage"), F.substring(F.col("event").cast("string"), 1, 1).alias("status"))


@query("SELECT id, (mw > 500)::INTEGER + (logp > 5)::INTEGER + (hbd > 5)::INTEGER + (hba > 10)::INTEGER AS lipinski, mw <= 350 AND rotb <= 6 AND heavy <= 26 AS pocket FROM v_ligands WHERE NOT coalesce(withdrawn > 0, FALSE) AND heavy BETWEEN 10 AND 50 AND mw <= 700")
def f8_drug_like(spark, v):
    kept = sc.drug_like(v("v_ligands"))
    small = sc.pocket_matched(kept).select("id", F.lit(True).alias("pocket"))
    return kept.join(small, "id", "left").select("id", "lipinski", F.coalesce("pocket", F.lit(False)).alias("pocket"))


@query("SELECT id, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY id) > 1 THEN concat(name, ' (', id, ')') ELSE name END AS name FROM v_ligands")
def f9_unique_names(spark, v):
    return sc.unique_names(v("v_ligands").select("id", "name"))


@query("SELECT p_partkey AS cell FROM part WHERE contains(lower(CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'CANCER cell' ELSE p_type END), 'cancer')")
def f10_cancer_cells(spark, v):
    kind = F.when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_partkey") % 3 == 0, "CANCER cell").otherwise(F.col("p_type"))
    return tr.cancer_cells(v("part").select(F.col("p_partkey").alias("cell"), kind.alias("type")))


@query("WITH m AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey) SELECT c_custkey, n_name, p AS first_priority FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN m ON o_custkey = c_custkey")
def j1_equi_joins(spark, v):
    first = v("orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("r = 1").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("first_priority"))
    return v("customer").join(v("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(first, "c_custkey", "left").select("c_custkey", "n_name", "first_priority")


CHANGE = """d AS (SELECT arm, patient, avg(score) FILTER (WHERE timepoint = 1) - avg(score) FILTER (WHERE timepoint = 0) AS d FROM v_scores GROUP BY ALL HAVING count(*) FILTER (WHERE timepoint = 1) > 0 AND count(*) FILTER (WHERE timepoint = 0) > 0),
c AS (SELECT arm, patient, round(d, 6) + 0.0 AS d FROM d)"""


def changes(v) -> DataFrame:
    out = tr.paired_changes(v("v_scores"), ["arm"], F.col("timepoint") == 0, F.col("timepoint") == 1)
    return out.withColumn("d", F.round("d", 6))


@query("WITH " + CHANGE + """, r AS (SELECT arm, d, rank() OVER (PARTITION BY arm ORDER BY abs(d)) + (count(*) OVER (PARTITION BY arm, abs(d)) - 1) / 2.0 AS r FROM c WHERE d <> 0),
w AS (SELECT arm, coalesce(least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0)), 0) AS w FROM r GROUP BY arm), s AS (SELECT arm, count(*) AS n, median(d) AS m FROM c GROUP BY arm HAVING count(*) >= 5)
SELECT arm, n, round(m, 6) + 0.0 AS median_change, round(w, 6) + 0.0 AS w FROM s JOIN w USING (arm)""")
def t1_paired_wilcoxon(spark, v):
    return tr.paired_wilcoxon(changes(v), ["arm"]).drop("p")


#: Paired tests by arm with p (``tp``).
PAIRED = CHANGE + f""", {parts.SIGNED_NULL},
pr AS (SELECT arm, d, {parts.ranked("abs(d)", "arm")} AS r, count(*) OVER (PARTITION BY arm, abs(d)) AS t FROM c WHERE d <> 0),
ps AS (SELECT arm, count(*) AS n, median(d) AS m, count(*) FILTER (WHERE d = 0) AS zeros FROM c GROUP BY arm HAVING count(*) >= 5),
pw AS (SELECT arm, count(*) AS m, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS w, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM pr GROUP BY arm),
tp AS (SELECT ps.arm, ps.n, ps.m AS median_change, coalesce(pw.w, 0) AS w, {parts.signed_rank_p("coalesce(pw.w, 0)", "coalesce(pw.m, 0)", "coalesce(pw.ties, 0)", "ps.zeros")} AS p FROM ps LEFT JOIN pw USING (arm) LEFT JOIN sn ON sn.n = coalesce(pw.m, 0))"""


@query("WITH RECURSIVE " + PAIRED + " SELECT arm, n, round(median_change, 6) + 0.0 AS median_change, round(w, 6) + 0.0 AS w, round(p, 6) + 0.0 AS p FROM tp")
def t1_paired_wilcoxon_p(spark, v):
    return tr.paired_wilcoxon(changes(v), ["arm"])


BASE = "b AS (SELECT arm, patient, any_value(response) AS response, round(avg(score), 6) AS score FROM v_scores WHERE timepoint = 0 GROUP BY ALL)"


def baseline(v) -> DataFrame:
    return v("v_scores").where("timepoint = 0").groupBy("arm", "patient").agg(F.first("response").alias("group"), F.round(F.avg("score"), 6).alias("score"))


def two_groups(name: str, source: str, by: str, value: str, group: str) -> str:
    """Rank sums of group 1 against group 0 (table ``name``): sizes, medians, U and p."""
    return f"""{name}_r AS (SELECT {by}, {group} AS g, {value} AS x, {parts.ranked(value, by)} AS r, count(*) OVER (PARTITION BY {by}, {value}) AS t FROM {source} WHERE {value} IS NOT NULL AND {group} IS NOT NULL),
{name}_s AS (SELECT {by}, count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 0) AS n0, median(x) FILTER (WHERE g = 1) AS median1, median(x) FILTER (WHERE g = 0) AS median0, sum(r) FILTER (WHERE g = 1) - count(*) FILTER (WHERE g = 1) * (count(*) FILTER (WHERE g = 1) + 1) / 2 AS u, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM {name}_r GROUP BY {by}),
{name} AS (SELECT {by}, n1, n0, median1, median0, u, u / (n1 * n0) AS auc, {parts.rank_sum_p("u", "n1", "n0", "ties")} AS p FROM {name}_s WHERE n1 >= 4 AND n0 >= 4)"""


@query("WITH " + BASE + ", " + two_groups("mw", "b", "arm", "score", "response") + " SELECT arm, n1, n0, round(median1, 6) + 0.0 AS median1, round(median0, 6) + 0.0 AS median0, round(u, 6) + 0.0 AS u, round(auc, 6) + 0.0 AS auc, round(p, 6) + 0.0 AS p FROM mw")
def t2_mann_whitney(spark, v):
    return tr.mann_whitney(baseline(v), ["arm"])


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS patient, event_type AS timepoint FROM events")
def t3_parse_title(spark, v):
    titled = v("events").select("event_id", F.concat_ws("_", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string")).alias("title"))
    return tr.parse_title(titled).select("event_id", "patient", "timepoint")


@query("WITH RECURSIVE " + PAIRED + ", " + BASE + ", who AS (SELECT arm, patient, any_value(response) AS response FROM v_scores GROUP BY ALL), cd AS (SELECT c.arm, c.d, who.response FROM c JOIN who USING (arm, patient)), " + two_groups("mw", "b", "arm", "score", "response") + ", " + two_groups("dl", "cd", "arm", "d", "response") + """
SELECT 'change' AS analysis, arm, n, round(median_change, 6) + 0.0 AS value, round(p, 6) + 0.0 AS p FROM tp UNION ALL SELECT 'baseline', arm, n1 + n0, round(auc, 6) + 0.0, round(p, 6) + 0.0 FROM mw
UNION ALL SELECT 'delta', arm, n1 + n0, round(median1 - median0, 6) + 0.0, round(p, 6) + 0.0 FROM dl""")
def t4_result_table(spark, v):
    """Paired change by arm, baseline by response and change by response, as one long table keyed analysis, arm."""
    paired = tr.paired_wilcoxon(changes(v), ["arm"]).select(F.lit("change").alias("analysis"), "arm", "n", F.col("median_change").alias("value"), "p")
    start = tr.mann_whitney(baseline(v), ["arm"]).select(F.lit("baseline").alias("analysis"), "arm", (F.col("n1") + F.col("n0")).alias("n"), F.col("auc").alias("value"), "p")
    who = v("v_scores").groupBy("arm", "patient").agg(F.first("response").alias("group"))
    delta = tr.mann_whitney(changes(v).join(who, ["arm", "patient"]), ["arm"], "d").select(F.lit("delta").alias("analysis"), "arm", (F.col("n1") + F.col("n0")).alias("n"), (F.col("median1") - F.col("median0")).alias("value"), "p")
    return paired.unionByName(start).unionByName(delta)


SAMPLE = "a AS (SELECT user_id % 300 AS sample, event_id % 12 AS pathway, round(avg(value), 6) AS act FROM events GROUP BY ALL), k AS (SELECT user_id % 300 AS sample, round(avg(value), 6) AS risk FROM events WHERE event_id % 12 = 0 GROUP BY ALL)"


def activity(v) -> DataFrame:
    e = v("events")
    act = e.groupBy((F.col("user_id") % 300).alias("sample"), (F.col("event_id") % 12).alias("pathway")).agg(F.round(F.avg("value"), 6).alias("act"))
    risk = e.where("event_id % 12 = 0").groupBy((F.col("user_id") % 300).alias("sample")).agg(F.round(F.avg("value"), 6).alias("risk"))
    return act.join(risk, "sample")


RHO = SAMPLE + f""", j AS (SELECT pathway, {parts.ranked("act", "pathway")} AS x, {parts.ranked("risk", "pathway")} AS y FROM a JOIN k USING (sample) WHERE act IS NOT NULL AND risk IS NOT NULL),
rh AS (SELECT pathway, corr(x, y) AS rho, count(*) AS n FROM j GROUP BY pathway)"""


@query("WITH " + RHO + f" SELECT pathway, round(rho, 6) + 0.0 AS rho, n, CASE WHEN abs(rho) < 1 THEN round({parts.t_p('(rho * sqrt((n - 2) / (1 - rho * rho)))', '(n - 2)')}, 6) + 0.0 END AS p FROM rh")
def a20_hallmark_vs_risk(spark, v):
    out = tr.spearman(activity(v), ["pathway"], "act", "risk").withColumn("rho", F.round("rho", 12))
    return out.withColumn("p", F.when(F.abs("rho") < 1, F.col("p")))


@query("WITH " + SAMPLE + ", h AS (SELECT pathway, act, CAST(risk > (SELECT median(risk) FROM k) AS INTEGER) AS high FROM a JOIN k USING (sample)), " + two_groups("mw", "h", "pathway", "act", "high") + """,
f AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS q FROM mw) SELECT pathway, round(median1 - median0, 6) + 0.0 AS median_diff, round(p, 6) + 0.0 AS p, round(least(1.0, min(q) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) + 0.0 AS fdr FROM f""")
def a21_markers_by_risk(spark, v):
    rows = activity(v)
    mid = rows.select("sample", "risk").distinct().agg(F.median("risk").alias("m"))
    tested = tr.mann_whitney(rows.join(F.broadcast(mid)).withColumn("group", (F.col("risk") > F.col("m")).cast("int")), ["pathway"], "act")  # one row
    return ex.bh_fdr(tested, []).select("pathway", (F.col("median1") - F.col("median0")).alias("median_diff"), "p", "fdr")


TECH = "te AS (SELECT gene, sample, avg(CASE WHEN cq <= 35 THEN cq END) AS mean, stddev_samp(CASE WHEN cq <= 35 THEN cq END) AS sd, count(CASE WHEN cq <= 35 THEN cq END) AS n FROM v_plate WHERE well_type = 'sample' GROUP BY ALL)"


@query("WITH " + TECH + " SELECT gene, sample, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, n FROM te")
def q1_technical(spark, v):
    return qp.technical(v("v_plate"))


@query("WITH " + TECH + """, ws AS (SELECT gene, max(mean) AS m FROM te GROUP BY gene), b AS (SELECT gene, min(CASE WHEN cq <= 35 THEN cq END) AS c FROM v_plate WHERE well_type = 'NTC' GROUP BY gene),
g AS (SELECT gene, sample, min(CASE WHEN cq <= 35 THEN cq END) AS c FROM v_plate WHERE well_type = 'noRT' GROUP BY ALL)
SELECT 'technical_sd' AS flag, gene, sample, round(sd, 6) + 0.0 AS value, 0.5 AS against FROM te WHERE sd > 0.5
UNION ALL SELECT 'ntc', gene, NULL, round(c, 6) + 0.0, round(m, 6) + 0.0 FROM b JOIN ws USING (gene) WHERE c < m + 5
UNION ALL SELECT 'no_rt', gene, sample, round(c, 6) + 0.0, round(mean, 6) + 0.0 FROM g JOIN te USING (gene, sample) WHERE c < mean + 5""")
def q1_flags(spark, v):
    return qp.qc_flags(v("v_plate"))


EFF = """ef AS (SELECT gene, count(*) AS n, regr_slope(cq, log10(dilution)) AS slope, regr_r2(cq, log10(dilution)) AS r2 FROM v_plate WHERE well_type = 'std' GROUP BY gene),
ee AS (SELECT gene, n, slope, r2, pow(10, -1 / slope) AS e FROM ef)"""


@query("WITH " + EFF + " SELECT gene, n, round(slope, 6) + 0.0 AS slope, round(r2, 6) + 0.0 AS r2, round(e, 6) + 0.0 AS e, (e - 1) * 100 BETWEEN 90 AND 110 AND r2 >= 0.99 AS passed FROM ee")
def q2_efficiency(spark, v):
    return qp.efficiency(v("v_plate"))


QUANT = TECH + ", " + EFF + """, me AS (SELECT sample, min(model) AS model, min(condition) AS condition, min(replicate) AS replicate FROM v_plate WHERE well_type = 'sample' GROUP BY sample),
qq AS (SELECT sample, model, condition, replicate, gene, pow(coalesce(e, 2.0), avg(mean) FILTER (WHERE condition = 'parental') OVER (PARTITION BY model, gene) - mean) AS q FROM te JOIN me USING (sample) LEFT JOIN ee USING (gene))"""
REFS = ["G6", "G7", "G8", "G9"]
IN = "('G6', 'G7', 'G8', 'G9')"


def quantities(v) -> DataFrame:
    plate = v("v_plate")
    return qp.relative_quantity(plate, qp.technical(plate), qp.efficiency(plate))


@query("WITH " + QUANT + " SELECT sample, model, condition, replicate, gene, round(q, 6) + 0.0 AS q FROM qq")
def q3_relative_quantity(spark, v):
    return quantities(v)


GENORM = QUANT + f""", lq AS (SELECT sample, condition, gene, log2(q) AS l FROM qq WHERE gene IN {IN}),
gp AS (SELECT a.gene, b.gene AS h, stddev_samp(a.l - b.l) AS sd FROM lq a JOIN lq b ON a.sample = b.sample AND a.gene <> b.gene GROUP BY ALL), gm AS (SELECT gene, avg(sd) AS m FROM gp GROUP BY gene),
nv AS (SELECT gene, condition, var_samp(l) AS v, avg(l) AS m FROM lq GROUP BY ALL), nf AS (SELECT gene, sqrt(avg(v)) + sqrt(coalesce(var_samp(m), 0)) AS nf FROM nv GROUP BY gene)"""


@query("WITH " + GENORM + " SELECT gene, round(m, 6) + 0.0 AS m FROM gm")
def q4_genorm(spark, v):
    return qp.genorm(quantities(v), REFS)


CHOSEN = GENORM + """, rk AS (SELECT gene, m, nf, CAST(rank() OVER (ORDER BY m) + rank() OVER (ORDER BY nf) AS DOUBLE) AS rank FROM gm JOIN nf USING (gene)),
ch AS (SELECT *, row_number() OVER (ORDER BY rank, gene) <= 2 AS chosen FROM rk)"""


def references(v) -> DataFrame:
    q = quantities(v)
    return qp.stable_references(qp.genorm(q, REFS), qp.normfinder(q, REFS))


@query("WITH " + CHOSEN + " SELECT gene, round(m, 6) + 0.0 AS m, round(nf, 6) + 0.0 AS nf, round(rank, 6) + 0.0 AS rank, chosen FROM ch")
def q5_stable_references(spark, v):
    return references(v)


NORM = CHOSEN + ", nn AS (SELECT sample, exp(avg(ln(q))) AS norm FROM qq WHERE gene IN (SELECT gene FROM ch WHERE chosen) GROUP BY sample), nq AS (SELECT qq.*, q / norm AS nrq FROM qq JOIN nn USING (sample))"


@query("WITH " + NORM + " SELECT sample, gene, round(nrq, 6) + 0.0 AS nrq FROM nq")
def q6_normalised_quantity(spark, v):
    return qp.normalised_quantity(quantities(v), references(v)).select("sample", "gene", "nrq")


@query("WITH " + NORM + """, l AS (SELECT model, gene, replicate, avg(log2(nrq)) FILTER (WHERE condition = 'resistant') - avg(log2(nrq)) FILTER (WHERE condition = 'parental') AS d FROM nq WHERE gene IN ('G0', 'G1', 'G2', 'G3', 'G4', 'G5') GROUP BY ALL),
s AS (SELECT model, gene, count(d) AS n, avg(d) AS log2fc, stddev_samp(d) AS sd, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t FROM l WHERE d IS NOT NULL GROUP BY ALL HAVING count(d) >= 2),
p AS (SELECT *, """ + parts.t_p_by_angle("t", "(n - 1)") + """ AS p FROM s), f AS (SELECT *, p * count(*) OVER (PARTITION BY model) / count(*) OVER (PARTITION BY model ORDER BY p RANGE UNBOUNDED PRECEDING) AS q FROM p)
SELECT model, gene, n, round(log2fc, 6) + 0.0 AS log2fc, round(sd, 6) + 0.0 AS sd, round(t, 4) + 0.0 AS t, round(p, 6) + 0.0 AS p, round(least(1.0, min(q) OVER (PARTITION BY model ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) + 0.0 AS fdr FROM f""")
def q7_fold_change(spark, v):
    out = qp.fold_change(qp.normalised_quantity(quantities(v), references(v)), [f"G{i}" for i in range(6)])
    return out.select("model", "gene", "n", "log2fc", "sd", F.round("t", 4).alias("t"), "p", "fdr")


TM_ROWS = ", ".join(f"('{a + b}', {h}, {s})" for (a, b), (h, s) in ((k, sq.NEIGHBOURS.get(k) or sq.NEIGHBOURS[k.translate(str.maketrans('ACGT', 'TGCA'))[::-1]]) for k in (x + y for x in "ACGT" for y in "ACGT")))


def pieces(v, size: int, alphabet: str) -> DataFrame:
    """doc_id, at and seq: every text's letters mapped to bases and cut into pieces of ``size``; a shorter rest is left out."""
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", alphabet)
    cut = F.regexp_extract_all(letters, F.lit(f"([ACGT]{{{size}}})"))
    return v("documents").select("doc_id", F.posexplode(cut).alias("at", "seq"))


@query(f"""
WITH l AS (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS l FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, CAST(k AS INTEGER) AS "at", substr(l, CAST(20 * k + 1 AS BIGINT), 20) AS seq FROM (SELECT doc_id, l, unnest(range(0, length(l) // 20)) AS k FROM l)),
n AS (SELECT * FROM (VALUES {TM_ROWS}) t(d, h, s)),
p AS (SELECT doc_id, "at", seq, substr(seq, i, 2) AS d FROM (SELECT *, unnest(range(1, 20)) AS i FROM o WHERE length(seq) = 20)),
e AS (SELECT doc_id, "at", seq, sum(h)::DOUBLE AS h, sum(s)::DOUBLE AS s FROM p JOIN n USING (d) GROUP BY ALL),
i AS (SELECT doc_id, "at", seq, h + CASE WHEN seq[1] IN ('G', 'C') THEN 0.1 ELSE 2.3 END + CASE WHEN seq[20] IN ('G', 'C') THEN 0.1 ELSE 2.3 END AS h, s + CASE WHEN seq[1] IN ('G', 'C') THEN -2.8 ELSE 4.1 END + CASE WHEN seq[20] IN ('G', 'C') THEN -2.8 ELSE 4.1 END AS s,
  length(replace(replace(seq, 'A', ''), 'T', '')) / 20.0 AS gc, ln((50 + 120 * sqrt(3 - 0.8)) / 1000) AS salt FROM e)
SELECT doc_id, "at", seq, round(1 / ((s + 1.987 * ln(0.2e-6 / 4)) / (h * 1000) + (4.29 * gc - 3.95) * 1e-5 * salt + 9.40e-6 * salt * salt) - 273.15, 4) + 0.0 AS tm FROM i""")
def p2_melting_temp(spark, v):
    return pieces(v, 20, "ACGTACGTACGTACGTACGTACGTAC").withColumn("tm", sq.melting_temp(F.col("seq"))).withColumn("tm", nearest(F.col("tm"), 4))


def transcripts(v) -> DataFrame:
    """One transcript for each passage of ``benchmark``: all its letters, all of them coding."""
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTTGCAACGTGTCAGATCCTGAAC")
    return v("benchmark").select(F.col("item_id").alias("gene"), letters.alias("seq")).where(F.length("seq") > 0).select("gene", "seq", F.lit(1).alias("low"), F.length("seq").alias("high"))


def meets(a: str, b: str, k: int) -> str:
    """Whether k letters of a stand in the reverse complement of b."""
    return f"len(list_filter(range(1, length({a}) - {k - 2}), lambda i: contains(reverse(translate({b}, 'ACGT', 'TGCA')), substr({a}, i, {k})))) > 0"


def primer_sql() -> str:
    """Every start, length, strand and pair, and the best three by hand, tier by tier."""
    salt = "ln((50 + 120 * sqrt(3 - 0.8)) / 1000)"
    gc = "(length(translate({0}, 'AT', '')) / CAST(length({0}) AS DOUBLE))"
    ends = lambda a, b: f"len(list_filter([60, 120], lambda j: j >= {a} AND j < {b} AND j - {a} + 1 >= 4 AND {b} - j >= 4)) > 0"
    out = [f"""
WITH t AS (SELECT item_id AS gene, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTTGCAACGTGTCAGATCCTGAAC') AS seq FROM benchmark),
s AS (SELECT gene, first, first + n - 1 AS last, substr(seq, first, n) AS sub FROM (SELECT gene, seq, unnest(range(1, length(seq) + 1)) AS first FROM t), (SELECT unnest(range(18, 27)) AS n) WHERE first + n - 1 <= length(seq)),
b AS (SELECT gene, 'F' AS strand, first, last, sub AS p FROM s UNION ALL SELECT gene, 'R', first, last, reverse(translate(sub, 'ACGT', 'TGCA')) FROM s),
g AS (SELECT *, {gc.format("p")} AS gc FROM b WHERE {gc.format("p")} BETWEEN 0.4 AND 0.62 AND right(p, 1) IN ('G', 'C') AND length(translate(right(p, 5), 'AT', '')) <= 3 AND NOT regexp_matches(p, 'A{{4}}|C{{4}}|G{{4}}|T{{4}}')),
n AS (SELECT * FROM (VALUES {TM_ROWS}) t(d, h, s)),
e AS (SELECT p, sum(h)::DOUBLE AS h, sum(s)::DOUBLE AS s FROM (SELECT p, substr(p, i, 2) AS d FROM (SELECT p, unnest(range(1, length(p))) AS i FROM (SELECT DISTINCT p FROM g))) JOIN n USING (d) GROUP BY p),
w AS (SELECT gene, strand, first, last, p, gc, 1 / ((s + list_sum(list_transform([p[1], p[-1]], lambda c: CASE WHEN c IN ('G', 'C') THEN -2.8 ELSE 4.1 END)) + 1.987 * ln(0.2e-6 / 4)) / ((h + list_sum(list_transform([p[1], p[-1]], lambda c: CASE WHEN c IN ('G', 'C') THEN 0.1 ELSE 2.3 END))) * 1000) + (4.29 * gc - 3.95) * 1e-5 * {salt} + 9.40e-6 * {salt} * {salt}) - 273.15 AS tm FROM g JOIN e USING (p)),
c AS MATERIALIZED (SELECT * FROM w WHERE tm BETWEEN 57 AND 64 AND NOT {meets("p", "p", 7)})"""]
    for i, ((low, high), (cold, hot), (short, long), junction) in enumerate(sq.TIERS):
        before = "".join(f" AND gene NOT IN (SELECT gene FROM k{j})" for j in range(i))
        own, cross = f"({ends('f.first', 'f.last')} OR {ends('r.first', 'r.last')})", "len(list_filter([60, 120], lambda j: j >= f.last AND j < r.first)) > 0"
        out.append(f"""o{i} AS (SELECT * FROM c WHERE tm BETWEEN {cold} AND {hot} AND last - first + 1 BETWEEN {short} AND {long}{before}),
j{i} AS MATERIALIZED (SELECT f.gene, f.p AS fwd, f.tm AS fwd_tm, f.first AS fwd_pos, r.p AS rev, r.tm AS rev_tm, r.last AS rev_pos, r.last - f.first + 1 AS amplicon, CASE WHEN {own} THEN 'primer spans junction' WHEN {cross} THEN 'amplicon spans junction' ELSE 'no junction' END AS junction,
  round(CASE WHEN {own} THEN 2 ELSE 0 END + CASE WHEN {cross} THEN 1 ELSE 0 END - abs(f.tm - r.tm) - abs(f.gc - 0.5) - abs(r.gc - 0.5), 9) AS score
  FROM o{i} f JOIN o{i} r ON f.gene = r.gene AND f.strand = 'F' AND r.strand = 'R' AND r.last - f.first + 1 BETWEEN {low} AND {high} AND abs(f.tm - r.tm) <= 1.5
  WHERE {f'({own} OR {cross})' if junction else 'TRUE'} AND NOT {meets("right(f.p, 5)", "right(r.p, 5)", 4)} AND NOT {meets("f.p", "r.p", 8)}),
u{i} AS (SELECT * FROM j{i} QUALIFY row_number() OVER (PARTITION BY gene, fwd_pos ORDER BY score DESC, rev_pos, fwd, rev) = 1)""")
        for rank in (1, 2, 3):
            far = "".join(f" AND (SELECT abs(x.fwd_pos - u.fwd_pos) FROM a{i}_{k} x WHERE x.gene = u.gene) > 30" for k in range(1, rank))
            out.append(f"a{i}_{rank} AS MATERIALIZED (SELECT u.*, {rank} AS rank FROM u{i} u WHERE TRUE{far} QUALIFY row_number() OVER (PARTITION BY gene ORDER BY score DESC, fwd_pos, rev_pos) = 1)")
        out.append(f"k{i} AS (SELECT *, {i} AS tier FROM (SELECT * FROM a{i}_1 UNION ALL SELECT * FROM a{i}_2 UNION ALL SELECT * FROM a{i}_3))")
    columns = "gene, fwd, round(fwd_tm, 6) + 0.0 AS fwd_tm, fwd_pos, rev, round(rev_tm, 6) + 0.0 AS rev_tm, rev_pos, amplicon, junction, round(score, 6) + 0.0 AS score, rank, tier"
    return ",\n".join(out) + " " + " UNION ALL ".join(f"SELECT {columns} FROM k{i}" for i in range(len(sq.TIERS)))


@query(primer_sql())
def p1_p3_p4_p5_design_primers(spark, v):
    rows = transcripts(v)
    return sq.design_primers(rows, rows.select("gene", F.array(F.lit(60), F.lit(120)).alias("ends")))


HITS = "ah AS (SELECT *, CASE WHEN se > ss THEN 'plus' ELSE 'minus' END AS strand, regexp_replace(q, '_[FR]$', '') AS gene, q[-1] AS side FROM v_hits WHERE pid >= 95 AND alen >= plen - 1 AND qe >= plen - 1)"


@query("WITH " + HITS + " SELECT q, s, strand, gene, side FROM ah")
def p6_annealing_hits(spark, v):
    return sq.annealing_hits(v("v_hits")).select("q", "s", "strand", "gene", "side")


PCR = HITS + """, pp AS (SELECT gene, s, count(*) FILTER (WHERE side = 'F' AND strand = 'plus') AS nf, count(*) FILTER (WHERE side = 'R' AND strand = 'minus') AS nr, max(ss) FILTER (WHERE side = 'R' AND strand = 'minus') - min(ss) FILTER (WHERE side = 'F' AND strand = 'plus') + 1 AS size FROM ah GROUP BY ALL),
pc AS (SELECT gene, CAST(sum(nf) AS BIGINT) AS n_f_sites, CAST(sum(nr) AS BIGINT) AS n_r_sites, count(*) FILTER (WHERE size BETWEEN 50 AND 2000) AS n_amplicons, coalesce(string_agg(CAST(s AS VARCHAR), ';' ORDER BY CAST(s AS VARCHAR)) FILTER (WHERE size BETWEEN 50 AND 2000), '') AS accessions FROM pp GROUP BY gene)"""


@query("WITH " + PCR + " SELECT gene, n_f_sites, n_r_sites, n_amplicons, accessions FROM pc")
def j4_in_silico_pcr(spark, v):
    return sq.in_silico_pcr(sq.annealing_hits(v("v_hits")))


@query("WITH " + PCR + ", ca AS (SELECT concat('g', p_partkey % 20) AS gene, p_partkey AS pair, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_retailprice DESC, p_partkey) AS rank, CASE WHEN p_partkey % 20 < 12 THEN 'target' ELSE 'reference' END AS role FROM part) SELECT gene, pair, role, n_amplicons AS n_isoforms_amplified, accessions FROM ca LEFT JOIN pc USING (gene) WHERE rank = 1")
def p7_final_assays(spark, v):
    r = F.row_number().over(Window.partitionBy(F.col("p_partkey") % 20).orderBy(F.desc("p_retailprice"), "p_partkey"))
    pairs = v("part").select(F.concat(F.lit("g"), (F.col("p_partkey") % 20).cast("string")).alias("gene"), F.col("p_partkey").alias("pair"), r.alias("rank"), F.when(F.col("p_partkey") % 20 < 12, "target").otherwise("reference").alias("role"))
    return sq.final_assays(pairs, sq.in_silico_pcr(sq.annealing_hits(v("v_hits")))).select("gene", "pair", "role", "n_isoforms_amplified", "accessions")


PAIRS = "lg AS (SELECT mol % 10 AS mol, x, y, z, atype FROM v_atoms WHERE mol % 3 = 0), rc AS (SELECT res, x, y, z, atype FROM v_atoms WHERE mol % 3 <> 0), dp AS (SELECT lg.mol, rc.res, lg.atype AS la, rc.atype AS ra, sqrt(pow(lg.x - rc.x, 2) + pow(lg.y - rc.y, 2) + pow(lg.z - rc.z, 2)) AS d FROM lg, rc)"


def atoms(v) -> tuple[DataFrame, DataFrame]:
    a = v("v_atoms")
    return a.where("mol % 3 = 0").withColumn("mol", F.col("mol") % 10), a.where("mol % 3 <> 0")


@query("WITH " + PAIRS + " SELECT mol, res, la AS ltype, ra AS atype, round(d, 6) + 0.0 AS d FROM dp WHERE d < 4.0")
def j5_atom_pairs(spark, v):
    lig, rec = atoms(v)
    return sc.atom_pairs(lig, rec).select("mol", "res", "ltype", "atype", "d")


@query("WITH " + PAIRS + """, ct AS (SELECT mol, res, min(d) AS d, bool_or(la IN ('N', 'NA', 'O', 'OA', 'S', 'SA') AND ra IN ('N', 'NA', 'O', 'OA', 'S', 'SA') AND d < 3.5) AS polar FROM dp WHERE d < 4.0 GROUP BY ALL)
SELECT mol, string_agg(res, ';' ORDER BY d, res) AS contacts, coalesce(string_agg(res, ';' ORDER BY res) FILTER (WHERE polar), '') AS hbond_residues, CAST(count(*) AS INTEGER) AS n_contacts FROM ct GROUP BY mol""")
def c3_contacts(spark, v):
    lig, rec = atoms(v)
    return sc.contacts(sc.atom_pairs(lig, rec))


@query("""
WITH po AS (SELECT mol % 10 AS mol, mol AS atom, x, y, z FROM v_atoms WHERE mol % 3 = 0), rf AS (SELECT x, y, z FROM v_atoms WHERE mol % 3 <> 0),
nn AS (SELECT po.mol, po.atom, min(sqrt(pow(po.x - rf.x, 2) + pow(po.y - rf.y, 2) + pow(po.z - rf.z, 2))) AS d FROM po, rf GROUP BY ALL), ce AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM rf),
cp AS (SELECT po.mol, avg(po.x) AS x, avg(po.y) AS y, avg(po.z) AS z FROM po GROUP BY po.mol)
SELECT mol, round(avg(d), 6) + 0.0 AS mean_nn, round(max(d), 6) + 0.0 AS max_nn, round(any_value(sqrt(pow(cp.x - ce.x, 2) + pow(cp.y - ce.y, 2) + pow(cp.z - ce.z, 2))), 6) + 0.0 AS centroid_dist FROM nn JOIN cp USING (mol), ce GROUP BY mol""")
def j6_pose_distance(spark, v):
    a = v("v_atoms")
    return sc.pose_distance(a.where("mol % 3 = 0").select((F.col("mol") % 10).alias("mol"), F.col("mol").alias("atom"), "x", "y", "z"), a.where("mol % 3 <> 0"))


def scored(v) -> DataFrame:
    return v("v_ligands").select(F.col("name").alias("compound"), "score", "smiles", "id")


@query("WITH s AS (SELECT id AS compound, score FROM v_ligands WHERE score IS NOT NULL) SELECT compound, round(score, 6) + 0.0 AS score, control FROM (SELECT *, FALSE AS control FROM (SELECT * FROM s WHERE compound % 50 <> 7 ORDER BY score, compound LIMIT 20) UNION ALL SELECT *, TRUE FROM s WHERE compound % 50 = 7)")
def c1_top_hits(spark, v):
    s = v("v_ligands").select(F.col("id").alias("compound"), "score")
    return sc.top_hits(s, s.where("compound % 50 = 7").select("compound"))


@query("WITH s AS (SELECT name AS compound, avg(score) AS m, stddev_samp(score) AS sd, min(score) AS best FROM v_ligands GROUP BY name) SELECT compound, round(m, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(best, 6) + 0.0 AS best, coalesce(m < (SELECT m FROM s WHERE compound = 'cmp5'), FALSE) AS better FROM s")
def c2_replicate_summary(spark, v):
    return sc.replicate_summary(scored(v), "cmp5")


@query("WITH s AS (SELECT smiles, id, score, row_number() OVER (PARTITION BY smiles ORDER BY score NULLS FIRST, name, id) AS r FROM v_ligands) SELECT smiles, id FROM s WHERE r = 1")
def c4_first_of_structure(spark, v):
    return sc.first_of_structure(scored(v).withColumn("compound", F.struct("compound", "id"))).select("smiles", "id")


@query("WITH " + PAIRS + """, ct AS (SELECT DISTINCT mol, res FROM dp WHERE d < 4.0), b AS (SELECT DISTINCT mol FROM ct ORDER BY mol LIMIT 8) SELECT res, count(DISTINCT mol) AS n FROM ct WHERE mol IN (SELECT mol FROM b) GROUP BY res""")
def c4_contact_frequency(spark, v):
    lig, rec = atoms(v)
    found = sc.contacts(sc.atom_pairs(lig, rec)).select(F.col("mol").alias("compound"), F.col("mol").cast("double").alias("score"), "contacts")
    return sc.contact_frequency(found)
