"""Queries on the survival cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.functions.columns import rounded
from strandworks.operators import concordance as cc
from strandworks.operators import survival as sv
from strandworks.operators import trial as tr
from strandworks.plans import sql_parts as parts
from strandworks.plans.views import view, with_views

QUERIES: dict = {}
#: Years at which risks are read.
YEARS = 4.0


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (lambda spark, sf_dir, fn=fn: rounded(fn(spark, lambda v: view(spark, sf_dir, v))), with_views(sql) if sql else None)
        return fn

    return add


KM = """t AS (SELECT {by} time, sum(event) AS d, count(*) AS c FROM {src} GROUP BY ALL),
r AS (SELECT *, sum(c) OVER ({part} ORDER BY time DESC) AS n FROM t),
k AS (SELECT {by} time, exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER ({part} ORDER BY time)) * (1 - max(CASE WHEN d >= n THEN 1 ELSE 0 END) OVER ({part} ORDER BY time)) AS surv, n FROM r WHERE d > 0),
km AS (SELECT {by} 0.0 AS time, 1.0 AS surv, CAST(sum(c) AS DOUBLE) AS n_risk FROM t {group} UNION ALL SELECT {by} time, surv, CAST(n AS DOUBLE) FROM k)"""


def km_sql(src: str = "v_cohort", by: str = "") -> str:
    return KM.format(src=src, by=f"{by}, " if by else "", part=f"PARTITION BY {by}" if by else "", group=f"GROUP BY {by}" if by else "")


@query("WITH " + km_sql(by="stage") + " SELECT stage, round(time, 6) + 0.0 AS time, round(surv, 6) + 0.0 AS surv, round(n_risk, 6) + 0.0 AS n_risk FROM km")
def s1_km(spark, v):
    return sv.km(v("v_cohort"), ["stage"])


@query("WITH " + km_sql(by="stage") + f" SELECT stage, round(arg_max(surv, time), 6) + 0.0 AS surv FROM km WHERE time <= {YEARS} GROUP BY stage")
def s2_km_at(spark, v):
    return sv.km_at(v("v_cohort"), YEARS, ["stage"])


@query("WITH " + km_sql() + " SELECT c.id, round(c.time, 6) + 0.0 AS time, round((SELECT arg_max(km.surv, km.time) FROM km WHERE km.time <= c.time), 6) + 0.0 AS surv FROM v_cohort c")
def j2_asof_step(spark, v):
    cohort = v("v_cohort")
    return sv.asof_step(cohort.select("id", "time"), sv.km(cohort).select("time", "surv"), "surv").select("id", "time", "surv")


@query("""
WITH c AS (SELECT time, event, CASE WHEN stage = 'Stage I' THEN 1 ELSE 0 END AS g FROM v_cohort),
t AS (SELECT time, sum(event) AS d, count(*) AS c, sum(event * g) AS d1, sum(g) AS c1 FROM c GROUP BY time),
r AS (SELECT *, sum(c) OVER (ORDER BY time DESC) AS n, sum(c1) OVER (ORDER BY time DESC) AS n1 FROM t),
s AS (SELECT CAST(sum(d1) AS DOUBLE) AS observed, sum(d * n1 / n) AS expected, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS variance FROM r WHERE d > 0)
SELECT round(observed, 6) + 0.0 AS observed, round(expected, 6) + 0.0 AS expected, round(variance, 6) + 0.0 AS variance, round(pow(observed - expected, 2) / variance, 6) + 0.0 AS chi2, round(""" + parts.normal_p("(abs(observed - expected) / sqrt(variance))") + """, 6) + 0.0 AS p FROM s""")
def s3_logrank(spark, v):
    return sv.logrank(v("v_cohort").withColumn("group", (F.col("stage") == "Stage I").cast("int")))


@query("""
WITH x AS (SELECT time, event, (age - 55) / 10 AS a, risk / 5 AS b, 0.2 * (age - 55) / 10 - 0.1 * risk / 5 AS eta FROM v_cohort),
t AS (SELECT time, sum(event) AS d, sum(event * eta) AS e, sum(exp(eta)) AS s0, sum(exp(eta) * a) AS s1, sum(exp(eta) * b) AS s2, sum(event * a) AS ga, sum(event * b) AS gb FROM x GROUP BY time),
r AS (SELECT d, e, ga, gb, sum(s0) OVER w AS s0, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM t WINDOW w AS (ORDER BY time DESC))
SELECT round(sum(e - d * ln(s0)), 5) + 0.0 AS loglik, round(sum(ga - d * s1 / s0), 5) + 0.0 AS g_age, round(sum(gb - d * s2 / s0), 5) + 0.0 AS g_risk FROM r WHERE d > 0""")
def s4_cox_moments(spark, v):
    m = sv.cox_moments(scaled(v), ["a", "b"], [0.2, -0.1])
    return spark.createDataFrame([(round(m["loglik"], 5), *(round(float(g), 5) for g in m["gradient"]))], "loglik double, g_age double, g_risk double")


def scaled(v) -> DataFrame:
    return v("v_cohort").withColumn("a", (F.col("age") - 55) / 10).withColumn("b", F.col("risk") / 5)


SCALED = """x AS MATERIALIZED (SELECT id, time, event, (age - 55) / 10 AS a, risk / 5 AS b,
  CASE WHEN stage LIKE '%III%' OR stage LIKE '%IV%' THEN 'III-IV' WHEN stage LIKE '%II%' THEN 'II' WHEN stage LIKE '%Stage I%' THEN 'I' END AS stage FROM v_cohort)"""


def term(name: str, coef: str, variance: str, source: str) -> str:
    """One row of a summary of a Cox fit."""
    ends = [f"round(exp({coef} {sign} 1.96 * sqrt({variance})), 6) + 0.0 AS {label}" for sign, label in (("-", "lower"), ("+", "upper"))]
    return f"SELECT '{name}' AS term, round({coef}, 6) + 0.0 AS coef, round(exp({coef}), 6) + 0.0 AS hr, {', '.join(ends)}, round({parts.normal_p(f'({coef} / sqrt({variance}))')}, 6) + 0.0 AS p, CAST(n AS BIGINT) AS n FROM {source}"


STAGED = SCALED + ", y AS MATERIALIZED (SELECT time, event, a, b, CASE WHEN stage = 'II' THEN 1 ELSE 0 END AS s2, CASE WHEN stage = 'III-IV' THEN 1 ELSE 0 END AS s3 FROM x WHERE stage IS NOT NULL)"


@query("WITH " + STAGED + ", " + parts.cox("f", "y", ["a", "b", "s2", "s3"]) + " " + " UNION ALL ".join(term(t, f"b{i}", f"v{i}", "f") for i, t in enumerate(["a", "b", "stage_II", "stage_III-IV"])))
def s4_cox_summary(spark, v):
    return sv.cox_summary(scaled(v).withColumn("stage", tr.stage_group(F.col("stage"))), ["a", "b", "stage"])


@query("WITH " + SCALED + ", " + parts.cox("fa", "x", ["a"]) + ", " + parts.cox("fb", "x", ["b"]) + " " + " UNION ALL ".join(f"SELECT '{g}' AS gene, round(b0, 6) + 0.0 AS beta, round(sqrt(v0), 6) + 0.0 AS se, CAST(n AS BIGINT) AS n, (SELECT CAST(sum(event) AS DOUBLE) FROM x) AS events FROM f{g}" for g in "ab"))
def s4_cox_by_gene(spark, v):
    long = scaled(v).unpivot(["id", "time", "event"], ["a", "b"], "gene", "x")
    return sv.cox_by_gene(long, ["gene"])


@query("""
SELECT stage, CAST(count(*) AS DOUBLE) AS pairs, round(CAST(sum(CASE WHEN i.risk > j.risk THEN 1 WHEN i.risk = j.risk THEN 0.5 ELSE 0 END) AS DOUBLE), 6) + 0.0 AS agree,
  round(sum(CASE WHEN i.risk > j.risk THEN 1 WHEN i.risk = j.risk THEN 0.5 ELSE 0 END) / count(*), 6) + 0.0 AS cindex
FROM v_cohort i JOIN v_cohort j USING (stage) WHERE i.event = 1 AND j.time > i.time GROUP BY stage""")
def s5_cindex(spark, v):
    return cc.cindex(v("v_cohort"), by=["stage"])


@query()
def s6_cindex_ci(spark, v):
    return cc.cindex_ci(v("v_cohort"))


@query()
def s6_time_auc_ci(spark, v):
    return cc.time_auc_ci(v("v_cohort"), YEARS)


@query("WITH cc AS (SELECT time, 1 - event AS event FROM v_cohort), " + km_sql("cc") + f""",
w AS (SELECT c.risk, 1 / greatest(coalesce((SELECT arg_max(km.surv, km.time) FROM km WHERE km.time < c.time), 1.0), 1e-6) AS w FROM v_cohort c WHERE c.time <= {YEARS} AND c.event = 1),
z AS (SELECT risk FROM v_cohort WHERE time > {YEARS})
SELECT round(sum(w * (CASE WHEN w.risk > z.risk THEN 1 WHEN w.risk = z.risk THEN 0.5 ELSE 0 END)) / sum(w), 6) + 0.0 AS auc FROM w, z""")
def s7_time_auc(spark, v):
    return sv.time_auc(v("v_cohort"), YEARS)


@query()
def s8_lasso_cox(spark, v):
    rows = scaled(v).withColumn("c", (F.col("stage") != "Stage I").cast("double"))
    return sv.lasso_cox(rows, ["a", "b", "c"])


BASE = """t AS (SELECT time, sum(event) AS d, sum(exp(0.1 * risk / 5)) AS s FROM v_cohort GROUP BY time),
r AS (SELECT time, d, sum(s) OVER (ORDER BY time DESC) AS s0 FROM t), h AS (SELECT time, sum(d / s0) OVER (ORDER BY time) AS hazard FROM r WHERE d > 0)"""


def eta(v) -> DataFrame:
    return v("v_cohort").withColumn("eta", 0.1 * F.col("risk") / 5)


@query("WITH " + BASE + " SELECT round(time, 6) + 0.0 AS time, round(hazard, 6) + 0.0 AS hazard FROM h")
def s9_breslow_baseline(spark, v):
    return sv.breslow_baseline(eta(v))


PROB = BASE + f", p AS (SELECT *, 1 - exp(-coalesce((SELECT max(hazard) FROM h WHERE time <= {YEARS}), 0) * exp(0.1 * risk / 5)) AS prob FROM v_cohort)"


def risks(v) -> DataFrame:
    rows = eta(v)
    return sv.predict_risk_at(rows, sv.breslow_baseline(rows), YEARS)


@query("WITH " + PROB + " SELECT id, round(prob, 6) + 0.0 AS prob FROM p")
def s9_predicted_risk(spark, v):
    return risks(v).select("id", "prob")


@query("WITH " + SCALED + ", " + parts.cox("f", "x", ["a"]) + ", " + parts.cox("g", "x", ["a", "b"]) + f" SELECT CAST(f.n AS BIGINT) AS n, round(f.ll, 6) + 0.0 AS ll_base, round(g.ll, 6) + 0.0 AS ll_full, round(2 * (g.ll - f.ll), 6) + 0.0 AS chi2, round({parts.normal_p('sqrt(greatest(0.0, 2 * (g.ll - f.ll)))')}, 6) + 0.0 AS p FROM f, g")
def s10_likelihood_ratio(spark, v):
    return sv.likelihood_ratio(scaled(v), ["a"], ["b"])


FOLDS = 10


@query("WITH " + SCALED + f", xf AS MATERIALIZED (SELECT *, CAST(CAST('0x' || substr(md5('2026:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % {FOLDS} AS INTEGER) AS own FROM x), y AS MATERIALIZED (SELECT xf.*, fit FROM xf JOIN (SELECT unnest(range(0, {FOLDS})) AS fit) ON fit <> own), " + parts.cox("f", "y", ["a", "b"], by="fit") + f""",
bt AS (SELECT fit, time, sum(event) AS d, sum(exp(b0 * a + b1 * b)) AS s FROM y JOIN f USING (fit) GROUP BY ALL), br AS (SELECT fit, time, d, sum(s) OVER (PARTITION BY fit ORDER BY time DESC) AS s0 FROM bt),
bh AS (SELECT fit, coalesce(sum(d / s0) FILTER (WHERE time <= {YEARS} AND d > 0), 0) AS h0 FROM br GROUP BY fit)
SELECT id, own AS fold, round(1 - exp(-h0 * exp(b0 * a + b1 * b)), 6) + 0.0 AS prob FROM xf JOIN f ON f.fit = own JOIN bh ON bh.fit = own""")
def s10_cross_validated_risk(spark, v):
    return sv.cross_validated_risk(scaled(v), ["a", "b"], YEARS, FOLDS).select("id", "fold", "prob")


@query("WITH " + PROB + """, q AS (SELECT quantile_cont(prob, [0.2, 0.4, 0.6, 0.8]) AS e FROM p),
b AS (SELECT p.*, len(list_filter((SELECT e FROM q), lambda x: prob > x)) AS bin FROM p), """ + KM.format(src="b", by="bin, ", part="PARTITION BY bin", group="GROUP BY bin").replace("t AS", "t2 AS").replace("FROM t", "FROM t2").replace("r AS", "r2 AS").replace("FROM r ", "FROM r2 ") + f""",
s AS (SELECT bin, arg_max(surv, time) AS surv FROM km WHERE time <= {YEARS} GROUP BY bin)
SELECT CAST(bin AS INTEGER) AS bin, round(avg(prob), 6) + 0.0 AS predicted, round(1 - any_value(surv), 6) + 0.0 AS observed, count(*) AS n FROM b JOIN s USING (bin) GROUP BY bin""")
def s11_calibration(spark, v):
    return sv.calibration(risks(v).withColumn("prob", F.round("prob", 9)), YEARS)


THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 17)]


@query("WITH x AS (SELECT time, event, round((risk + 1) / 12, 9) AS prob FROM v_cohort), th AS (SELECT unnest(" + str(THRESHOLDS) + """::DOUBLE[]) AS threshold),
b AS (SELECT threshold, time, event FROM th JOIN x ON x.prob >= threshold UNION ALL SELECT -1, time, event FROM x), """ + KM.format(src="b", by="threshold, ", part="PARTITION BY threshold", group="GROUP BY threshold") + f""",
s AS (SELECT threshold, arg_max(surv, time) AS s, max(n_risk) AS n FROM km WHERE time <= {YEARS} GROUP BY threshold), a AS (SELECT s, n FROM s WHERE threshold = -1)
SELECT round(th.threshold, 6) + 0.0 AS threshold, round(coalesce(((1 - s.s) - s.s * th.threshold / (1 - th.threshold)) * s.n / (SELECT n FROM a), 0), 6) + 0.0 AS net_benefit,
  round((1 - (SELECT s FROM a)) - (SELECT s FROM a) * th.threshold / (1 - th.threshold), 6) + 0.0 AS treat_all FROM th LEFT JOIN s ON s.threshold = th.threshold""")
def s12_net_benefit(spark, v):
    return sv.net_benefit(v("v_cohort").withColumn("prob", F.round((F.col("risk") + 1) / 12, 9)), YEARS, THRESHOLDS)


@query("SELECT user_id, round(min(value) FILTER (WHERE event_type = 'click'), 6) + 0.0 AS click, round(min(value) FILTER (WHERE event_type = 'purchase'), 6) + 0.0 AS purchase FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def s13_eav_cohort(spark, v):
    eav = v("events").select("user_id", F.col("event_type").alias("attr"), "value")
    return tr.eav_cohort(eav, "user_id", ["click", "purchase"])
