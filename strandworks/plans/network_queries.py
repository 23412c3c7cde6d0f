"""Queries on interaction networks, feature votes and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.functions.columns import rounded
from strandworks.functions.storage import cut
from strandworks.operators import concordance as cc
from strandworks.operators import expression as ex
from strandworks.operators import models as md
from strandworks.operators import network as nw
from strandworks.operators.graph import connected_components
from strandworks.plans.views import view, with_views

QUERIES: dict = {}
#: Score from which the driver's pairs are an edge: below it cliques multiply.
LEAST = 0.7


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (lambda spark, sf_dir, fn=fn: rounded(fn(spark, lambda v: view(spark, sf_dir, v))), with_views(sql) if sql else None)
        return fn

    return add


EDGES = f"e AS (SELECT a AS src, b AS dst, score AS weight FROM v_pairs WHERE score >= {LEAST})"
BOTH = EDGES + ", w AS (SELECT src AS v, dst AS w FROM e UNION ALL SELECT dst, src FROM e)"
PARTS = BOTH + ", reach AS (SELECT v, v AS r FROM (SELECT DISTINCT v FROM w) UNION SELECT w.w, reach.r FROM reach JOIN w ON w.v = reach.v), parts AS (SELECT v AS vertex, min(r) AS component FROM reach GROUP BY v)"


def edges(v) -> DataFrame:
    return cut(nw.undirected_edges(v("v_pairs"), LEAST))


@query("WITH " + EDGES + " SELECT src, dst, round(weight, 6) + 0.0 AS weight FROM e")
def n1_edges(spark, v):
    return nw.undirected_edges(v("v_pairs"), LEAST)


@query("WITH RECURSIVE " + PARTS + " SELECT vertex, component FROM parts")
def n2_components(spark, v):
    return connected_components(edges(v))


@query("WITH RECURSIVE " + PARTS + ", best AS (SELECT component FROM parts GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT src, dst FROM e WHERE src IN (SELECT vertex FROM parts WHERE component = (SELECT component FROM best))")
def n2_largest_component(spark, v):
    return nw.largest_component(edges(v)).select("src", "dst")


@query("WITH " + BOTH + " SELECT v, count(*) AS degree FROM w GROUP BY v")
def n3_degree(spark, v):
    return nw.degree(edges(v))


#: The largest component's edges both ways, in tables of their own: g (edges), u (both ways), adj (neighbours).
LARGEST = PARTS + """, best AS (SELECT component FROM parts GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
g AS (SELECT src, dst FROM e WHERE src IN (SELECT vertex FROM parts WHERE component = (SELECT component FROM best))), u AS (SELECT src AS v, dst AS w FROM g UNION ALL SELECT dst, src FROM g), adj AS (SELECT v, list(w) AS ns FROM u GROUP BY v)"""
#: All cliques by adding ever larger vertices; a maximal one has no vertex adjacent to all of it.
CLIQUES = """, q AS (SELECT [least(src, dst), greatest(src, dst)] AS c FROM g UNION ALL SELECT list_append(q.c, u.w) FROM q JOIN u ON u.v = q.c[len(q.c)] AND u.w > u.v JOIN adj ON adj.v = u.w WHERE len(list_intersect(q.c, adj.ns)) = len(q.c)),
wider AS (SELECT DISTINCT q.c FROM q JOIN u ON u.v = q.c[1] JOIN adj ON adj.v = u.w WHERE len(list_intersect(q.c, adj.ns)) = len(q.c)),
mcc AS (SELECT v, CAST(sum(factorial(CAST(n - 1 AS INTEGER))) AS DOUBLE) AS mcc FROM (SELECT unnest(c) AS v, len(c) AS n FROM q ANTI JOIN wider USING (c)) GROUP BY v)"""
#: Hops in the component; more than FAR are not looked for (no vertex of the driver's graph is so far from another).
FAR = 12
REACH = f""", hop AS (SELECT v AS s, v, 0 AS h FROM adj UNION SELECT hop.s, u.w, hop.h + 1 FROM hop JOIN u ON u.v = hop.v WHERE hop.h < {FAR}), near AS (SELECT s, v, min(h) AS h FROM hop GROUP BY ALL),
clo AS (SELECT s AS v, (count(*) - 1) / nullif(sum(h), 0) AS closeness FROM near GROUP BY s)"""
PATHS = ", p0 AS (SELECT v AS s, v, 1.0::DOUBLE AS n FROM adj)" + "".join(f", p{i} AS (SELECT p.s, u.w AS v, sum(p.n) AS n FROM p{i - 1} p JOIN u ON u.v = p.v JOIN near k ON k.s = p.s AND k.v = u.w AND k.h = {i} GROUP BY ALL)" for i in range(1, FAR + 1))
BETWEEN = PATHS + ", ways AS (" + " UNION ALL ".join(f"SELECT s, v, n, {i} AS h FROM p{i}" for i in range(FAR + 1)) + """),
thru AS (SELECT a.v, sum(a.n * b.n / t.n) AS b FROM ways t JOIN ways a ON a.s = t.s AND a.v <> t.s AND a.v <> t.v JOIN ways b ON b.s = a.v AND b.v = t.v AND a.h + b.h = t.h WHERE t.s <> t.v GROUP BY a.v),
btw AS (SELECT v, coalesce(b, 0) / ((SELECT count(*) FROM adj) - 1) / ((SELECT count(*) FROM adj) - 2) AS betweenness FROM adj LEFT JOIN thru USING (v))"""


def largest(v) -> DataFrame:
    return cut(nw.largest_component(edges(v)))


@query("WITH RECURSIVE " + LARGEST + CLIQUES + " SELECT v, mcc FROM mcc")
def n4_mcc(spark, v):
    return nw.cliques_by_vertex(largest(v))


@query("WITH RECURSIVE " + LARGEST + REACH + BETWEEN + " SELECT v, round(betweenness, 6) + 0.0 AS betweenness FROM btw")
def n5_betweenness(spark, v):
    return nw.betweenness(largest(v))


HOPS = BOTH + f""", hop AS (SELECT v AS s, v, 0 AS h FROM (SELECT DISTINCT v FROM w) UNION SELECT hop.s, w.w, hop.h + 1 FROM hop JOIN w ON w.v = hop.v WHERE hop.h < {FAR}),
near AS (SELECT s, v, min(h) AS h FROM hop GROUP BY ALL)"""


@query("WITH RECURSIVE " + HOPS + " SELECT s AS v, round((count(*) - 1) / nullif(sum(h), 0), 6) + 0.0 AS closeness FROM near GROUP BY s")
def n6_closeness(spark, v):
    return nw.closeness(edges(v))


#: Vertices of each measure that count, and in how many measures a hub must be among them; fixed values.
TOP, MEASURES = 20, 3
HUBS = LARGEST + CLIQUES + REACH + BETWEEN + f""", m AS (SELECT v, CAST(len(ns) AS DOUBLE) AS degree, coalesce(mcc, 0) AS mcc, round(coalesce(betweenness, 0), 9) AS betweenness, round(coalesce(closeness, 0), 9) AS closeness FROM adj LEFT JOIN mcc USING (v) LEFT JOIN btw USING (v) LEFT JOIN clo USING (v)),
l AS (SELECT v, k, row_number() OVER (PARTITION BY k ORDER BY x DESC, v) AS r FROM m UNPIVOT (x FOR k IN (degree, mcc, betweenness, closeness))),
n AS (SELECT v, count(*) AS n FROM l WHERE r <= {TOP} GROUP BY v), h AS (SELECT v, coalesce(n, 0) AS n_top, coalesce(n, 0) >= {MEASURES} AS hub FROM m LEFT JOIN n USING (v))"""


def hubs(v) -> DataFrame:
    """Hubs of the largest component by its four centralities; ties below the ninth digit go by vertex."""
    names = ["degree", "mcc", "betweenness", "closeness"]
    measured = nw.centralities(largest(v)).select("v", *(F.round(c, 9).alias(c) for c in names))
    return nw.hubs(cut(measured), names, TOP, MEASURES).select("v", "n_top", "hub")


@query("WITH RECURSIVE " + HUBS + " SELECT v, n_top, hub FROM h")
def n7_hubs(spark, v):
    return hubs(v)


@query("WITH RECURSIVE " + HUBS + ", close AS (SELECT v FROM h WHERE hub UNION SELECT u.w FROM u JOIN h ON u.v = h.v WHERE hub) SELECT src, dst FROM g WHERE src IN (SELECT v FROM close) AND dst IN (SELECT v FROM close)")
def n8_hub_subnetwork(spark, v):
    return nw.hub_subnetwork(largest(v), hubs(v).where("hub")).select("src", "dst")


@query("""
WITH a AS (SELECT gene, min(p) AS o FROM v_tests WHERE p < 0.02 GROUP BY gene), b AS (SELECT gene, min(-abs(b)) AS o FROM v_tests GROUP BY gene ORDER BY o, gene LIMIT 30),
u AS (SELECT gene, min(struct_pack(part := part, o := o)) AS o FROM (SELECT gene, 0 AS part, o FROM a UNION ALL SELECT gene, 1, o FROM b) GROUP BY gene)
SELECT gene, CAST(row_number() OVER (ORDER BY o, gene) AS INTEGER) AS place FROM u""")
def n9_candidate_list(spark, v):
    tests = v("v_tests")
    return nw.candidate_list(tests.where("p < 0.02").groupBy("gene").agg(F.min("p").alias("order")), tests.groupBy("gene").agg(F.min(-F.abs("b")).alias("order")))


VOTES = """s AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'lasso' WHEN p_partkey % 3 = 1 THEN 'svm' ELSE 'forest' END AS selector, p_partkey // 3 % 200 AS gene FROM part WHERE p_size % 2 = 0),
n AS (SELECT gene, count(*) AS votes FROM s GROUP BY gene)"""


@query("WITH " + VOTES + " SELECT gene, votes, votes >= CASE WHEN (SELECT max(votes) FROM n) = 3 THEN 3 ELSE 2 END AS core FROM n")
def a16_votes(spark, v):
    s = F.when(F.col("p_partkey") % 3 == 0, "lasso").when(F.col("p_partkey") % 3 == 1, "svm").otherwise("forest")
    return md.votes(v("part").where("p_size % 2 = 0").select(s.alias("selector"), F.expr("p_partkey div 3 % 200").alias("gene")), 3)


def counted(v):
    """Views whose counts, a row for each gene and sample, are summed once from the large tables and kept."""
    counts = cut(v("v_counts"))
    kept = {"v_counts": counts, "v_meta": counts.select("dataset", "sample", "grp", "cell").distinct()}
    return lambda name: kept[name] if name in kept else v(name)


def labelled(v) -> tuple[DataFrame, list[str]]:
    """Centred and scaled log expression of the robust genes, one row a sample."""
    from strandworks.plans.expression_queries import expressed, robust

    v = counted(v)
    genes = sorted(str(r.gene) for r in robust(v).select("gene").collect())  # the flagship's short list, a column each
    z = ex.zscore(ex.batch_center(expressed(v).where(F.col("gene").cast("string").isin(genes)).select(F.col("gene").cast("string").alias("gene"), "sample", "value"), v("v_meta").select("sample", (F.col("dataset") * 10 + F.col("cell")).alias("batch"))))
    meta = v("v_meta").select(F.col("sample").alias("id"), F.col("grp").cast("int").alias("y"), "dataset")
    return cut(md.wide(z.withColumn("z", F.coalesce("z", F.lit(0.0))), genes).join(meta, "id")), genes


#: Two eigenvectors of the samples' Gram matrix by repeated products; the second after the first is taken out.
POWER = 4000
PCA = f"""pv AS (SELECT gene, sample, value - avg(value) OVER (PARTITION BY gene) AS c FROM cpm JOIN (SELECT gene FROM cpm GROUP BY gene ORDER BY var_samp(value) DESC, gene LIMIT 2000) USING (gene)),
pg AS (SELECT a.sample AS s, b.sample AS t, sum(a.c * b.c) AS g FROM pv a JOIN pv b ON a.gene = b.gene GROUP BY ALL),
pf AS (SELECT p.sample AS s, q.sample AS t, coalesce(g, 0) AS g FROM (SELECT DISTINCT sample FROM pv) p CROSS JOIN (SELECT DISTINCT sample FROM pv) q LEFT JOIN pg ON pg.s = p.sample AND pg.t = q.sample),
pm AS (SELECT list(r ORDER BY s) AS m, list(s ORDER BY s) AS names, sum(r[i]) AS trace FROM (SELECT s, list(g ORDER BY t) AS r, row_number() OVER (ORDER BY s) AS i FROM pf GROUP BY s)),
w1 AS (SELECT 0 AS i, m, list_transform(m, lambda r: CAST(1 + 0.01 * list_position(m, r) AS DOUBLE)) AS v FROM pm UNION ALL SELECT i + 1, m, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y)))) FROM (SELECT i, m, list_transform(m, lambda r: list_dot_product(r, v)) AS u FROM w1 WHERE i < {POWER})),
e1 AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS size FROM w1 WHERE i = {POWER}),
pd AS (SELECT list_transform(range(1, len(m) + 1), lambda a: list_transform(range(1, len(m) + 1), lambda b: m[a][b] - size * v[a] * v[b])) AS m FROM pm, e1),
w2 AS (SELECT 0 AS i, m, list_transform(m, lambda r: CAST(1 + 0.01 * list_position(m, r) AS DOUBLE)) AS v FROM pd UNION ALL SELECT i + 1, m, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y)))) FROM (SELECT i, m, list_transform(m, lambda r: list_dot_product(r, v)) AS u FROM w2 WHERE i < {POWER})),
e2 AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS size FROM w2 WHERE i = {POWER}),
sg AS (SELECT v, size, CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END AS sign FROM {{}})"""


def components(v):
    from strandworks.plans.expression_queries import expressed

    return md.pca_scores(expressed(v).select("gene", "sample", "value"), v("v_meta").select("sample", "dataset", "grp"))


def pca_sql() -> str:
    from strandworks.plans.expression_queries import CPM, FACTORS, KEPT

    parts, last = PCA.split("sg AS ")
    signs = ", ".join("s" + str(i) + " AS " + last.format(f"e{i}") for i in (1, 2))
    score = ", ".join(f"round(s{i}.v[k] * sqrt(s{i}.size) * s{i}.sign, 5) + 0.0 AS pc{i}" for i in (1, 2))
    return "WITH RECURSIVE " + ",".join([KEPT, FACTORS, CPM]) + ", " + parts + signs + f", sc AS (SELECT names[k] AS sample, {score} FROM s1, s2, (SELECT names, unnest(range(1, len(names) + 1)) AS k FROM pm)) "


@query(pca_sql() + "SELECT sc.*, dataset, grp FROM sc JOIN v_meta USING (sample)")
def a17_pca(spark, v):
    scores = components(v)[0]
    return scores.withColumns({c: F.round(c, 5) for c in ("pc1", "pc2")})


@query(pca_sql() + "SELECT 1 AS component, round(size / trace, 6) + 0.0 AS share FROM e1, pm UNION ALL SELECT 2, round(size / trace, 6) + 0.0 FROM e2, pm")
def a17_explained(spark, v):
    return spark.createDataFrame(list(enumerate(components(v)[1], 1)), "component int, share double")


#: Costs of the path: 60 over five powers of ten; fixed values.
COSTS = [10 ** (-3 + 5 * i / 59) for i in range(60)]


@query()
def m1_l1_path(spark, v):
    df, genes = labelled(v)
    return md.l1_path(df, genes, COSTS)


@query()
def m2_svm_rfe(spark, v):
    df, genes = labelled(v)
    return md.svm_rfe_cv(df, genes, 30, k=10)


@query()
def m3_boruta(spark, v):
    df, genes = labelled(v)
    return md.boruta(df, genes)


@query()
def m4_permutation_importance(spark, v):
    df, genes = labelled(v)
    return md.permutation_importance(df, genes, repeats=50)


AUC = "s AS (SELECT dataset, p, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 0) AS b FROM v_pred GROUP BY ALL), t AS (SELECT *, sum(b) OVER (PARTITION BY dataset ORDER BY p) - b AS below FROM s)"


@query("WITH " + AUC + " SELECT dataset, round(sum(a * (below + b / 2.0)) / (sum(a) * sum(b)), 6) + 0.0 AS auc FROM t GROUP BY dataset")
def m5_auc(spark, v):
    return md.auc(v("v_pred"), by=["dataset"])


@query()
def m6_auc_ci(spark, v):
    return cc.auc_ci(v("v_pred"))


def ridge_sql(rounds: int = 9) -> str:
    """Newton's method for the ridge logistic model without each dataset; its equations are eliminated row by row."""
    from strandworks.plans.expression_queries import CPM, FACTORS, FIT, KEPT, RANK, RRA

    out = [*(x.strip() for x in (KEPT, FACTORS, CPM, FIT, RANK, RRA)), """
rb AS (SELECT DISTINCT gene FROM rra JOIN eff USING (gene) WHERE score < 0.05 AND abs(mean_lfc) > 1 AND consistent AND (direction = 'Up') = (mean_lfc > 0)),
fg AS (SELECT gene FROM cpm JOIN rb USING (gene) GROUP BY gene HAVING count(DISTINCT sample) = (SELECT count(DISTINCT sample) FROM v_meta)),
cb AS (SELECT gene, c.sample, value - avg(value) OVER (PARTITION BY c.dataset, m.cell, gene) AS c FROM cpm c JOIN fg USING (gene) JOIN v_meta m USING (sample)),
zz AS (SELECT gene, sample, coalesce((c - avg(c) OVER (PARTITION BY gene)) / nullif(stddev_samp(c) OVER (PARTITION BY gene), 0), 0) AS z FROM cb),
lx AS MATERIALIZED (SELECT z.sample AS id, any_value(grp) AS y, any_value(dataset) AS own, list_append(list(z ORDER BY CAST(gene AS VARCHAR)), 1.0) AS x FROM zz z JOIN v_meta USING (sample) GROUP BY z.sample),
b0 AS (SELECT DISTINCT l.own AS fit, list_transform(r.x, lambda v: 0.0::DOUBLE) AS b FROM lx l, (SELECT x FROM lx LIMIT 1) r)"""]
    for r in range(rounds):
        out.append(f"""
q{r} AS MATERIALIZED (SELECT fit, b, x, 2 * y - 1 AS s, 1 / (1 + exp((2 * y - 1) * list_dot_product(x, b))) AS q FROM lx JOIN b{r} ON fit <> own),
h{r} AS (SELECT fit, i, j, sum(q * (1 - q) * x[i] * x[j]) + any_value(CASE WHEN i <> j THEN 0 WHEN i < len(b) THEN 1 ELSE 1e-6 END) AS h FROM q{r}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM lx))) AS i), (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM lx))) AS j) GROUP BY fit, i, j
  UNION ALL SELECT fit, i, 1000 AS j, sum(-s * q * x[i]) + any_value(CASE WHEN i < len(b) THEN b[i] ELSE 0 END) FROM q{r}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM lx))) AS i) GROUP BY fit, i),
e{r} AS (SELECT fit, 1 AS k, list(w ORDER BY i) AS m FROM (SELECT fit, i, list(h ORDER BY j) AS w FROM h{r} GROUP BY fit, i) GROUP BY fit
  UNION ALL SELECT fit, k + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k THEN v ELSE list_transform(range(1, len(v) + 1), lambda j: m[i][j] - m[i][k] * v[j]) END) FROM (SELECT fit, k, m, list_transform(m[k], lambda z: z / m[k][k]) AS v FROM e{r} WHERE k <= len(m))),
b{r + 1} AS MATERIALIZED (SELECT fit, list_transform(range(1, len(b) + 1), lambda i: b[i] - m[i][len(b) + 1]) AS b FROM b{r} JOIN e{r} USING (fit) WHERE k = len(b) + 1)""")
    return "WITH RECURSIVE " + ", ".join(out) + f" SELECT id, CAST(y AS INTEGER) AS y, own AS dataset, round(1 / (1 + exp(-list_dot_product(x, b))), 5) + 0.0 AS p FROM lx JOIN b{rounds} ON fit = own"


@query(ridge_sql())
def m7_leave_one_dataset_out(spark, v):
    df, genes = labelled(v)
    return md.predict_folds(df, genes, "dataset").withColumn("p", F.round("p", 5))


@query()
def m8_nested_lodo(spark, v):
    from strandworks.plans.expression_queries import expressed, ordered

    v = counted(v)
    meta = v("v_meta")
    labels = meta.select("sample", "dataset", F.col("grp").cast("int").alias("y"))
    return md.nested_lodo(cut(ordered(v).select("dataset", "gene", "b", "p")), cut(expressed(v).select("gene", "sample", "value")), meta.select("sample", (F.col("dataset") * 10 + F.col("cell")).alias("batch")), labels, most=40, top=12, costs=tuple(COSTS[::3]), rounds=20)


@query("""
WITH s AS (SELECT p, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y = 0) AS b FROM v_pred GROUP BY p)
SELECT round(p, 6) + 0.0 AS threshold, round(sum(a) OVER w / sum(a) OVER (), 6) + 0.0 AS tpr, round(sum(b) OVER w / sum(b) OVER (), 6) + 0.0 AS fpr FROM s WINDOW w AS (ORDER BY p DESC)""")
def m9_roc_points(spark, v):
    return md.roc_points(v("v_pred"))
