"""Gene-wise statistics on long count and expression tables.

A matrix is a long table (dataset, gene, sample, value). Sample metadata are (dataset, sample, grp, ...) with grp 1
for the group of interest and 0 for the other. Nothing is pivoted to one column a sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.columns import clean, known
from strandworks.functions.tails import digamma, inverse_trigamma, t_pvalue, trigamma

FLOOR = 1e-12


def protein_coding(counts: DataFrame, annotation: DataFrame, kind: str = "protein-coding") -> DataFrame:
    """Counts of genes of one kind under their symbols; ids of one symbol are summed. Ids without annotation go."""
    named = annotation.where(F.col("gene_type") == kind).select("gene_id", "symbol").distinct()
    return counts.join(named, "gene_id").groupBy("dataset", F.col("symbol").alias("gene"), "sample").agg(F.sum("count").alias("count"))


def collapse(matrix: DataFrame, how: str = "mean", value: str = "value") -> DataFrame:
    """One value a (dataset, gene, sample): the mean or the sum of repeated rows."""
    agg = {"mean": F.avg, "sum": F.sum}[how]
    return matrix.groupBy("dataset", "gene", "sample").agg(agg(clean(F.col(value))).alias(value))


def low_count_filter(counts: DataFrame, meta: DataFrame, least: float = 10) -> DataFrame:
    """Genes with a count of at least ``least`` in as many samples as the smaller group of their dataset has."""
    small = meta.groupBy("dataset", "grp").count().groupBy("dataset").agg(F.min("count").alias("smaller"))
    kept = counts.groupBy("dataset", "gene").agg(F.count_if(F.col("count") >= least).alias("n")).join(F.broadcast(small), "dataset").where(F.col("n") >= F.col("smaller")).select("dataset", "gene")
    return counts.join(kept, ["dataset", "gene"], "left_semi")


def size_factors(counts: DataFrame) -> DataFrame:
    """Median of ratios by sample; a gene's geometric mean is over its positive counts."""
    logs = counts.where(F.col("count") > 0).select("dataset", "gene", "sample", F.ln("count").alias("l"))
    geo = logs.groupBy("dataset", "gene").agg(F.avg("l").alias("g"))
    return logs.join(geo, ["dataset", "gene"]).groupBy("dataset", "sample").agg(F.exp(F.median(F.col("l") - F.col("g"))).alias("size_factor"))


def log_cpm(counts: DataFrame, factors: DataFrame, prior: float = 1.0) -> DataFrame:
    """log2 of counts over size factor, per million of the dataset's mean library. Filter genes before."""
    lib = counts.groupBy("dataset", "sample").agg(F.sum("count").alias("lib")).groupBy("dataset").agg(F.avg("lib").alias("lib"))
    scaled = counts.join(factors, ["dataset", "sample"]).join(F.broadcast(lib), "dataset")
    return scaled.select("dataset", "gene", "sample", F.log2(F.col("count") / F.col("size_factor") / F.col("lib") * 1e6 + prior).alias("value"))


def lm_fit(matrix: DataFrame, design: DataFrame, columns: list[str], coef: int) -> DataFrame:
    """Least squares of every gene on the design's columns.

    ``design``: dataset, sample and ``columns`` (few, numeric, an intercept among them). Columns that are constant in
    a dataset beside the intercept are left out there. X'X is p x p and is inverted on the driver; genes are one
    aggregate of sums. Returns dataset, gene, b (the coefficient ``coef``), s2, df, unscaled and ave_expr.
    """
    p = len(columns)
    products = [F.sum(F.col(a).cast("double") * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    rows = design.groupBy("dataset").agg(*products, *(F.stddev_pop(F.col(c).cast("double")).alias(f"sd{i}") for i, c in enumerate(columns)), F.count("*").alias("n")).collect()
    spark, weights = design.sparkSession, []
    for r in rows:
        xtx = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        used = [i for i in range(p) if r[f"sd{i}"] > 0 or i == 0]
        inverse = np.zeros((p, p))
        inverse[np.ix_(used, used)] = np.linalg.inv(xtx[np.ix_(used, used)])
        weights.append((r["dataset"], int(r["n"]) - len(used), float(inverse[coef, coef]), [float(v) for v in inverse.ravel()]))
    kind = design.schema["dataset"].dataType.simpleString()
    table = F.broadcast(spark.createDataFrame(weights, f"dataset {kind}, df int, unscaled double, inv array<double>"))
    sums = matrix.join(F.broadcast(design), ["dataset", "sample"]).groupBy("dataset", "gene").agg(*(F.sum(F.col("value") * F.col(c)).alias(f"xy{i}") for i, c in enumerate(columns)), F.sum(F.col("value") * F.col("value")).alias("yy"), F.avg("value").alias("ave_expr"))
    b = [sum((F.col("inv")[i * p + j] * F.col(f"xy{j}") for j in range(p)), F.lit(0.0)) for i in range(p)]
    fit = sums.join(table, "dataset").withColumns({f"b{i}": x for i, x in enumerate(b)})
    rss = F.col("yy") - sum((F.col(f"b{i}") * F.col(f"xy{i}") for i in range(p)), F.lit(0.0))
    return fit.select("dataset", "gene", F.col(f"b{coef}").alias("b"), (F.greatest(rss, F.lit(0.0)) / F.col("df")).alias("s2"), "df", "unscaled", "ave_expr")


def squeeze_var(fit: DataFrame) -> DataFrame:
    """Variances shrunk to a common prior, moment-matched on their logarithms by dataset: adds d0, s02 and s2_post.

    d0 is infinite (null here) where the spread is no wider than chance; then every variance is the prior.
    """
    z = F.ln(F.greatest(F.col("s2"), F.lit(FLOOR)))
    moments = fit.groupBy("dataset", "df").agg(F.avg(z).alias("m"), F.var_samp(z).alias("v")).collect()
    prior = []
    for r in moments:
        centre = r.m - digamma(r.df / 2) + np.log(r.df / 2)
        extra = (r.v or 0.0) - trigamma(r.df / 2)
        if extra > 0:
            d0 = 2 * inverse_trigamma(extra)
            prior.append((r.dataset, float(d0), float(np.exp(centre + digamma(d0 / 2) - np.log(d0 / 2)))))
        else:
            prior.append((r.dataset, None, float(np.exp(centre))))
    kind = fit.schema["dataset"].dataType.simpleString()
    table = fit.sparkSession.createDataFrame(prior, f"dataset {kind}, d0 double, s02 double")
    s2 = F.greatest(F.col("s2"), F.lit(FLOOR))
    return fit.join(F.broadcast(table), "dataset").withColumn("s2_post", F.when(F.col("d0").isNull(), F.col("s02")).otherwise((F.col("d0") * F.col("s02") + F.col("df") * s2) / (F.col("d0") + F.col("df"))))


def moderated_t(fit: DataFrame) -> DataFrame:
    """Adds t and its two-sided p with the prior's degrees of freedom."""
    out = fit.withColumn("t", F.col("b") / F.sqrt(F.col("s2_post") * F.col("unscaled")))
    return out.withColumn("p", t_pvalue(F.col("t"), F.col("df") + F.coalesce("d0", F.lit(1e6))))


def bh_fdr(df: DataFrame, by: list[str], p: str = "p", out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg within groups; rows with a null p keep a null.

    Tests are ranked by distinct p: counts and running sums run over distinct values, ties share one value.
    """
    keys = [F.col(c) for c in by] or [F.lit(0)]
    tests = df.where(F.col(p).isNotNull())
    steps = tests.groupBy(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col(p).alias("p0")).agg(F.count("*").alias("c"))
    names = [f"k{i}" for i in range(len(keys))]
    up = Window.partitionBy(*names).orderBy("p0").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*names).orderBy(F.desc("p0")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("c").over(Window.partitionBy(*names))
    q = steps.withColumn("q", F.col("p0") * total / F.sum("c").over(up)).withColumn("q", F.least(F.min("q").over(down), F.lit(1.0))).select(*names, "p0", F.col("q").alias(out))
    match = F.col(p) == F.col("p0")
    for k, name in zip(keys, names, strict=True):
        match = match & k.eqNullSafe(F.col(name))
    return df.join(q, match, "left").drop(*names, "p0")


def de_call(tests: DataFrame, fdr: float = 0.05, lfc: float = 1.0) -> DataFrame:
    """Adds sig: Up, Down or NS."""
    hit = F.col("fdr") < fdr
    return tests.withColumn("sig", F.when(known(hit & (F.col("b") > lfc)), "Up").when(known(hit & (F.col("b") < -lfc)), "Down").otherwise("NS"))


def volcano_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("dataset", "sig").agg(F.count("*").alias("n"))


def universe(tests: DataFrame) -> DataFrame:
    """Genes that every dataset tests."""
    k = tests.select("dataset").distinct().count()
    return tests.groupBy("gene").agg(F.count_distinct("dataset").alias("k")).where(F.col("k") == k).select("gene")


def rank_lists(tests: DataFrame, genes: DataFrame, order: str = "p") -> DataFrame:
    """(direction, dataset, gene, rank): genes of one sign by ``order``, ties by gene."""
    signed = tests.join(genes, "gene", "left_semi").withColumn("direction", F.when(F.col("b") > 0, "Up").when(F.col("b") < 0, "Down")).where(F.col("direction").isNotNull())
    return signed.withColumn("rank", F.row_number().over(Window.partitionBy("direction", "dataset").orderBy(order, "gene"))).select("direction", "dataset", "gene", "rank")


def rra(lists: DataFrame, n: int, datasets: int) -> DataFrame:
    """Robust rank aggregation: the smallest beta tail of a gene's ordered ranks, times the number of lists.

    A list without the gene counts as rank n. The tail of the k-th of K ranks is a sum of binomial terms.
    """
    k = datasets
    ranks = F.array_sort(F.collect_list(F.col("rank") / F.lit(float(n))))
    held = lists.groupBy("direction", "gene").agg(ranks.alias("r")).withColumn("r", F.concat("r", F.array_repeat(F.lit(1.0), F.lit(k) - F.size("r"))))
    choose = [[1]]
    for _ in range(k):
        choose.append([1, *(a + b for a, b in zip(choose[-1], choose[-1][1:], strict=False)), 1])

    def tail(i: int):
        x = F.col("r")[i - 1]
        return sum((F.lit(float(choose[k][j])) * F.pow(x, F.lit(j)) * F.pow(1 - x, F.lit(k - j)) for j in range(i, k + 1)), F.lit(0.0))

    least = F.least(*(tail(i) for i in range(1, k + 1))) if k > 1 else tail(1)
    return held.select("direction", "gene", F.least(least * k, F.lit(1.0)).alias("score"))


def mean_lfc(tests: DataFrame, genes: DataFrame) -> DataFrame:
    """Mean effect over datasets, and whether all have one sign."""
    return tests.join(genes, "gene", "left_semi").groupBy("gene").agg(F.avg("b").alias("mean_lfc"), (F.abs(F.sum(F.signum("b"))) == F.count("b")).alias("consistent"))


def lfc_table(tests: DataFrame, datasets: list) -> DataFrame:
    """One column a dataset with the gene's effect there."""
    return tests.groupBy("gene").pivot("dataset", datasets).agg(F.first("b"))


def robust_genes(scores: DataFrame, effects: DataFrame, score: float = 0.05, lfc: float = 1.0, agree: bool = True) -> DataFrame:
    """Genes with a small aggregate score, a large mean effect and one sign in all datasets, in the direction ranked."""
    same = F.when(F.col("direction") == "Up", F.col("mean_lfc") > 0).otherwise(F.col("mean_lfc") < 0) if agree else F.lit(True)
    return scores.join(effects, "gene").where((F.col("score") < score) & (F.abs("mean_lfc") > lfc) & F.col("consistent") & same)


def batch_center(matrix: DataFrame, batches: DataFrame) -> DataFrame:
    """Values less their gene's mean in the batch; genes that any sample lacks are dropped.

    ``batches``: sample and batch (a dataset and cell line, or one block for a whole dataset).
    """
    n = batches.select("sample").distinct().count()
    full = matrix.where(F.col("value").isNotNull()).groupBy("gene").agg(F.count_distinct("sample").alias("n")).where(F.col("n") == n).select("gene")
    placed = matrix.join(full, "gene", "left_semi").join(batches, "sample")
    return placed.select("gene", "sample", "batch", (F.col("value") - F.avg("value").over(Window.partitionBy("batch", "gene"))).alias("value"))


def zscore(matrix: DataFrame, by: list[str] | None = None, extra: float = 0.0) -> DataFrame:
    """Values standardised by gene (sample deviation plus ``extra``); a constant gene gives null."""
    w = Window.partitionBy(*(by or ["gene"]))
    return matrix.withColumn("z", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w) + extra))


def signature_score(z: DataFrame, sets: DataFrame) -> DataFrame:
    """Score of each (sample, set): the mean z of its genes, those with sign -1 taken off as a mean of their own.

    ``sets``: set, gene and sign (1 or -1) or weight; with a weight column the score is the weighted sum.
    """
    held = z.join(sets, "gene")
    if "weight" in sets.columns:
        return held.groupBy("sample", "set").agg(F.sum(F.col("z") * F.col("weight")).alias("score"), F.count("z").alias("matched"))
    up, down = F.avg(F.when(F.col("sign") > 0, F.col("z"))), F.avg(F.when(F.col("sign") < 0, F.col("z")))
    return held.groupBy("sample", "set").agg((F.coalesce(up, F.lit(0.0)) - F.coalesce(down, F.lit(0.0))).alias("score"), F.count("z").alias("matched"))


def pseudobulk(counts: DataFrame, cells: DataFrame | None = None, genes: DataFrame | None = None, least_cells: int = 20) -> DataFrame:
    """Mean log-CPM of each (biopsy, gene) over the biopsy's cells.

    ``counts``: sparse (cell, gene, count), repeated genes are summed; ``cells``: cell and biopsy. Without it the counts
    hold the biopsy too, and their cells are all there are. A cell's total is over all its genes; ``genes`` limits what
    is returned. Cells without a count of a gene add zero, as do cells whose total is zero. Biopsies with fewer than
    ``least_cells`` cells go. Rows are dealt by cell once, to all shuffle partitions; partial sums leave them.
    """
    held = (counts if cells is None else counts.join(cells, "cell")).where(F.col("cell").isNotNull())
    # dealt by a hash, as an exchange by cell would become that of a join by cell, whose partitions Spark joins by bytes:
    # few distinct values compress so well that they hold many rows
    dealt = held.select(F.hash("cell").alias("deal"), "biopsy", "cell", "gene", "count").repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "deal")
    # one order by cell, biopsy and gene serves all windows; none holds more than a cell
    cell, part = Window.partitionBy("deal", "cell"), Window.partitionBy("deal", "cell", "biopsy").orderBy("gene")
    summed = dealt.withColumns({"at": F.row_number().over(part), "first": F.rank().over(part), "c": F.sum("count").over(Window.partitionBy("deal", "cell", "biopsy", "gene"))})
    once = summed.where(F.col("at") == F.col("first")).withColumn("total", F.sum("c").over(cell))
    sums = once.groupBy("biopsy", "gene").agg(F.sum(F.when(F.col("total") == 0, 0.0).otherwise(F.log2(F.col("c") / F.col("total") * 1e6 + 1))).alias("s"), F.count_if(F.col("at") == 1).alias("new"))
    if cells is None:
        found = sums.withColumn("n_cells", F.sum("new").over(Window.partitionBy("biopsy"))).where(F.col("biopsy").isNotNull() & (F.col("n_cells") >= least_cells))
    else:
        found = sums.join(cells.groupBy("biopsy").agg(F.count_distinct("cell").alias("n_cells")).where(F.col("n_cells") >= least_cells), "biopsy")
    asked = found if genes is None else found.join(genes, "gene", "left_semi")
    return asked.select("biopsy", "gene", (F.col("s") / F.col("n_cells")).alias("value"), "n_cells")


def median_split(scores: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Adds high: whether a value lies above its group's exact median."""
    mid = scores.groupBy(*by).agg(F.median(value).alias("__mid"))
    return scores.join(mid, by).withColumn("high", (F.col(value) > F.col("__mid")).cast("int")).drop("__mid")


def sample_counts(meta: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Numbers of samples by two columns, one pivoted."""
    return meta.groupBy(row).pivot(column, values).count().na.fill(0)
