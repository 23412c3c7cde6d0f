"""Feature selection, classifiers and their validation on a wide table: id, y, dataset and one column a gene."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.columns import log_factorials
from strandworks.functions.storage import cut
from strandworks.operators.keyed_fits import LOOSE, Absolute, Fit, Squares, hinge, logistic, prepared, solve
from strandworks.operators.scan import numbered, running, spread


def wide(matrix: DataFrame, genes: list[str], value: str = "z") -> DataFrame:
    """One row a sample with a column for each of a short list of genes; missing values are 0."""
    out = matrix.where(F.col("gene").isin(genes)).groupBy(F.col("sample").alias("id")).pivot("gene", genes).agg(F.first(value))
    return out.na.fill(0.0, genes)


def vectors(df: DataFrame, genes: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=genes, outputCol="features").transform(df.withColumn("label", F.col("y").cast("double")))


def stratified_folds(df: DataFrame, k: int, seed: int = 2026) -> DataFrame:
    """Adds fold, dealt evenly within each y in the order of a seeded hash."""
    w = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    return df.withColumn("fold", (F.row_number().over(w) - 1) % k)


def auc(df: DataFrame, score: str = "p", y: str = "y", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties half; scores are first summed by distinct value. Null for one class."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1.0)
    steps = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.sum(w * (F.col(y) == 1).cast("int")).alias("p1"), F.sum(w * (F.col(y) == 0).cast("int")).alias("p0"))
    won = running(spread(steps, by, ["s"]), by, ["s"], {"upto": F.col("p0")}).withColumn("won", F.col("p1") * (F.col("upto") - F.col("p0") / 2))
    return won.groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("p1") * F.sum("p0")).alias("auc"))


def roc_points(df: DataFrame, score: str = "p", y: str = "y") -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, from the highest."""
    steps = df.groupBy(F.col(score).alias("threshold")).agg(F.sum((F.col(y) == 1).cast("int")).alias("a"), F.sum((F.col(y) == 0).cast("int")).alias("b"))
    rows = spread(steps, [], ["threshold"])
    total = rows.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    above = running(rows, [], ["threshold"], {"up_a": F.col("a"), "up_b": F.col("b")}, down=True).crossJoin(F.broadcast(total))  # one row
    return above.select("threshold", F.try_divide("up_a", "all_a").alias("tpr"), F.try_divide("up_b", "all_b").alias("fpr"))


def votes(selections: DataFrame, selectors: int) -> DataFrame:
    """(gene, votes, core): core genes have every vote; if none has, at least two thirds of them, rounded up."""
    n = selections.select("selector", "gene").distinct().groupBy("gene").agg(F.count("*").alias("votes"))
    most = n.agg(F.max("votes").alias("m"))
    need = F.when(F.col("m") == selectors, F.lit(selectors)).otherwise(F.lit(-(-2 * selectors // 3)))
    return n.join(F.broadcast(most)).withColumn("core", F.col("votes") >= need).drop("m")  # one row


def l1_path(df: DataFrame, genes: list[str], costs: list[float], k: int = 10, seed: int = 2026) -> DataFrame:
    """(c, gene, coef, log_loss, best) of an L1 logistic path with stratified cross-validation; the intercept is free.

    The fits of all costs and folds are solved together, to the optimality conditions."""
    rows = prepared(stratified_folds(df, k, seed), genes)
    p = len(genes)
    fits = solve(rows, [Fit(fold, float(c), np.ones(p, bool), np.zeros(p + 1)) for c in costs for fold in range(-1, k)], logistic, Absolute())
    loss = {c: sum(f.now["held_loss"] for f in fits if f.cost == c and f.fold >= 0) / max(1.0, sum(f.now["held_n"] for f in fits if f.cost == c and f.fold >= 0)) for c in map(float, costs)}
    best = min(loss, key=lambda c: (loss[c], c))
    out = [(f.cost, g, float(b), float(loss[f.cost]), bool(f.cost == best)) for f in fits if f.fold < 0 for g, b in zip(genes, f.beta, strict=False)]
    return df.sparkSession.createDataFrame(out, "c double, gene string, coef double, log_loss double, best boolean")


def eliminated(rows: DataFrame, genes: list[str], folds: list[int], keep: int = 1, share: float = 0.0, c: float = 1.0) -> dict[int, list[str]]:
    """For each fold left out, the genes from the last eliminated to the first; all folds go on together.

    Each round drops the genes of least squared weight in a linear classifier with hinge loss: one, or a share of what is
    left when there are many. A round starts from the weights of the one before."""
    p = len(genes)
    fits = [Fit(fold, c, np.ones(p, bool), np.zeros(p + 1)) for fold in folds]
    gone: dict[int, list[int]] = {f: [] for f in folds}
    while (left := int(fits[0].active.sum())) > keep:
        solve(rows, fits, hinge, Squares(), LOOSE)
        for f in fits:
            order = sorted(np.flatnonzero(f.active), key=lambda i: (f.beta[i] ** 2, genes[i]))
            drop = order[: min(max(1, int(share * left)), left - keep)]
            gone[f.fold] += drop
            f.active[drop], f.beta[drop] = False, 0.0
    return {f.fold: [*(genes[i] for i in np.flatnonzero(f.active)), *(genes[i] for i in reversed(gone[f.fold]))] for f in fits}


def svm_rfe(df: DataFrame, genes: list[str], keep: int = 1, share: float = 0.0, c: float = 1.0) -> list[str]:
    """Genes from the last eliminated to the first, on all rows."""
    return eliminated(prepared(df.withColumn("fold", F.lit(0)), genes), genes, [-1], keep, share, c)[-1]


def svm_rfe_cv(df: DataFrame, genes: list[str], most: int, k: int = 5, seed: int = 2026, share: float = 0.0) -> DataFrame:
    """(k, accuracy, best): cross-validated accuracy by number of genes, ranked within each fold."""
    rows = prepared(stratified_folds(df, k, seed), genes)
    ranks = eliminated(rows, genes, list(range(k)), share=share)
    sizes, place = range(1, min(most, len(genes)) + 1), {g: i for i, g in enumerate(genes)}

    def chosen(fold: int, n: int) -> np.ndarray:
        out = np.zeros(len(genes), bool)
        out[[place[g] for g in ranks[fold][:n]]] = True
        return out

    fits = solve(rows, [Fit(fold, 1.0, chosen(fold, n), np.zeros(len(genes) + 1)) for n in sizes for fold in range(k)], hinge, Squares(), LOOSE)
    hits = {n: sum(f.now["held_hits"] for f in fits if f.active.sum() == n) for n in sizes}
    total = max(1.0, sum(f.now["held_n"] for f in fits if f.active.sum() == 1))
    best = max(hits, key=lambda n: (hits[n], -n))
    return df.sparkSession.createDataFrame([(n, float(h / total), n == best) for n, h in hits.items()], "k int, accuracy double, best boolean")


def keyed_place(i: Column, n: int, *key: Column) -> Column:
    """Where a keyed permutation of 0 .. n - 1 puts ``i``: a Feistel network over the next power of two, walked on until
    it is below n (64 steps at most; each one is, with a chance above one half)."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    low = bits // 2
    masks = ((1 << low) - 1, (1 << (bits - low)) - 1)

    def step(x: Column) -> Column:
        right, left = x.bitwiseAND(masks[0]), F.shiftright(x, low)
        for r in range(3):
            left = left.bitwiseXOR(F.xxhash64(*key, F.lit(2 * r), right).bitwiseAND(masks[1]))
            right = right.bitwiseXOR(F.xxhash64(*key, F.lit(2 * r + 1), left).bitwiseAND(masks[0]))
        return F.shiftleft(left, low).bitwiseOR(right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), step(i.cast("long")), lambda x, _: F.when(x < n, x).otherwise(step(x)))


def shadows(place: DataFrame, n: int, genes: list[str], seed: int) -> DataFrame:
    """Adds a permuted copy of each gene column. ``place``: n rows, numbered in ``__i`` from 1.

    Every value is sent to the row that its column's keyed permutation names; all columns go in one shuffle."""
    values = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col(g).alias("x")) for j, g in enumerate(genes))))
    sent = place.select("__i", values.alias("v")).select((keyed_place(F.col("__i") - 1, n, F.lit(seed), F.col("v.j")) + 1).alias("__i"), "v.j", "v.x")
    copies = sent.groupBy("__i").agg(*(F.max(F.when(F.col("j") == j, F.col("x"))).alias(f"shadow_{g}") for j, g in enumerate(genes)))
    return place.join(copies, "__i")


def boruta(df: DataFrame, genes: list[str], rounds: int = 100, trees: int = 100, seed: int = 2026, threads: int = 4) -> DataFrame:
    """(gene, hits, padj): rounds in which a gene's importance in a forest exceeds every permuted copy's.

    Rounds do not depend on each other; ``threads`` of them run at a time."""
    names = [*genes, *(f"shadow_{g}" for g in genes)]
    base = numbered(df, "__i", [], ["id"]).persist()
    n = base.count()

    def won(i: int) -> list[bool]:
        data = cut(vectors(shadows(base, n, genes, seed + i), names).select("features", "label"))
        importance = RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", seed=seed + i, maxDepth=8).fit(data).featureImportances.toArray()
        return [bool(x > importance[len(genes) :].max()) for x in importance[: len(genes)]]

    with ThreadPoolExecutor(threads) as pool:
        wins = list(pool.map(inheritable_thread_target(df.sparkSession)(won), range(rounds)))
    base.unpersist()
    table = df.sparkSession.createDataFrame([(g, sum(w[j] for w in wins)) for j, g in enumerate(genes)], "gene string, hits int")
    return boruta_tail(table, rounds)


def boruta_tail(hits: DataFrame, rounds: int) -> DataFrame:
    """Adds padj: the upper binomial tail of the hits at one half, times the number of genes."""
    logs = log_factorials(hits.sparkSession, rounds).agg(F.array_sort(F.collect_list(F.struct("k", "lf"))).alias("t")).select(F.transform("t", lambda x: x["lf"]).alias("lf"))
    n = hits.agg(F.count("*").alias("m"))
    term = lambda k: F.exp(F.col("lf")[rounds] - F.col("lf")[k] - F.col("lf")[F.lit(rounds) - k] - rounds * F.ln(F.lit(2.0)))
    tail = F.aggregate(F.sequence(F.col("hits"), F.lit(rounds)), F.lit(0.0), lambda a, k: a + term(k))
    return hits.join(F.broadcast(logs)).join(F.broadcast(n)).withColumn("padj", F.least(tail * F.col("m"), F.lit(1.0))).select("gene", "hits", "padj")  # one row each


def predict_folds(df: DataFrame, genes: list[str], fold: str, c: float = 1.0) -> DataFrame:
    """Each row's probability from a ridge logistic model of all rows with another value of ``fold``: id, y, fold, p.

    With a fold column this is cross-validation, with the dataset column it leaves one dataset out. All models are
    fitted in one job a step; there is one for each value of ``fold``."""
    values = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]  # a row for each model
    keyed = df.join(F.broadcast(df.sparkSession.createDataFrame(list(enumerate(values)), f"__f int, {fold} {dict(df.dtypes)[fold]}")), fold)
    fits = solve(prepared(keyed, genes, "__f"), [Fit(i, c, np.ones(len(genes), bool), np.zeros(len(genes) + 1)) for i in range(len(values))], logistic, Squares(), 1e-9)
    weights = df.sparkSession.createDataFrame([(f.fold, [float(b) for b in f.beta]) for f in fits], "__f int, b array<double>")
    score = F.aggregate(F.zip_with(F.array(*(F.col(g).cast("double") for g in genes), F.lit(1.0)), "b", lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return keyed.join(F.broadcast(weights), "__f").select("id", "y", fold, (1 / (1 + F.exp(-score))).alias("p"))


def boosted_folds(df: DataFrame, genes: list[str], k: int = 5, rounds: int = 60, seed: int = 2026) -> DataFrame:
    """Cross-validated probabilities of boosted trees."""
    data = cut(vectors(stratified_folds(df, k, seed), genes))
    parts = []
    for i in range(k):
        model = GBTClassifier(maxIter=rounds, maxDepth=2, stepSize=0.05, subsamplingRate=0.8, seed=seed).fit(data.where(F.col("fold") != i))
        parts.append(model.transform(data.where(F.col("fold") == i)).select("id", "y", vector_to_array("probability")[1].alias("p")))
    return reduce(DataFrame.unionByName, parts)


def permutation_importance(df: DataFrame, genes: list[str], repeats: int = 10, rounds: int = 60, seed: int = 2026) -> DataFrame:
    """(gene, importance, sd): the fall of the AUC of boosted trees when one column is permuted.

    All genes and repeats are one job: a row's permuted value is that of the row which a keyed permutation names."""
    model = GBTClassifier(maxIter=rounds, maxDepth=2, stepSize=0.05, subsamplingRate=0.8, seed=seed).fit(vectors(df, genes))
    base = auc(model.transform(vectors(df, genes)).select("id", "y", vector_to_array("probability")[1].alias("p"))).collect()[0][0]
    place = cut(numbered(df, "__i", [], ["id"]).select((F.col("__i") - 1).alias("__i"), "id", "y", F.array(*(F.col(g).cast("double") for g in genes)).alias("x")))
    n = place.count()
    draws = place.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(genes) - 1)))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    sent = draws.select(keyed_place(F.col("__i"), n, F.lit(seed), F.col("repeat"), F.col("j")).alias("__i"), "j", "repeat", F.get("x", F.col("j")).alias("new"))
    mixed = draws.join(sent, ["__i", "j", "repeat"]).select("j", "repeat", "id", "y", array_to_vector(F.transform("x", lambda v, i: F.when(i == F.col("j"), F.col("new")).otherwise(v))).alias("features"))
    scored = model.transform(mixed).select("j", "repeat", "y", vector_to_array("probability")[1].alias("p"))
    falls = auc(scored, by=["j", "repeat"])
    names = F.array(*(F.lit(g) for g in genes))
    return falls.groupBy(F.get(names, F.col("j")).alias("gene")).agg((F.lit(float(base)) - F.avg("auc")).alias("importance"), F.stddev_samp("auc").alias("sd"))


def gram(rows: DataFrame, n: int) -> np.ndarray:
    """The n x n sum of outer products of each row's ``at`` (places of samples) and ``c`` (numbers): a matrix a task, then
    one sum by row of the matrix. ``n`` is the number of samples, not of genes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n, n))
        for batch in batches:
            x = np.zeros((len(batch), n))
            for i, (at, c) in enumerate(zip(batch["at"], batch["c"], strict=True)):
                x[i, at] = c
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(n), "g": list(total)})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": group["i"].iloc[:1], "g": [np.sum(np.stack(group["g"].to_numpy()), axis=0)]})

    kind = "i int, g array<double>"
    found = {r["i"]: r["g"] for r in rows.select("at", "c").mapInPandas(run, kind).groupBy("i").applyInPandas(add, kind).collect()}  # n rows
    return np.array([found.get(i, [0.0] * n) for i in range(n)])


def pca_scores(matrix: DataFrame, samples: DataFrame, most: int = 2000, k: int = 2, value: str = "value") -> tuple[DataFrame, list[float]]:
    """First components of the samples over the most variable genes, and the share of variance of each.

    The genes' rows, centred, are summed into the Gram matrix of the samples, whose eigenvectors are the scores' directions;
    no matrix of genes by genes is made. A component's largest score in size is positive; missing values are the mean."""
    top = matrix.groupBy("gene").agg(F.var_samp(value).alias("v")).orderBy(F.desc("v"), "gene").limit(most).select("gene")
    names = [r[0] for r in matrix.select("sample").distinct().orderBy("sample").collect()]  # the samples
    kind = matrix.schema["sample"].dataType.simpleString()
    places = matrix.sparkSession.createDataFrame(list(enumerate(names)), f"at int, sample {kind}")
    kept = matrix.join(top, "gene", "left_semi").join(F.broadcast(places), "sample")
    centre = kept.groupBy("gene").agg(F.avg(value).alias("m"), F.collect_list(F.struct("at", F.col(value).alias("x"))).alias("a"))
    rows = centre.select(F.transform("a", lambda r: r["at"]).alias("at"), F.transform("a", lambda r: F.coalesce(r["x"] - F.col("m"), F.lit(0.0))).alias("c"))
    sizes, directions = np.linalg.eigh(gram(rows, len(names)))
    sizes, directions = np.maximum(sizes[::-1], 0), directions[:, ::-1]
    scores = directions[:, :k] * np.sqrt(sizes[:k])
    for j in range(scores.shape[1]):
        scores[:, j] *= -1 if scores[np.argmax(np.abs(scores[:, j])), j] < 0 else 1
    table = matrix.sparkSession.createDataFrame([(s, *map(float, x)) for s, x in zip(names, scores, strict=True)], f"sample {kind}, " + ", ".join(f"pc{i + 1} double" for i in range(k)))
    return table.join(samples, "sample"), [float(x) for x in sizes[:k] / (sizes.sum() or 1.0)]


def nested_lodo(tests: DataFrame, matrix: DataFrame, batches: DataFrame, labels: DataFrame, most: int = 40, top: int = 12, costs: tuple[float, ...] = (0.05, 0.2, 1.0), rounds: int = 8, trees: int = 30, k: int = 5, share: float = 0.0) -> DataFrame:
    """Leave one dataset out with every choice inside: (held_out, n_test, n_robust, n_core, core, auc).

    ``tests``: dataset, gene, b, p for all datasets, computed once; ``matrix``: sample, gene, value; ``batches``:
    sample, batch; ``labels``: sample, dataset, y. For each held-out dataset the rank aggregation, the robust genes,
    the centring, the selectors and the vote see the others only; its own rows are centred and scaled on themselves.
    """
    from strandworks.operators.expression import batch_center, mean_lfc, rank_lists, robust_genes, rra, universe, zscore

    genes = universe(tests).persist()
    n = genes.count()
    out = []
    for held in [r[0] for r in tests.select("dataset").distinct().orderBy("dataset").collect()]:
        inner = tests.where(F.col("dataset") != held)
        scores = rra(rank_lists(inner, genes), n, inner.select("dataset").distinct().count())
        robust = robust_genes(scores, mean_lfc(inner, genes), agree=False).orderBy("score", "gene")
        names = [str(r.gene) for r in robust.limit(most).collect()]
        total = robust.count()
        if len(names) < 2:
            continue
        chosen = matrix.withColumn("gene", F.col("gene").cast("string")).where(F.col("gene").isin(names))

        def ready(on: DataFrame, chosen=chosen, names=names) -> DataFrame:
            own = batches.join(on.select("sample"), "sample", "left_semi")
            z = zscore(batch_center(chosen.join(on.select("sample"), "sample", "left_semi"), own)).withColumn("z", F.coalesce("z", F.lit(0.0)))
            return cut(wide(z, names).join(on.select(F.col("sample").alias("id"), "y", "dataset"), "id"))

        train, test = ready(labels.where(F.col("dataset") != held)), ready(labels.where(F.col("dataset") == held))
        path = l1_path(train, names, list(costs), k=k)
        lasso = [r.gene for r in path.where(F.col("best") & (F.col("coef") != 0)).collect()]
        ranked = svm_rfe(train, names, share=share)[:top]
        forest = [r.gene for r in boruta(train, names, rounds, trees).where(F.col("hits") > rounds / 2).collect()]
        counts = {g: (g in lasso) + (g in ranked) + (g in forest) for g in names}
        core = [g for g in names if counts[g] >= 2] or names[:5]
        both = train.withColumn("part", F.lit(0)).unionByName(test.withColumn("part", F.lit(1)))
        score = auc(predict_folds(both, core, "part").where("part = 1")).collect()[0][0]
        out.append((str(held), test.count(), total, len(core), ";".join(sorted(core)), score))
    genes.unpersist()
    return tests.sparkSession.createDataFrame(out, "held_out string, n_test long, n_robust long, n_core int, core string, auc double")
