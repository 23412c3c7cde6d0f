"""Keyed fits against their conditions of optimality, computed plainly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.operators import keyed_fits as kf
from strandworks.operators import models as md
from strandworks.operators import sequence as sq


def table(spark, n=90, p=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = (x[:, 0] - 0.7 * x[:, 1] + 0.5 * rng.normal(size=n) > 0).astype(int)
    names = [f"g{i}" for i in range(p)]
    rows = [(i, int(y[i]), int(i % 3), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, dataset int, " + ", ".join(f"{g} double" for g in names)), names, x, y


def logistic_slope(x, y, beta):
    s, z = 2 * y - 1.0, np.column_stack([x, np.ones(len(x))])
    return z.T @ (-s / (1 + np.exp(s * (z @ beta))))


def test_path_meets_its_conditions(spark):
    df, names, x, y = table(spark)
    costs = [0.02, 0.3, 10.0]
    path = md.l1_path(df, names, costs, k=4).toPandas()
    assert path["best"].sum() == len(names)
    for c in costs:
        fit = kf.Fit(-1, c, np.ones(4, bool), np.zeros(5))
        kf.solve(kf.prepared(df.withColumn("fold", F.lit(0)), names), [fit], kf.logistic, kf.Absolute())
        got = path[path["c"] == c].set_index("gene")["coef"][names].to_numpy()
        assert np.allclose(got, fit.beta[:-1], atol=1e-4)
        slope, penalty = logistic_slope(x, y, fit.beta) / len(x), 1 / (len(x) * c)
        assert abs(slope[-1]) < 1e-5
        for g, b in zip(slope[:-1], fit.beta, strict=False):
            assert abs(g) <= penalty + 1e-5 if b == 0 else abs(g + penalty * np.sign(b)) < 1e-5
    folds = {r.id: r.fold for r in md.stratified_folds(df, 4).collect()}
    loss = 0.0
    for f in range(4):
        mine = np.array([folds[i] != f for i in range(len(x))])
        fit = kf.Fit(f, 0.3, np.ones(4, bool), np.zeros(5))
        kf.solve(kf.prepared(md.stratified_folds(df, 4), names), [fit], kf.logistic, kf.Absolute())
        score = (2 * y - 1) * (np.column_stack([x, np.ones(len(x))]) @ fit.beta)
        loss += np.logaddexp(0, -score)[~mine].sum()
    assert abs(path[path["c"] == 0.3]["log_loss"].iloc[0] - loss / len(x)) < 1e-4


def test_ridge_models_leave_out_a_dataset(spark):
    df, names, x, y = table(spark, seed=5)
    got = {r.id: r.p for r in md.predict_folds(df, names, "dataset", 0.5).collect()}
    held = np.arange(len(x)) % 3
    beta = np.zeros(5)
    for _ in range(60):  # plain Newton on two datasets
        z, s = np.column_stack([x, np.ones(len(x))])[held != 1], (2 * y - 1.0)[held != 1]
        q = 1 / (1 + np.exp(s * (z @ beta)))
        slope = 0.5 * (z.T @ (-s * q)) + np.r_[beta[:-1], 0]
        beta = beta - np.linalg.solve(0.5 * (z.T * (q * (1 - q))) @ z + np.diag([1, 1, 1, 1, 1e-9]), slope)
    want = 1 / (1 + np.exp(-(np.column_stack([x, np.ones(len(x))]) @ beta)))
    assert len(got) == len(x) and all(abs(got[i] - want[i]) < 1e-4 for i in range(len(x)) if held[i] == 1)


def test_elimination_keeps_the_planted_genes(spark):
    df, names, x, y = table(spark, n=150, p=6, seed=8)
    assert set(md.svm_rfe(df, names)[:2]) == {"g0", "g1"}
    cv = md.svm_rfe_cv(df, names, 4, k=3).toPandas()
    assert list(cv["k"]) == [1, 2, 3, 4] and cv["accuracy"].iloc[1] > 0.8 and cv["best"].sum() == 1


def test_hinge_weights_are_stationary(spark):
    df, names, x, y = table(spark, seed=9)
    fit = kf.Fit(-1, 1.0, np.array([True, False, True, True]), np.zeros(5))
    kf.solve(kf.prepared(df.withColumn("fold", F.lit(0)), names), [fit], kf.hinge, kf.Squares(), 1e-7)
    s, z = 2 * y - 1.0, np.column_stack([x, np.ones(len(x))])
    slope = z.T @ (s * kf.hinge(s * (z @ fit.beta))[1]) + np.r_[fit.beta[:-1], 0]
    assert fit.beta[1] == 0 and np.abs(slope[[0, 2, 3, 4]]).max() < 1e-4
    for m in (-3.0, 0.4, 0.51, 1.0, 1.49, 1.6):
        e = 1e-6
        up, down = kf.hinge(np.array([m + e]))[0][0], kf.hinge(np.array([m - e]))[0][0]
        assert abs((up - down) / (2 * e) - kf.hinge(np.array([m]))[1][0]) < 1e-5


def test_what_is_not_solved_is_said(spark):
    df, names, *_ = table(spark)
    with pytest.raises(RuntimeError):
        kf.solve(kf.prepared(df.withColumn("fold", F.lit(0)), names), [kf.Fit(-1, 1.0, np.ones(4, bool), np.zeros(5))], kf.logistic, kf.Absolute(), rounds=1)


def test_components_of_samples(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 7)) * np.array([5, 1, 1, 1, 1, 1, 1])
    rows = [(g, s, float(x[g, s])) for g in range(60) for s in range(7) if (g, s) != (3, 2)]
    samples = spark.createDataFrame([(s,) for s in range(7)], "sample int")
    scores, shares = md.pca_scores(spark.createDataFrame(rows, "gene int, sample int, value double"), samples, k=2)
    filled = x.copy()
    filled[3, 2] = np.delete(x[3], 2).mean()
    centred = filled - filled.mean(axis=1, keepdims=True)
    u, size, _ = np.linalg.svd(centred.T, full_matrices=False)
    got = scores.orderBy("sample").toPandas()
    for j in range(2):
        want = u[:, j] * size[j]
        assert np.allclose(np.abs(got[f"pc{j + 1}"]), np.abs(want), atol=1e-8) and got[f"pc{j + 1}"].abs().max() == got[f"pc{j + 1}"].max()
    assert np.allclose(shares, size[:2] ** 2 / (size**2).sum())


def test_shared_complements_are_dimers(spark):
    rng = np.random.default_rng(1)
    rows = [("".join(rng.choice(list("ACGT"), rng.integers(1, 14))), "".join(rng.choice(list("ACGT"), rng.integers(1, 14)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("n", sq.dimer("a", "b"))
    for k in (1, 3, 4):
        assert df.where((F.col("n") >= k) != sq.share_complement(F.col("a"), F.col("b"), k)).count() == 0
