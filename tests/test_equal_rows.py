"""Bootstraps of rows that are equal but for their id, and fits that start from the whole."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from strandworks.operators import concordance as cc
from strandworks.operators import survival as sv


def test_weights_are_drawn_once_a_row_and_give_the_same_replicates(spark, monkeypatch):
    r = random.Random(8)
    data = [(i, float(r.randint(0, 1)), float(r.randint(0, 9)) / 4) for i in range(900)]
    df = spark.createDataFrame(data, "id long, time double, risk double")
    rows = df.select("time", (F.col("time") == 0).cast("int").alias("event"), "risk", F.xxhash64(F.lit(3), "id").alias("key"))
    levels = []
    plain = cc.by_level
    monkeypatch.setattr(cc, "by_level", lambda rows, bits: (levels.append(bits), plain(rows, bits))[1])
    summed = sorted(map(tuple, cc.cindex_replicates(rows, 30).select("replicate", "pairs", "agree").collect()))
    assert levels == [cc.BITS]  # the vectors of weights are not dealt by level
    monkeypatch.setattr(cc, "GROUPS", 0)
    assert summed == sorted(map(tuple, cc.cindex_replicates(rows, 30).select("replicate", "pairs", "agree").collect()))
    w = cc.poisson_weights(np.array([x.key for x in rows.select("key").collect()]), 30)
    time, risk = (np.array([x[k] for x in rows.select("time", "risk").collect()]) for k in (0, 1))
    for i, pairs, agree in summed[:5]:
        case, rest = time == 0, time == 1
        won = (risk[case][:, None] > risk[rest]) + 0.5 * (risk[case][:, None] == risk[rest])
        both = w[case, i][:, None] * w[rest, i]
        assert (pairs, agree) == (both.sum(), (both * won).sum())


def test_fold_fits_start_from_the_whole(spark, monkeypatch):
    r = random.Random(9)
    data = [(i, float(r.randint(1, 60)), float(r.random() < 0.6), r.gauss(0, 1), r.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame(data, "id long, time double, event double, a double, b double")
    rows = sv.spread(sv.folds(df, 5), [], ["time"])
    asked, plain = [], sv._fold_moments
    monkeypatch.setattr(sv, "_fold_moments", lambda rows, columns, betas: (asked.append(len(betas)), plain(rows, columns, betas))[1])
    beta = sv.fold_fits(rows, ["a", "b"], 5)
    assert sum(n > 1 for n in asked) <= 4 and asked[0] == 1
    now = plain(rows, ["a", "b"], beta)
    assert all(np.abs(now[i]["gradient"]).max() < 1e-3 for i in beta)
