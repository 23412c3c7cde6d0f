"""Running sums over ranges, and what is built on them, against plain windows and brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandworks.operators import concordance as cc
from strandworks.operators import models as md
from strandworks.operators import scan


def frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, 3)), float(i * 7 % 401), int(rng.integers(-5, 5)) if i % 9 else None) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g int, t double, x int")


def test_running_sums_and_last_values(spark):
    df = frame(spark)
    for by in ([], ["g"]):
        for down in (False, True):
            part = scan.spread(df, by, ["t"], 7)
            got = scan.running(part, by, ["t"], {"s": F.col("x"), "n": F.lit(1)}, {"v": F.col("x")}, down)
            w = Window.partitionBy(*by).orderBy(F.desc("t") if down else F.asc("t")).rowsBetween(Window.unboundedPreceding, 0)
            want = df.withColumn("s", F.sum("x").over(w)).withColumn("n", F.sum(F.lit(1)).over(w)).withColumn("v", F.last("x", ignorenulls=True).over(w))
            assert sorted(tuple(r) for r in got.select("id", "s", "n", "v").collect()) == sorted(tuple(r) for r in want.select("id", "s", "n", "v").collect())


def test_no_task_holds_more_than_its_range(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("t"))
    rows = scan.spread(df, [], ["t"], 10).groupBy(scan.PART).count().collect()
    assert len(rows) == 10 and max(r["count"] for r in rows) < 3_000
    plan = scan.running(scan.spread(df, [], ["t"], 10), [], ["t"], {"s": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    # the window over rows has the ranges as groups; one without groups sees a row for each range
    assert any(scan.PART in x.split("windowspecdefinition(")[1].split("ASC")[0] for x in windows)


def test_numbered(spark):
    got = scan.numbered(frame(spark), "k", ["g"], ["t"]).toPandas()
    for _, part in got.groupby("g"):
        assert list(part.sort_values("t")["k"]) == list(range(1, len(part) + 1))


def people(n=300, seed=4):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"id": np.arange(n), "g": rng.integers(0, 2, n), "time": rng.integers(1, 40, n).astype(float), "event": rng.integers(0, 2, n), "risk": np.round(rng.normal(size=n), 1), "w": rng.integers(1, 4, n).astype(float)})


def pairs_by_hand(time, event, risk, own, others):
    counts = (event == 1)[:, None] & (time[None, :] > time[:, None])
    agree = (risk[:, None] > risk[None, :]) + 0.5 * (risk[:, None] == risk[None, :])
    weight = own[:, None] * others[None, :] * counts
    return weight.sum(), (weight * agree).sum()


def test_cindex_by_digits(spark):
    df = people()
    got = {r.g: (r.pairs, r.agree) for r in cc.cindex(spark.createDataFrame(df), by=["g"], weight="w").collect()}
    for g, part in df.groupby("g"):
        t, e, r, w = (part[c].to_numpy() for c in ("time", "event", "risk", "w"))
        assert np.allclose(got[g], pairs_by_hand(t, e, r, w, w))
    one = spark.createDataFrame(df.head(1))
    assert cc.cindex(one).collect()[0].cindex is None
    same = spark.createDataFrame(df.assign(risk=1.0))
    assert cc.cindex(same).collect()[0].cindex == 0.5


def test_replicates_of_the_cindex(spark, monkeypatch):
    df, replicates = people(seed=6), 20
    monkeypatch.setattr(cc, "NUMBERS", 400)  # chunks of 20 rows, so that times and keys cross their ends
    rows = spark.createDataFrame(df).withColumn("key", F.xxhash64(F.lit(9), "id")).select("time", "event", "risk", "key")
    got = cc.cindex_replicates(rows, replicates).orderBy("replicate").toPandas()
    held = rows.toPandas()
    w = cc.poisson_weights(held["key"].to_numpy(), replicates)
    t, e, r = (held[c].to_numpy() for c in ("time", "event", "risk"))
    for i in range(replicates):
        assert np.allclose((got["pairs"][i], got["agree"][i]), pairs_by_hand(t, e, r, w[:, i], w[:, i]))


def test_replicates_of_the_time_auc(spark, monkeypatch):
    df, replicates, t0 = people(seed=8), 15, 20.0
    monkeypatch.setattr(cc, "NUMBERS", 600)
    rows = spark.createDataFrame(df).withColumn("key", F.xxhash64(F.lit(9), "id")).select("time", "event", "risk", "key")
    before = {r["time"]: np.array(r["log"]) for r in cc.censoring_replicates(rows, t0, replicates).collect()}
    held = rows.toPandas()
    w = cc.poisson_weights(held["key"].to_numpy(), replicates)
    t, e = held["time"].to_numpy(), held["event"].to_numpy()
    assert set(before) == {x for x, y in zip(t, e, strict=True) if y == 1 and x <= t0}
    for time, log in before.items():
        for i in range(replicates):
            g = 1.0
            for s in sorted(set(t[t < time])):
                n, d = w[t >= s, i].sum(), w[(t == s) & (e == 0), i].sum()
                g *= 1 - d / n if n > 0 else 1.0
            assert abs(np.exp(log[i]) - g) < 1e-9
    ci = cc.time_auc_ci(spark.createDataFrame(df), t0, replicates=replicates).collect()[0]
    assert 0.2 < ci.low < ci.high < 0.8 and ci.replicates == replicates


def test_poisson_weights():
    w = cc.poisson_weights(np.arange(20_000) * 7919 - 10**9, 50)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and w.max() >= 7 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03
    assert cc.BOUNDS[-1] > 1 - 1e-15


def test_auc_interval_holds_the_auc(spark):
    df = people(seed=3).assign(y=lambda d: (d["risk"] + d["w"] > 2).astype(int))
    table = spark.createDataFrame(df)
    ci, whole = cc.auc_ci(table, "risk", 200).collect()[0], md.auc(table, "risk").collect()[0][0]
    assert ci.low < whole < ci.high and ci.high - ci.low < 0.2


def test_keyed_places_are_permutations(spark):
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (1, 2):
            got = [r[0] for r in spark.range(n).select(md.keyed_place(F.col("id"), n, F.lit(key), F.lit("a"))).collect()]
            assert sorted(got) == list(range(n))
    one, two = ([r[0] for r in spark.range(50).select(md.keyed_place(F.col("id"), 50, F.lit(k))).collect()] for k in (1, 2))
    assert one != two and one != sorted(one)


def test_shadows_permute_each_column(spark):
    df = pd.DataFrame({"id": range(30), "a": np.arange(30.0), "b": np.arange(30.0) + 100})
    place = scan.numbered(spark.createDataFrame(df), "__i", [], ["id"])
    got = md.shadows(place, 30, ["a", "b"], 5).toPandas()
    assert sorted(got["shadow_a"]) == list(df["a"]) and sorted(got["shadow_b"]) == list(df["b"])
    assert list(got["shadow_a"]) != list(got["a"]) and list(got["shadow_b"] - 100) != list(got["shadow_a"])
