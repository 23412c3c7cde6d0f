"""Closed forms, planted signals and properties of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandworks.functions import tails
from strandworks.operators import expression as ex
from strandworks.operators import models as md
from strandworks.operators import network as nw
from strandworks.operators import screen as sc
from strandworks.operators import sequence as sq
from strandworks.operators import concordance as cc, scan
from strandworks.operators import survival as sv
from strandworks.operators import trial as tr
from strandworks.operators.graph import connected_components
from strandworks.sources import readers


def test_tails():
    assert abs(tails.t_two_sided(np.array([2.228]), np.array([10.0]))[0] - 0.05) < 1e-4
    assert abs(tails.t_two_sided(np.array([1.0]), np.array([1.0]))[0] - 0.5) < 1e-12
    assert abs(tails.chi2_sf_1(np.array([3.841459]))[0] - 0.05) < 1e-6
    assert abs(tails.chi2_sf(5.991465, 2) - 0.05) < 1e-6 and abs(tails.chi2_sf(7.814728, 3) - 0.05) < 1e-6
    assert abs(tails.incomplete_beta(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0] - 0.5248) < 1e-9
    assert abs(tails.digamma(1) + 0.5772156649) < 1e-9 and abs(tails.trigamma(1) - math.pi**2 / 6) < 1e-9
    assert all(abs(tails.trigamma(tails.inverse_trigamma(x)) - x) < 1e-6 for x in (0.01, 0.5, 3.0))


def test_rank_tests():
    assert abs(tr.signed_rank_p(0, 5, 0, 0) - 2 / 32) < 1e-12
    assert abs(tr.rank_sum_p(0, 3, 4, 0) - 2 / 35) < 1e-12


def path_star_clique(spark):
    edges = [(0, 1), (1, 2), (2, 3)] + [(10, i) for i in range(11, 15)] + [(20 + i, 20 + j) for i in range(4) for j in range(i)]
    return spark.createDataFrame([(min(a, b), max(a, b)) for a, b in edges], "src long, dst long")


def test_components_and_cliques(spark):
    edges = path_star_clique(spark)
    got = {r.vertex: r.component for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(4), 0), **dict.fromkeys(range(10, 15), 10), **dict.fromkeys(range(20, 24), 20)}
    mcc = {r.v: r.mcc for r in nw.cliques_by_vertex(edges).collect()}
    assert mcc[0] == 1 and mcc[1] == 2 and mcc[10] == 4 and mcc[11] == 1 and all(mcc[v] == 6 for v in range(20, 24))


def test_centrality_of_a_star(spark):
    star = path_star_clique(spark).where("src = 10")
    got = {r.v: (r.betweenness, r.closeness) for r in nw.centralities(star).collect()}
    assert abs(got[10][0] - 1) < 1e-12 and got[11][0] == 0 and got[10][1] == 1 and abs(got[11][1] - 4 / 7) < 1e-12


def test_centralities_of_a_graph_with_a_hub(spark):
    rng = np.random.default_rng(5)
    pairs = {(0, i) for i in range(1, 150)}  # a hub, few links among its neighbours, two dense groups
    pairs |= {tuple(sorted(map(int, rng.choice(np.arange(1, 150), 2, replace=False)))) for _ in range(120)}
    pairs |= {(i, j) for i in range(10, 17) for j in range(i + 1, 17)} | {(i, j) for i in range(15, 21) for j in range(i + 1, 21)}
    links = {v: set() for v in range(150)}
    for a, b in pairs:
        links[a].add(b)
        links[b].add(a)
    mcc = dict.fromkeys(links, 0.0)

    def grow(clique, more, done):
        if not more and not done:
            for u in clique:
                mcc[u] += math.factorial(len(clique) - 1)
        for u in list(more):
            grow([*clique, u], more & links[u], done & links[u])
            more = more - {u}
            done = done | {u}

    grow([], set(links), set())
    hops, ways = {}, {}
    for s in links:
        dist, paths, front = {s: 0}, {s: 1}, [s]
        while front:
            new = {}
            for v in front:
                for w in links[v]:
                    if w not in dist:
                        new[w] = new.get(w, 0) + paths[v]
            for w, n in new.items():
                dist[w], paths[w] = dist[front[0]] + 1, n
            front = list(new)
        hops[s], ways[s] = dist, paths
    between = {v: sum(ways[s][v] * ways[v][t] / ways[s][t] for s in links for t in links if len({s, t, v}) == 3 and hops[s][v] + hops[v][t] == hops[s][t]) / (149 * 148) for v in list(links)[:30]}
    edges = spark.createDataFrame(sorted(pairs), "src int, dst int")
    got = {r.v: r for r in nw.centralities(edges).collect()}
    assert len(got) == 150 and all(abs(got[v].mcc - mcc[v]) < 1e-9 and got[v].degree == len(links[v]) and abs(got[v].closeness - 149 / sum(hops[v].values())) < 1e-12 for v in links)
    assert all(abs(got[v].betweenness - between[v]) < 1e-12 for v in between)
    places = {r.v: r.place for r in nw.core_order(edges).collect()}
    assert max(sum(places[w] > places[v] for w in links[v]) for v in links) <= 14  # the hub has 149 neighbours


def test_closeness_over_more_than_one_word_of_sources(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(140)], "src int, dst int")
    got = {r.v: r.closeness for r in nw.closeness(edges).collect()}
    assert all(abs(got[v] - 140 / sum(abs(v - w) for w in range(141))) < 1e-12 for v in range(141))


def survival_rows(spark, n=300, beta=0.8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    time, censor = rng.exponential(1 / np.exp(beta * x)), rng.exponential(2.0, n)
    rows = [(i, float(round(min(t, c), 3) + 0.001), int(t <= c), float(a)) for i, (t, c, a) in enumerate(zip(time, censor, x, strict=True))]
    return spark.createDataFrame(rows, "id long, time double, event int, x double"), rows


def test_cox_finds_a_planted_effect(spark):
    df, _ = survival_rows(spark)
    fit = sv.cox_fit(df, ["x"])
    assert abs(fit["beta"][0] - 0.8) < 3 * fit["se"][0]
    by = sv.cox_by_gene(df.withColumn("gene", F.lit("a")), ["gene"]).collect()[0]
    assert abs(by.beta - fit["beta"][0]) < 1e-5 and abs(by.se - fit["se"][0]) < 1e-4


def test_concordance_and_auc(spark):
    df, rows = survival_rows(spark, 120)
    pairs = agree = 0.0
    for _, t, e, x in rows:
        for _, u, _, y in rows:
            if e and u > t:
                pairs += 1
                agree += (x > y) + 0.5 * (x == y)
    got = cc.cindex(df, "x").collect()[0]
    assert got.pairs == pairs and abs(got.cindex - agree / pairs) < 1e-12
    whole = df.withColumn("event", F.lit(1))
    t0 = 0.5
    cases, controls = [r[3] for r in rows if r[1] <= t0], [r[3] for r in rows if r[1] > t0]
    plain = np.mean([(a > b) + 0.5 * (a == b) for a in cases for b in controls])
    assert abs(sv.time_auc(whole, t0, "x").collect()[0].auc - plain) < 1e-9


def test_km_without_censoring(spark):
    df = spark.createDataFrame([(float(t), 1) for t in (1, 2, 2, 3, 4)], "time double, event int")
    got = {r.time: r.surv for r in sv.km(df).collect()}
    assert all(abs(got[t] - s) < 1e-12 for t, s in {0.0: 1, 1.0: 0.8, 2.0: 0.4, 3.0: 0.2, 4.0: 0}.items())


def test_moderated_t_finds_planted_genes(spark):
    rng = np.random.default_rng(2)
    rows, meta = [], [(0, s, s % 2) for s in range(10)]
    for g in range(200):
        for _, s, grp in meta:
            rows.append((0, g, s, float(rng.normal(8, 0.4) + (2 if g < 10 and grp else 0))))
    matrix = spark.createDataFrame(rows, "dataset int, gene int, sample int, value double")
    design = spark.createDataFrame([(d, s, 1.0, float(g)) for d, s, g in meta], "dataset int, sample int, one double, x double")
    tests = ex.de_call(ex.bh_fdr(ex.moderated_t(ex.squeeze_var(ex.lm_fit(matrix, design, ["one", "x"], 1))), ["dataset"]))
    up = {r.gene for r in tests.where("sig = 'Up'").collect()}
    assert set(range(10)) <= up and len(up) <= 13
    assert all(r.fdr >= r.p for r in tests.collect())


def test_primer_rules(spark):
    one = spark.createDataFrame([("ACGTACGTGGCCAATTCCGG", "AAAAGC", "ACGT")], "a string, b string, c string")
    r = one.select(sq.reverse_complement(F.col("a")).alias("rc"), sq.longest_run(F.col("b")).alias("run"), sq.dimer("c", "c").alias("d"), sq.gc_fraction(F.col("c")).alias("gc")).collect()[0]
    assert r.rc == "CCGGAATTGGCCACGTACGT" and r.run == 4 and r.d == 4 and r.gc == 0.5
    assert sq.complementary_stretch("AAAC", "GTTT") == 4


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sets.gmt").write_text("T1\tdesc\tA,1.0\tB\t\nT2\td\tC\n")
    (tmp_path / "blast.txt").write_text("# head\n" + "\t".join(["G_F", "s1", "100", "20", "0", "0", "1", "20", "5", "24", "1e-5", "40"]) + "\nshort\tline\n")
    (tmp_path / "series.txt").write_text('!Sample_title\t"p1 C1D1"\t"p2 C1D1"\n!Sample_geo_accession\t"GSM1"\t"GSM2"\n!series_matrix_table_begin\n"ID_REF"\t"GSM1"\t"GSM2"\nprobe1\t1.5\t2.5\n!series_matrix_table_end\n')
    (tmp_path / "wide.txt").write_text("gene\tc1\tc2\ng1\t0\t3\ng2\t4\t0\n")
    (tmp_path / "primers.fa").write_text(">G_F\nACGTACGTAC\n>G_R\nACGTAC\n")
    return tmp_path


def test_readers(spark, folder):
    assert {(r.term, r.gene) for r in readers.read_gmt(spark, str(folder / "sets.gmt"), "L").collect()} == {("T1", "A"), ("T1", "B"), ("T2", "C")}
    assert [(r.q, r.pid) for r in readers.read_blast(spark, str(folder / "blast.txt")).collect()] == [("G_F", 100.0)]
    values, titles = readers.read_series_matrix(spark, str(folder / "series.txt"))
    assert {(r.probe, r.sample, r.value) for r in values.collect()} == {("probe1", "GSM1", 1.5), ("probe1", "GSM2", 2.5)}
    assert {(r.sample, r.title) for r in titles.collect()} == {("GSM1", "p1 C1D1"), ("GSM2", "p2 C1D1")}
    assert {(r.row, r.column, r.value) for r in readers.read_wide_matrix(spark, str(folder / "wide.txt")).collect()} == {("g1", "c2", 3.0), ("g2", "c1", 4.0)}
    assert {(r.q, r.plen) for r in readers.read_fasta_lengths(spark, str(folder / "primers.fa")).collect()} == {("G_F", 10), ("G_R", 6)}
    df = spark.createDataFrame([("a|b", 1)], "k string, v int")
    readers.write_results(readers.split_keys(df, "k", ["x", "y", "z"]), str(folder / "out"), ["x"])
    assert [tuple(r) for r in spark.read.parquet(str(folder / "out")).select("x", "y", "z", "v").collect()] == [("a", "b", None, 1)]


def test_penalised_cox_path_is_optimal(spark):
    rng = np.random.default_rng(5)
    n, names = 160, ["x0", "x1", "x2"]
    x = rng.normal(size=(n, 3))
    time = np.ceil(rng.exponential(np.exp(-0.9 * x[:, 0] + 0.4 * x[:, 1])) * 8)  # many ties
    event = (rng.random(n) < 0.7).astype(float)
    rows = spark.createDataFrame([(i, float(time[i]), float(event[i]), *map(float, x[i])) for i in range(n)], "id long, time double, event double, x0 double, x1 double, x2 double")
    path = sv.lasso_cox(rows, names, k=3, n_lambda=5).orderBy("i").collect()

    def gradient(beta):
        w = np.exp(x @ beta)
        out = np.zeros(3)
        for i in np.nonzero(event)[0]:
            risk = time >= time[i]
            out += x[i] - (w[risk, None] * x[risk]).sum(axis=0) / w[risk].sum()
        return out / n

    top = np.abs(gradient(np.zeros(3))).max()
    assert np.allclose([r["lambda"] for r in path], top * np.logspace(0, -2.5, 5))
    assert sum(r.best for r in path) == 1 and min(path, key=lambda r: r.deviance).best
    for r in path:
        beta = np.array([r[c] for c in names])
        assert sv.optimality_gap(beta, gradient(beta), r["lambda"]) <= 2e-4 * top
    assert all(path[0][c] == 0 for c in names) and all(path[-1][c] != 0 for c in ("x0", "x1"))


def test_nearest_atoms(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(60, 3)) * 9, rng.normal(size=(40, 3)) * 6
    a[0] = [900.0, -900.0, 5.0]  # far from all others
    atoms = spark.createDataFrame([(i % 4, i, *map(float, v)) for i, v in enumerate(a)], "mol int, atom int, x double, y double, z double")
    ref = spark.createDataFrame([tuple(map(float, v)) for v in b], "x double, y double, z double")
    got = {r.atom: r.d for r in sc.nearest_atoms(atoms, ref).collect()}
    want = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).min(axis=1)
    assert len(got) == 60 and all(abs(got[i] - want[i]) < 1e-9 for i in range(60))
    assert sc.nearest_atoms(atoms, ref.limit(0)).count() == 0


def test_distances_along_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(80)], "src int, dst int")
    found = nw.distances(edges, spark.createDataFrame([(0,)], "v int"))
    assert {(r.v, r.hops) for r in found.collect()} == {(i, i) for i in range(81)}


def test_places_without_a_window_over_all_rows(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "id int, k int").repartition(5)
    assert all(r.i == r.k + 1 for r in scan.numbered(rows, "i", [], ["k"]).collect())
    assert scan.numbered(rows.limit(0), "i", [], ["k"]).count() == 0
