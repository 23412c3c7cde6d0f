"""Vector searches against brute force, with vectors that take no part, ties, repeated rows and empty tables."""

import math
from fractions import Fraction
from operator import mul

import numpy as np
from pyspark.sql import functions as F

from strandworks.llm import exact_topk, nn_descent
from strandworks.llm.exact_topk import search_block, top_k
from strandworks.llm.nn_descent import nearest
from strandworks.llm.queries import OP2_SQL

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v int, q int, block int"


def vectors(n=400, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    x = centres[rng.integers(0, 5, n)] + 0.4 * rng.normal(size=(n, dim))
    x[7] = x[3]  # equal vectors
    x[11] = x[3]
    return x.astype(np.float32)


def table(spark, x, more=()):
    rows = [(i, [float(v) for v in r], 0, 1, 2, 3, 4) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, *[(i, v, 0, 1, 2, 3, 4) for i, v in more]], SCHEMA)


ODD = [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [float("nan")] * 8), (1003, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]


def every_pair(rows, score, asks, k=5):
    """(query, rank, id, score): all rows of a query's id meet all rows of other ids."""
    out = []
    for q in sorted({i for i, _ in rows if asks(i)}):
        pairs = sorted((-score(a, b), j) for i, a in rows if i == q for j, b in rows if j != q)
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(pairs[:k])]
    return out


def test_top_k_and_its_sql_with_repeated_ids(spark):
    import duckdb

    x = vectors()
    again = [(0, [float(v) for v in x[0]]), (0, [float(v) for v in x[8]]), (50, [float(v) for v in x[50]]), (13, [float(v) for v in x[13]]), (13, [9.0] * 8)]
    large = [(1005, [1e18] * 8), (1006, [8388607.9] * 8), (1007, [])]
    docs = table(spark, x, [*ODD, *again, *large])
    got = top_k(docs, F.col("id") % 50 == 0).collect()
    rows = [(i, [int(u) for u in np.floor(256 * np.array(v, np.float32).astype(float))]) for i, v in [*enumerate(x), *again, *large[:2]]]
    want = every_pair(rows, lambda a, b: min(max(sum(map(mul, a, b)), 1 - 2**63), 2**63 - 1), lambda i: i % 50 == 0)
    # an empty vector scores 0 and belongs to no query's best
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    embeddings = docs.where("size(embedding) > 0").select("vec_id", "embedding").toArrow()  # noqa: F841
    assert sorted((q, r, j, s) for q, r, j, s in duckdb.sql(OP2_SQL).fetchall()) == want


def test_top_k_sends_no_block_that_is_too_short(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK", 20)
    sent = []
    full = exact_topk._long_enough
    monkeypatch.setattr(exact_topk, "_long_enough", lambda *a: sent.append(full(*a).count()) or full(*a))
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(400, 8)) * np.exp(-np.arange(400) / 40)[:, None]).astype(np.float32)
    got = top_k(table(spark, x).repartition(3), F.col("id") % 20 == 0).collect()
    rows = [(i, np.floor(256 * v.astype(float)).astype(np.int64)) for i, v in enumerate(x)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == every_pair(rows, lambda a, b: int(a @ b), lambda i: i % 20 == 0)
    assert len(sent) > 2 and sum(sent) <= 40  # of 60 pairs of blocks and more


def test_top_k_over_many_blocks(spark, monkeypatch):
    """Every pair of blocks meets, in whatever partition its key falls."""
    monkeypatch.setattr(exact_topk, "BLOCK", 40)
    monkeypatch.setattr(exact_topk, "QUERIES", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        x = vectors()
        ints = np.floor(256 * x.astype(float)).astype(np.int64)
        got = top_k(table(spark, x).repartition(3), F.col("id") % 20 == 0).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for i in range(0, 400, 20):
        score = ints @ ints[i]
        want += [(i, int(j)) for j in [j for j in np.lexsort((np.arange(400), -score)) if j != i][:5]]
    assert sorted((r.query_id, r.vec_id) for r in got) == sorted(want)


def test_top_k_small_and_empty(spark):
    x = vectors(20)[:3]
    assert top_k(table(spark, x), F.col("id") == 0).count() == 2
    assert top_k(table(spark, x[:0]), F.col("id") == 0).count() == 0
    assert top_k(table(spark, x), F.col("id") == 99).count() == 0


def test_top_k_of_very_long_vectors(spark):
    """Lengths from 2^31 on take part: products up to a long are exact, those beyond are set to its ends."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(80, 4)) * np.array([1.0, 1e7, 1e9, 1e14])[rng.integers(0, 4, 80)][:, None]
    x[5], x[6], x[7] = 1e30, -1e30, 1e200
    rows = [(i, [float(v) for v in x[i]]) for i in range(80)] + [(80, [math.inf, 0.0, 0.0, 0.0]), (81, [math.nan, 0.0, 0.0, 0.0]), (82, [1e300, 0.0, 0.0, 0.0]), (83, None)]
    whole = {i: [math.floor(Fraction(v) * 256) for v in x[i]] for i in range(80) if i != 7}
    whole[7] = [math.floor(Fraction(v) * 256) for v in x[7]] if 256 * 1e200 < 2.0**400 else None
    whole = {i: v for i, v in whole.items() if v is not None}
    got = {}
    for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 4 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, 80, 4):
        scores = {i: min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), 1 - 2**63), 2**63 - 1) for i, v in whole.items() if i != q}
        assert got[q] == sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:5]
    assert set(got) == set(range(0, 80, 4))


def test_search_block_prunes_nothing_that_counts():
    rng = np.random.default_rng(3)
    c = rng.integers(-300, 300, (2000, 16))
    q = rng.integers(-300, 300, (30, 16))
    _, basis = np.linalg.eigh((c.T @ c).astype(float))
    found = search_block(np.arange(30) + 5000, q, np.full(30, -np.inf), np.arange(2000), c, np.ascontiguousarray(basis[:, ::-1]), 5)
    score = q @ c.T
    want = [(5000 + i, int(j), int(score[i, j])) for i in range(30) for j in np.lexsort((np.arange(2000), -score[i]))[:5]]
    assert sorted(found) == sorted(want)


def recall(got, x, asks, ids=None):
    ids = np.arange(len(x)) if ids is None else ids
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = []
    for q in sorted({int(i) for i in ids if asks(i)}):
        s = np.sort(np.concatenate([(unit @ unit[a])[ids != q] for a in np.nonzero(ids == q)[0]]))[::-1][:5]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and q not in {j for _, j, _ in found}
        hits.append(sum(score >= s[-1] - 1e-9 for _, _, score in found) / 5)
        for _, j, score in found:
            assert min(abs(unit[a] @ unit[b] - score) for a in np.nonzero(ids == q)[0] for b in np.nonzero(ids == j)[0]) < 1e-9
    return np.mean(hits)


def by_query(rows):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


def test_nearest(spark):
    x = vectors(600)
    again = [(5, x[5]), (20, x[21]), (40, x[40]), (41, -x[40])]
    more = [*ODD, (1004, [0.0] * 8), *((i, [float(c) for c in v]) for i, v in again)]
    got = by_query(nearest(table(spark, x, more), F.col("id") % 20 == 0).collect())
    rows = np.concatenate([x, np.array([v for _, v in again])])
    assert recall(got, rows, lambda i: i % 20 == 0, np.array([*range(600), *(i for i, _ in again)])) >= 0.95


def test_descent_carries_the_recall(spark):
    """20,000 vectors with hardly any structure: the first graph is poor, the rounds make it good."""
    x = np.random.default_rng(7).normal(size=(20_000, 32)).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    nodes = nn_descent._nodes(nn_descent.sound_vectors(docs, "vec_id", "embedding"), 32, 5)
    names = {r.node: r.ids[0].id for r in nodes.select("node", "ids").collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = []
    for rounds in (0, 30):
        near = {}
        for e in nn_descent.build_graph(nodes, 32, rounds=rounds).collect():
            near.setdefault(names[e.u], set()).add(names[e.v])
        assert len(near) == 20_000 and all(len(v) == nn_descent.DEGREE and u not in v for u, v in near.items())
        found.append(np.mean([len(near[q] & set(np.argsort(-(unit @ unit[q]))[1:6].tolist())) / 5 for q in range(0, 20_000, 200)]))
    assert found[0] < 0.6 and found[1] >= 0.9, found


def test_nearest_copies_and_empty(spark):
    x = np.tile(vectors(20)[:4], (30, 1))
    got = nearest(table(spark, x), F.col("id") == 9).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 5, 13, 17, 21]
    assert nearest(table(spark, x[:0]), F.col("id") == 0).count() == 0
    assert nearest(table(spark, x[:1]), F.col("id") == 0).count() == 0
