"""Steps that were made cheaper give what they gave, row by row."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from strandworks.functions.columns import nearest
from strandworks.operators import expression as ex
from strandworks.operators import screen as sc
from strandworks.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_is_round(spark):
    r = random.Random(6)
    xs = [0.0, -0.0, None, float("nan"), float("inf"), -float("inf"), 0.5e-6, 1.5e-6, -2.5e-6, 1e7 + 0.1234565, 1e300, 2.675, 1.0000005, -3.9999995, *(r.uniform(-10, 10) * 10 ** r.randint(-9, 9) for _ in range(3000)), *(r.randint(-(10**8), 10**8) / 10**7 for _ in range(3000))]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(nearest(F.col("x"), d).alias(f"a{d}") for d in (4, 6)), *(F.round("x", d).alias(f"b{d}") for d in (4, 6)))
    for row in df.collect():
        for d in (4, 6):
            a, b = row[f"a{d}"], row[f"b{d}"]
            assert a == b or (a != a and b != b), row


def test_atom_pairs_are_dealt_within_a_cube(spark):
    r = random.Random(7)
    at = lambda: [round(r.uniform(-5, 5), 3) for _ in range(3)]
    lig = [(i % 4, *at(), "N") for i in range(60)] + [(9, 0.0, 0.0, 0.0, "C"), (9, 1.0, 0.0, 0.0, "C")]
    rec = [(f"R{i}", *at(), "O") for i in range(80)] + [("E", 4.0, 0.0, 0.0, "C"), ("E", 0.0, 3.999, 0.0, "C")]
    pairs = sc.atom_pairs(spark.createDataFrame(lig, "mol int, x double, y double, z double, atype string"), spark.createDataFrame(rec, "res string, x double, y double, z double, atype string"))
    want = sorted((a[0], b[0], round(math.dist(a[1:4], b[1:4]), 9)) for a in lig for b in rec if math.dist(a[1:4], b[1:4]) < 4)
    assert sorted((x.mol, x.res, round(x.d, 9)) for x in pairs.collect()) == want
    assert "block" in plan(pairs) and "POWER" not in plan(pairs).upper()


def test_pseudobulk_deals_rows_by_cell_once(spark):
    r = random.Random(8)
    rows = [(r.choice("abc"), i % 50, r.randrange(6), float(r.randrange(5))) for i in range(900)]  # genes repeat, cells lie in several biopsies
    rows += [("d", 100 + i, 1, 2.0) for i in range(3)] + [("e", 200, 7, 0.0), ("a", 200, 2, 0.0), ("a", None, 1, 9.0), (None, 7, 1, 4.0), ("b", 8, 3, None), ("b", 8, None, 5.0)]
    held = [x for x in rows if x[1] is not None]
    totals, sums, cells = {}, {}, {}
    for biopsy, cell, gene, count in held:
        totals[cell] = totals.get(cell, 0.0) + (count or 0.0)
        cells.setdefault(biopsy, set()).add(cell)
        sums[biopsy, gene, cell] = sums.get((biopsy, gene, cell), 0.0) + (count or 0.0)
    want = {}
    for (biopsy, gene, cell), count in sums.items():
        if biopsy is not None and len(cells[biopsy]) >= 4:
            want[biopsy, gene] = want.get((biopsy, gene), 0.0) + (math.log2(count / totals[cell] * 1e6 + 1) if totals[cell] else 0.0) / len(cells[biopsy])
    counts = spark.createDataFrame(rows, "biopsy string, cell long, gene int, count double")
    got = {(x.biopsy, x.gene): x for x in ex.pseudobulk(counts, least_cells=4).collect()}
    assert {k: round(x["value"], 9) for k, x in got.items()} == {k: round(x, 9) for k, x in want.items()}
    assert all(x.n_cells == len(cells[b]) for (b, _), x in got.items())
    # with the cells in a table of their own: those without any count are cells too
    single, members = counts.where("biopsy in ('d', 'e')").drop("biopsy"), spark.createDataFrame([("d", 100 + i) for i in range(5)], "biopsy string, cell long")
    asked = ex.pseudobulk(single, members, spark.createDataFrame([(1,), (2,)], "gene int"), least_cells=4).collect()
    assert [(x.biopsy, x.gene, round(x["value"], 9), x.n_cells) for x in asked] == [("d", 1, round(3 * math.log2(1e6 + 1) / 5, 9), 5)]


def test_pseudobulk_query_joins_once_and_sums_no_rows_beside_the_join(spark):
    shown = plan(registry.queries()["a4_pseudobulk"](spark, "/root/testdata/sf0.001"))
    assert shown.count("Join Inner") == 1 and shown.count("RepartitionByExpression") == 1
