"""Melting temperatures of whole batches against a plain sum of each sequence."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from strandworks.operators import sequence as sq


def plain_temp(seq: str) -> float | None:
    if len(seq) < 2 or set(seq) - set("ACGT"):
        return None
    comp = str.maketrans("ACGT", "TGCA")
    pairs = [sq.NEIGHBOURS.get(d) or sq.NEIGHBOURS[d[::-1].translate(comp)] for d in map("".join, zip(seq, seq[1:], strict=False))]
    h, s = (math.fsum([p[k] for p in pairs] + [sq.ENDS["GC" if c in "GC" else "AT"][k] for c in (seq[0], seq[-1])]) for k in (0, 1))
    salt = math.log((50 + 120 * math.sqrt(3 - 0.8)) / 1000)
    gc = sum(c in "GC" for c in seq) / len(seq)
    return 1 / ((s + 1.987 * math.log(0.2e-6 / 4)) / (h * 1000) + (4.29 * gc - 3.95) * 1e-5 * salt + 9.40e-6 * salt**2) - 273.15


def test_melting_temp_of_all_kinds_of_sequences(spark):
    r = random.Random(5)
    seqs = ["", "A", "AC", "AAAA", "ACGN", "acgt", "ACéT", "GGGGC", None, *("".join(r.choices("ACGT", k=r.randint(2, 60))) for _ in range(300))]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, seq string").coalesce(2).withColumn("tm", sq.melting_temp(F.col("seq")))
    for row in df.collect():
        want = None if row.seq is None else plain_temp(row.seq)
        assert row.tm is None if want is None else row.tm == pytest.approx(want, abs=1e-8), row
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()  # no step of its own for each letter pair of each row
