"""Pieces of SQL against closed forms."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from strandworks.plans import trial_queries

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_p_of_large_t_in_the_sql_of_fold_changes():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DATA}/events.parquet')")
    rows = con.execute(trial_queries.QUERIES["q7_fold_change"][1]).df()
    assert set(rows.n) == {3}  # two degrees of freedom: a closed form
    for t, p in zip(rows.t, rows.p, strict=True):
        assert p == pytest.approx(2 / (t * t + 2 + abs(t) * math.sqrt(t * t + 2)), abs=5.01e-7)
