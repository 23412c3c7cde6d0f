"""Readers whose work must not grow with the square of a line's length."""

from __future__ import annotations

from strandworks.sources import readers as rd


def test_gmt_lines_are_split_once(spark, tmp_path):
    many = [f"g{i}" for i in range(500)]
    (tmp_path / "x.gmt").write_text("one\tdesc\t" + "\t".join(many) + "\t\ntwo\tdesc\ta,1.0\tb \ta\n")
    df = rd.read_gmt(spark, str(tmp_path / "x.gmt"))
    assert sorted(map(tuple, df.collect())) == sorted([("x", "one", g) for g in many] + [("x", "two", "a"), ("x", "two", "b")])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "split(value" not in above and "split(value" in below
