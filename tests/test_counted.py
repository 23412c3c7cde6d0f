"""The large tables behind the model queries are read once."""

from __future__ import annotations

from strandworks.plans import network_queries as nq
from strandworks.plans.views import view


def test_counts_are_summed_once(spark):
    asked = []

    def v(name):
        asked.append(name)
        return view(spark, "/root/testdata/sf0.001", name)

    df, genes = nq.labelled(v)
    assert asked == ["v_counts"] and df.columns == ["id", *genes, "y", "dataset"]
