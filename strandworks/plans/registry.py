"""The registered queries of the library and their SQL counterparts."""

from __future__ import annotations

from strandworks.plans import expression_queries, network_queries, source_queries, survival_queries, trial_queries

PARTS = (source_queries, expression_queries, network_queries, survival_queries, trial_queries)


def queries() -> dict:
    out: dict = {}
    for part in PARTS:
        out.update({name: fn for name, (fn, _) in part.QUERIES.items()})
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in PARTS:
        out.update({name: sql for name, (_, sql) in part.QUERIES.items() if sql})
    return out
