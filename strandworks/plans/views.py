"""Domain tables derived from the driver tables by integer arithmetic.

Each view is one SQL text for both engines: ``DIV`` is whole-number division, table names stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels")

VIEWS: dict[str, str] = {
    "v_counts": """
SELECT s % 3 AS dataset, gene, s AS sample, (s DIV 3) % 2 AS grp, ((s DIV 3) DIV 2) % 2 AS cell,
       CAST(CASE WHEN (gene + s) % 17 = 0 THEN 0 WHEN gene % 20 = 7 THEN q DIV 100
                 WHEN gene % 10 = 0 AND (s DIV 3) % 2 = 1 THEN q * 3 ELSE q END AS DOUBLE) AS count
FROM (SELECT l_partkey % 200 AS gene, l_orderkey % 24 AS s, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
      FROM {lineitem} GROUP BY l_partkey % 200, l_orderkey % 24) t""",
    "v_meta": "SELECT DISTINCT dataset, sample, grp, cell FROM {v_counts}",
    "v_cells": """
SELECT o_custkey % 45 AS biopsy, l_orderkey AS cell, l_partkey % 100 AS gene, CAST(l_quantity AS DOUBLE) AS count
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "v_cohort": """
SELECT id, round(days / 365.25, 6) AS time, event, age, stage, risk FROM (
  SELECT o_custkey AS id, CAST(max(d) - min(d) AS DOUBLE) AS days, max(CASE WHEN r = 1 THEN e END) AS event,
         max(CAST(c_custkey % 50 + 30 AS DOUBLE)) AS age, max(CASE c_mktsegment WHEN 'BUILDING' THEN 'Stage I' WHEN 'MACHINERY' THEN 'Stage IIA' ELSE 'Stage IIIB' END) AS stage,
         max(round(c_acctbal / 1000.0, 1)) AS risk
  FROM (SELECT o_custkey, {days(o_orderdate)} AS d, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM {orders}) o
  JOIN {customer} ON o_custkey = c_custkey GROUP BY o_custkey) t
WHERE days > 0""",
    "v_sets": """
SELECT 'brand' AS library, p_brand AS term, p_partkey AS gene FROM {part}
UNION ALL SELECT 'type' AS library, p_type AS term, p_partkey AS gene FROM {part}""",
    "v_pairs": """
SELECT a, b, CAST(n AS DOUBLE) / max(n) OVER () AS score FROM (
  SELECT x.k AS a, y.k AS b, count(*) AS n
  FROM (SELECT DISTINCT l_orderkey AS o, l_partkey % 150 AS k FROM {lineitem}) x
  JOIN (SELECT DISTINCT l_orderkey AS o, l_partkey % 150 AS k FROM {lineitem}) y ON x.o = y.o AND x.k < y.k
  GROUP BY x.k, y.k) t""",
    "v_tests": """
SELECT p_partkey % 3 AS dataset, p_partkey DIV 3 AS gene, (CAST(p_partkey * 7919 % 997 AS DOUBLE) + 1) / 998 AS p,
       (CAST(p_size AS DOUBLE) - 25) / 10 AS b FROM {part} WHERE p_size <> 25""",
    "v_hits": """
SELECT concat('g', CAST(l_partkey % 20 AS STRING), CASE WHEN l_linenumber % 2 = 0 THEN '_F' ELSE '_R' END) AS q, l_orderkey % 500 AS s,
       90.0 + l_quantity % 11 AS pid, CAST(18 + l_suppkey % 4 AS DOUBLE) AS alen, CAST(18 + l_partkey % 4 AS DOUBLE) AS qe,
       CAST(l_orderkey % 3000 AS DOUBLE) AS ss, CAST(l_orderkey % 3000 + CASE WHEN l_linenumber % 4 < 2 THEN 20 ELSE -20 END AS DOUBLE) AS se, 20 AS plen
FROM {lineitem}""",
    "v_plate": """
SELECT concat('s', CAST(u AS STRING)) AS sample, CASE WHEN u DIV 6 = 0 THEN 'A' ELSE 'B' END AS model,
       CASE WHEN (u DIV 3) % 2 = 0 THEN 'parental' ELSE 'resistant' END AS condition, u % 3 AS replicate, concat('G', CAST(g AS STRING)) AS gene,
       CASE w WHEN 0 THEN 'std' WHEN 1 THEN 'noRT' WHEN 2 THEN 'NTC' ELSE 'sample' END AS well_type,
       CAST(CASE WHEN w = 0 THEN CASE e DIV 10 % 5 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 100 WHEN 3 THEN 1000 ELSE 10000 END END AS DOUBLE) AS dilution,
       CASE WHEN w = 0 THEN 38 - CASE e DIV 10 % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 3.4 WHEN 2 THEN 6.8 WHEN 3 THEN 10.2 ELSE 13.6 END + CAST(e % 13 AS DOUBLE) / 200
            WHEN w = 1 OR w = 2 THEN 27.0 + e % 12
            ELSE 20 + g * 0.5 + CASE WHEN (u DIV 3) % 2 = 1 AND g < 6 THEN 1.5 ELSE 0 END + CAST(e % 29 AS DOUBLE) / 40 + CASE WHEN e % 31 = 0 THEN 16 ELSE 0 END END AS cq
FROM (SELECT event_id AS e, user_id % 12 AS u, event_id % 10 AS g, CASE WHEN event_id % 50 < 3 THEN 3 WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 23 = 1 THEN 1 WHEN event_id % 41 = 2 THEN 2 ELSE 3 END AS w FROM {events}) t""",
    "v_atoms": """
SELECT vec_id AS mol, CONCAT('R', CAST(label AS STRING)) AS res, round(CAST({item(embedding,1)} AS DOUBLE) * 20, 3) AS x, round(CAST({item(embedding,2)} AS DOUBLE) * 20, 3) AS y,
       round(CAST({item(embedding,3)} AS DOUBLE) * 20, 3) AS z, CASE vec_id % 4 WHEN 0 THEN 'OA' WHEN 1 THEN 'C' WHEN 2 THEN 'N' ELSE 'HD' END AS atype FROM {embeddings}""",
    "v_ligands": """
SELECT p_partkey AS id, concat('cmp', CAST(p_partkey % 700 AS STRING)) AS name, concat('C', CAST(p_partkey % 900 AS STRING)) AS smiles, p_partkey % 11 DIV 10 AS withdrawn,
       p_size + 5 AS heavy, CAST(100 + p_partkey % 650 AS DOUBLE) AS mw, CAST(p_size AS DOUBLE) / 7 AS logp, p_size % 8 AS hbd, p_size % 13 AS hba, p_size % 9 AS rotb,
       CASE WHEN p_partkey % 19 = 3 THEN NULL ELSE (CAST(p_partkey * 31 % 97 AS DOUBLE) - 97) / 10 END AS score FROM {part}""",
    "v_pred": """
SELECT c_custkey AS id, CAST(c_custkey % 3 = 0 AS INT) AS y, c_custkey % 4 AS dataset,
       CAST((c_custkey * 37 % 101) + CASE WHEN c_custkey % 3 = 0 THEN 20 ELSE 0 END AS DOUBLE) / 121 AS p FROM {customer}""",
    "v_scores": """
SELECT user_id % 40 AS patient, user_id % 40 % 2 AS arm, event_id % 3 AS timepoint, user_id % 40 DIV 2 % 2 AS response,
       CAST(event_id * 13 % 1009 AS DOUBLE) / 100 + CASE WHEN event_id % 3 = 1 THEN user_id % 40 % 5 ELSE 0 END AS score FROM {events}""",
}
NEEDS = {"v_meta": ("v_counts",)}


def _expand(text: str, spark: bool) -> str:
    text = re.sub(r"\{days\((\w+)\)\}", r"unix_date(to_date(\1))" if spark else r"datediff('day', DATE '1970-01-01', CAST(\1 AS DATE))", text)
    text = re.sub(r"\{item\((\w+),(\d)\)\}", lambda m: f"{m[1]}[{int(m[2]) - 1 if spark else m[2]}]", text)
    return text if spark else text.replace(" DIV ", " // ").replace("AS STRING", "AS VARCHAR")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view, or a driver table under its own name."""
    if name in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _expand(VIEWS[name], True)
    used = {m for m in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **{u: view(spark, sf_dir, u) for u in used})


def with_views(body: str) -> str:
    """DuckDB SQL for a query over views: those it names come first as common tables."""
    named: list[str] = []

    def add(v: str) -> None:
        for need in NEEDS.get(v, ()):
            add(need)
        if v not in named:
            named.append(v)

    for v in VIEWS:
        if re.search(rf"\b{v}\b", body):
            add(v)
    tables = [f"{v} AS ({re.sub(r'[{}]', '', _expand(VIEWS[v], False))})" for v in named]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join([*tables, body[14:].strip()])
    if body.upper().startswith("WITH"):
        return "WITH " + ",\n".join([*tables, body[4:].strip()])
    return ("WITH " + ",\n".join(tables) + "\n" if tables else "") + body
