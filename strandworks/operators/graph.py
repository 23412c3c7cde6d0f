"""Graph operators on edge tables: components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.functions import storage

#: Rounds after which components() gives up; each round shortens paths by a factor, so this is never reached in practice.
MAX_ROUNDS = 60


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", cut=None) -> DataFrame:
    """The smallest vertex reachable from each vertex that has an edge.

    ``edges``: undirected pairs; nulls, self-loops and repeats are ignored. Returns ``vertex`` and ``component``.
    Alternates large-star and small-star steps: each step links the neighbours of a vertex to their minimum, so no
    neighbourhood is ever gathered in one row, and a hub costs one row for each of its edges. ``cut``: writes a
    DataFrame to shared storage and cuts its lineage; by default a checkpoint.
    """
    cut = cut or storage.cut
    now = cut(_canonical(edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))))
    sign = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _canonical(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        linked = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(_canonical(linked.unionByName(least.select("u", F.col("m").alias("v")))))
        stat = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if (stat[0], stat[1]) == sign:
            break
        sign = (stat[0], stat[1])
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
