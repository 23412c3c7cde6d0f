"""Gene-set enrichment: over-representation and preranked running sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.columns import log_factorials
from strandworks.operators.expression import bh_fdr


def ora(query: DataFrame, sets: DataFrame, universe: DataFrame, least: int = 10, most: int = 500) -> DataFrame:
    """Hypergeometric over-representation of each (direction, library, term).

    ``query``: direction and gene; ``sets``: library, term, gene; ``universe``: gene. Sets are cut to the universe
    and gated by size; terms without overlap are left out before the correction.
    """
    spark = query.sparkSession
    space = universe.select("gene").distinct()
    size = space.count()
    members = sets.select("library", "term", "gene").distinct().join(space, "gene", "left_semi")
    gated = members.groupBy("library", "term").agg(F.count("*").alias("set_size")).where(F.col("set_size").between(least, most))
    asked = query.select("direction", "gene").distinct().join(space, "gene", "left_semi")
    n = asked.groupBy("direction").agg(F.count("*").alias("query_size"))
    over = members.join(asked, "gene").groupBy("direction", "library", "term").agg(F.count("*").alias("overlap"), F.array_join(F.array_sort(F.collect_set(F.col("gene").cast("string"))), ";").alias("genes"))
    found = over.join(gated, ["library", "term"]).join(F.broadcast(n), "direction")
    table = F.broadcast(log_factorials(spark, size).agg(F.array_sort(F.collect_list(F.struct("k", "lf"))).alias("t")).select(F.transform("t", lambda x: x["lf"]).alias("lf")))

    def choose(a, b):
        return F.col("lf")[a.cast("int")] - F.col("lf")[b.cast("int")] - F.col("lf")[(a - b).cast("int")]

    total = F.lit(size)
    m, q = F.col("set_size"), F.col("query_size")
    most_over = F.least(m, q)

    def term(k):
        return F.when((q - k) <= (total - m), F.exp(choose(m, k) + choose(total - m, q - k) - choose(total, q))).otherwise(F.lit(0.0))

    p = F.aggregate(F.sequence(F.col("overlap"), most_over), F.lit(0.0), lambda a, k: a + term(k))
    scored = found.crossJoin(table).withColumn("p", F.least(p, F.lit(1.0))).drop("lf")  # one row of constants
    return bh_fdr(scored, ["direction", "library"]).withColumn("fold", F.col("overlap") / F.col("query_size") / (F.col("set_size") / F.lit(float(size))))


def top_terms(results: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def gsea_hits(ranked: DataFrame, sets: DataFrame, least: int = 15, most: int = 500) -> DataFrame:
    """The set members on the ranked list with their positions: term, size, pos, w; sets outside the sizes go.

    ``ranked``: gene and score, one row a gene. The list is ranked once, by descending score, ties by gene.
    """
    place = ranked.select("gene", "score").withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "gene")))
    hits = sets.select("term", "gene").distinct().join(place, "gene").select("term", "pos", F.abs("score").alias("w"))
    sizes = hits.groupBy("term").agg(F.count("*").alias("size"), F.sum("w").alias("total")).where(F.col("size").between(least, most))
    return hits.join(sizes, "term")


def gsea_es(ranked: DataFrame, sets: DataFrame, least: int = 15, most: int = 500) -> DataFrame:
    """Weighted enrichment score of each term: the running sum's value where it is farthest from zero, the first such.

    Between hits the sum only falls, so its extremes stand at hits and just before them: the window runs over hits.
    """
    n = ranked.count()
    hits = gsea_hits(ranked, sets, least, most)
    w = Window.partitionBy("term").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    i = F.row_number().over(Window.partitionBy("term").orderBy("pos"))
    miss = (F.col("pos") - i) / (F.lit(float(n)) - F.col("size"))
    up = F.sum("w").over(w) / F.col("total")
    before = (F.sum("w").over(w) - F.col("w")) / F.col("total")
    ends = hits.select("term", "size", "pos", (up - miss).alias("at"), (before - miss).alias("low"), i.alias("i"))
    both = ends.select("term", "size", (F.col("pos") * 2).alias("o"), F.col("at").alias("d")).unionByName(ends.where(F.col("pos") > 1).select("term", "size", (F.col("pos") * 2 - 1).alias("o"), F.col("low").alias("d")))
    return both.groupBy("term", "size").agg(F.max_by("d", F.struct(F.abs("d"), (-F.col("o")).alias("o"))).alias("es"))


def _null_scores(weights: np.ndarray, size: int, n: int, rng: np.random.Generator) -> np.ndarray:
    """Enrichment scores of n random sets of one size."""
    total = len(weights)
    out = np.empty(n)
    for i in range(n):
        pos = np.sort(rng.choice(total, size, replace=False))
        w = weights[pos]
        hit = np.cumsum(w) / w.sum()
        miss = (pos - np.arange(size)) / (total - size)
        d = np.column_stack([hit - w / w.sum() - miss, hit - miss]).ravel()
        out[i] = d[np.argmax(np.abs(d))]
    return out


def gsea(ranked: DataFrame, sets: DataFrame, permutations: int = 2000, least: int = 15, most: int = 500, seed: int = 2026, block: int = 250) -> DataFrame:
    """Preranked enrichment with random sets as null: term, size, es, nes, p, fdr.

    The null depends on a set's size alone, so sets of one size share it. A task draws one block of random sets of
    one size; its random numbers follow from seed, size and block, so a lost task draws the same again.
    """
    spark = ranked.sparkSession
    es = gsea_es(ranked, sets, least, most)
    weights = np.array([r.w for r in ranked.select(F.abs("score").alias("w"), "score", "gene").orderBy(F.desc("score"), "gene").collect()])  # one number a gene
    shared = spark.sparkContext.broadcast(weights)
    blocks = -(-permutations // block)
    work = es.select("size").distinct().select("size", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, b in zip(batch["size"], batch["b"], strict=True):
                n = min(block, permutations - b * block)
                yield pd.DataFrame({"size": size, "null": _null_scores(shared.value, int(size), n, np.random.default_rng([seed, int(size), int(b)]))})

    null = work.repartition(spark.sparkContext.defaultParallelism, "size", "b").mapInPandas(draw, "size long, null double")
    same = F.signum("null") == F.signum("es")
    tested = es.join(null, "size").groupBy("term", "size", "es").agg(F.avg(F.when(same, F.abs("null"))).alias("mean"), F.count_if(same & (F.abs("null") >= F.abs("es"))).alias("above"), F.count_if(same).alias("same"))
    scored = tested.select("term", "size", "es", F.try_divide("es", "mean").alias("nes"), ((F.col("above") + 1) / (F.col("same") + 1)).alias("p"))
    return bh_fdr(scored, [])
