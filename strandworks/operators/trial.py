"""Paired and unpaired rank tests by comparison, and the recodes of clinical tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.functions.columns import average_rank, known
from strandworks.functions.tails import normal_two_sided, t_pvalue

#: Pairs up to which the signed-rank null is exact, and smaller-group size up to which the rank-sum null is.
EXACT_PAIRS, EXACT_GROUP = 50, 8


def signed_rank_p(w: float, n: int, ties: float, zeros: int) -> float:
    """Two-sided p of a signed-rank sum: exact without ties and zeros, else normal with tie correction."""
    if n == 0:
        return 1.0
    if n <= EXACT_PAIRS and not ties and not zeros:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + np.concatenate([ways[: len(ways) - r]])
        ways /= ways.sum()
        k = int(round(w))
        return float(min(1.0, 2 * min(ways[: k + 1].sum(), ways[k:].sum())))
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(normal_two_sided(np.array([(w - n * (n + 1) / 4) / np.sqrt(spread)]))[0])


def rank_sum_p(u: float, a: int, b: int, ties: float) -> float:
    """Two-sided p of a rank-sum U: exact if the smaller group is small and nothing is tied, else normal."""
    if min(a, b) <= EXACT_GROUP and not ties:
        ways = np.zeros((a + 1, a * b + 1))
        ways[0, 0] = 1
        for j in range(1, a + b + 1):  # the j-th smallest value goes to the first group or not
            for i in range(min(a, j), 0, -1):
                gain = j - i  # values of the other group below it
                if gain <= b:
                    ways[i, gain:] += ways[i - 1, : a * b + 1 - gain] if gain else ways[i - 1]
        null = ways[a] / ways[a].sum()
        k = int(max(u, a * b - u))
        return float(min(1.0, 2 * null[k:].sum()))
    n = a + b
    spread = a * b / 12 * (n + 1 - ties / (n * (n - 1)))
    z = (max(u, a * b - u) - a * b / 2 - 0.5) / np.sqrt(spread)
    return float(min(1.0, normal_two_sided(np.array([max(z, 0.0)]))[0]))


@F.pandas_udf(T.DoubleType())
def _signed_rank(w: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(float(a), int(b), float(c), int(d)) for a, b, c, d in zip(w, n, ties, zeros, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _rank_sum(u: pd.Series, a: pd.Series, b: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_p(float(x), int(i), int(j), float(t)) for x, i, j, t in zip(u, a, b, ties, strict=True)], dtype=float)


def paired_changes(scores: DataFrame, by: list[str], first: Column, second: Column) -> DataFrame:
    """Each patient's mean at the second timepoint less that at the first; patients need both."""
    wide = scores.groupBy(*by, "patient").agg(F.avg(F.when(first, F.col("score"))).alias("x"), F.avg(F.when(second, F.col("score"))).alias("y"))
    return wide.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*by, "patient", (F.col("y") - F.col("x")).alias("d"))


def paired_wilcoxon(changes: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """n, median change, W (the smaller rank sum) and p of each group with at least ``least`` pairs; zeros are dropped from the ranks."""
    sizes = changes.groupBy(*by).agg(F.count("*").alias("n"), F.median("d").alias("median_change"), F.count_if(F.col("d") == 0).alias("zeros")).where(F.col("n") >= least)
    kept = changes.where(F.col("d") != 0).withColumn("a", F.abs("d"))
    ranked = kept.withColumn("r", average_rank("a", by)).withColumn("t", F.count(F.lit(1)).over(Window.partitionBy(*by, "a")))
    sums = ranked.groupBy(*by).agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(F.lit(0.0))).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(F.lit(0.0))).alias("minus"), F.count("*").alias("m"), F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"))
    out = sizes.join(sums, by, "left").withColumn("w", F.coalesce(F.least("plus", "minus"), F.lit(0.0)))
    return out.withColumn("p", _signed_rank("w", F.coalesce("m", F.lit(0)), F.coalesce("ties", F.lit(0.0)), "zeros")).select(*by, "n", "median_change", "w", "p")


def mann_whitney(df: DataFrame, by: list[str], value: str = "score", group: str = "group", least: int = 4) -> DataFrame:
    """n1, n0, medians, U and AUC of group 1 over group 0, and p; groups with fewer than ``least`` on a side go."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranked = rows.withColumn("r", average_rank(value, by)).withColumn("t", F.count(F.lit(1)).over(Window.partitionBy(*by, value)))
    one = F.col(group) == 1
    sums = ranked.groupBy(*by).agg(F.count_if(one).alias("n1"), F.count_if(~one).alias("n0"), F.sum(F.when(one, F.col("r"))).alias("s"), F.median(F.when(one, F.col(value))).alias("median1"), F.median(F.when(~one, F.col(value))).alias("median0"), F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties")).where((F.col("n1") >= least) & (F.col("n0") >= least))
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2
    out = sums.withColumn("u", u).withColumn("auc", F.col("u") / (F.col("n1") * F.col("n0")))
    return out.withColumn("p", _rank_sum("u", "n1", "n0", "ties")).select(*by, "n1", "n0", "median1", "median0", "u", "auc", "p")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation within groups, its number of rows, and p by t with two degrees of freedom less."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("rx", average_rank(x, by)).withColumn("ry", average_rank(y, by))
    out = ranked.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))
    df = (F.col("n") - 2).cast("double")
    return out.withColumn("p", t_pvalue(F.when(F.col("n") > 2, F.try_divide(F.col("rho") * F.sqrt(F.greatest(df, F.lit(0.0))), F.sqrt(F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(0.0))))), df))


def parse_title(df: DataFrame, title: str = "title") -> DataFrame:
    """patient and timepoint from titles such as ``patient_timepoint_barcode``."""
    part = F.split(F.col(title), "_")
    return df.withColumn("patient", F.get(part, F.lit(0))).withColumn("timepoint", F.get(part, F.lit(1)))


def receptor_cohort(df: DataFrame, er: str, her2: list[str]) -> DataFrame:
    """Rows with a positive receptor, none of the other markers positive, a positive time and a known event.

    A missing marker is not positive; a missing receptor is not positive either.
    """
    none = ~known(F.lower(F.col(her2[0])) == "positive")
    for c in her2[1:]:
        none = none & ~known(F.lower(F.col(c)) == "positive")
    return df.where(known(F.lower(F.col(er)) == "positive") & none & known(F.col("time") > 0) & F.col("event").isNotNull())


def stage_group(stage: Column) -> Column:
    """III-IV, II, I or null from a stage's text; the order of the tests matters, as I is in every name."""
    return F.when(stage.rlike("IV|III"), "III-IV").when(stage.contains("II"), "II").when(stage.contains("Stage I"), "I")


def eav_cohort(eav: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """One row an entity with the named attributes as columns; a repeated attribute keeps its smallest value."""
    return eav.where(F.col("attr").isin(attributes)).groupBy(key).pivot("attr", attributes).agg(F.min("value"))


def cancer_cells(annotation: DataFrame) -> DataFrame:
    """Cells whose type names cancer, in any case; a missing type does not."""
    return annotation.where(known(F.lower("type").contains("cancer"))).select("cell")
