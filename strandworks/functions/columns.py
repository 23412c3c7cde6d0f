"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """A double with NaN and infinities made null, as aggregates skip nulls only."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def known(c: Column) -> Column:
    """A condition whose unknown outcome counts as false, so that it can be negated."""
    return F.coalesce(c, F.lit(False))


def nearest(c: Column, digits: int) -> Column:
    """``round`` without its decimal numbers, which cost more than the sums they round.

    A value well away from a tie goes to the nearest whole number of units; the others, and large ones, go by ``round``.
    """
    units = c * F.lit(10.0**digits)
    sure = (F.abs(units) < 1e12) & (F.abs(F.abs(units - F.rint(units)) - 0.5) > 1e-3)
    return F.when(sure, F.rint(units) / F.lit(10.0**digits)).otherwise(F.round(c, digits))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, without negative zeros."""
    return df.select(*((nearest(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def average_rank(value: str, by: list[str]) -> Column:
    """The rank of a value in its group, ties sharing the mean of their ranks."""
    tied = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (tied - 1) / F.lit(2.0)


def log_factorials(spark, n: int) -> DataFrame:
    """``k`` and ``lf`` = ln(k!) for k up to n, as running sums over a range."""
    row = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return spark.range(n + 1).select(F.col("id").alias("k")).withColumn("lf", F.sum(F.when(F.col("k") > 0, F.ln(F.col("k").cast("double"))).otherwise(F.lit(0.0))).over(row))
