"""Running sums over ordered rows, spread over tasks.

A window without groups, or with one large group, runs in one task. Here rows are dealt to ranges of their order first;
each range is summed on its own, the ranges' totals give what comes before each range, and that is joined back. The table
of totals has a row for each range and group, of which those are joined back that go on from another range: no more than
there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.storage import cut

PART = "__part"


def ranges_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, by: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """Adds PART, the number of the range that a row belongs to; ranges ascend with ``by`` and then ``order``.

    Rows that are equal in all of these stay in one range. The ranges are drawn from a sample, so they are kept in the
    shared folder: a lost task must find the same ones.
    """
    parts = df.repartitionByRange(ranges or ranges_of(df), *by, *order) if by or order else df.coalesce(1)
    return cut(parts.withColumn(PART, F.spark_partition_id()))


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, down: bool = False) -> DataFrame:
    """Adds running sums, and the last values that are not null, up to and with each row in ``order`` within ``by``; from
    the last row back to each row, if ``down``.

    ``df`` comes from ``spread`` with the same order, or is an aggregate of that by PART and the order's columns. The
    order is unique within ``by``. Nulls add nothing; a sum is null as long as all it has seen is null.
    """
    sums, last = sums or {}, last or {}
    way = F.desc if down else F.asc
    placed = [way(c) for c in order]
    here = Window.partitionBy(PART, *by).orderBy(*placed).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by).orderBy(way(PART)).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    end = Window.partitionBy(PART, *by).orderBy(*placed).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    raw = df.withColumns({f"__raw_{k}": v for k, v in {**sums, **last}.items()})
    if last:
        raw = raw.withColumns({f"__raw_{k}__end": F.last(f"__raw_{k}", ignorenulls=True).over(end) for k in last})
    totals = raw.groupBy(PART, *by).agg(F.count("*").alias("__n"), *(F.sum(f"__raw_{k}").alias(f"__raw_{k}") for k in sums), *(F.max(f"__raw_{k}__end").alias(f"__raw_{k}") for k in last))
    before = totals.select(PART, *by, F.sum("__n").over(whole).alias("__n"), *(F.sum(f"__raw_{k}").over(whole).alias(f"__before_{k}") for k in sums), *(F.last(f"__raw_{k}", ignorenulls=True).over(whole).alias(f"__before_{k}") for k in last))
    carried = before.where(F.col("__n").isNotNull()).drop("__n").withColumnsRenamed({c: f"__{c}_carried" for c in (PART, *by)})
    same = F.lit(True)
    for c in (PART, *by):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}_carried"))
    own = raw.withColumns({**{f"__own_{k}": F.sum(f"__raw_{k}").over(here) for k in sums}, **{f"__own_{k}": F.last(f"__raw_{k}", ignorenulls=True).over(here) for k in last}})
    both = own.join(F.broadcast(carried), same, "left")  # fewer rows than ranges
    found = {k: F.coalesce(F.col(f"__own_{k}") + F.col(f"__before_{k}"), F.col(f"__own_{k}"), F.col(f"__before_{k}")) for k in sums} | {k: F.coalesce(F.col(f"__own_{k}"), F.col(f"__before_{k}")) for k in last}
    kept = [F.col(c) for c in df.columns if c not in found]
    return both.select(*kept, *(v.alias(k) for k, v in found.items()))


def numbered(df: DataFrame, name: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds each row's place, from 1, in an order that is unique within ``by``."""
    return running(spread(df, by, order), by, order, {name: F.lit(1).cast("long")}).drop(PART)
