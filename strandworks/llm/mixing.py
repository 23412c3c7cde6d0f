"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length. Of the budget left after whole epochs, each length gives its even share;
what the rounding leaves is filled by a bounded knapsack over the remaining counts. Seeded documents are then
chosen by length count, so only histograms are ever gathered.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the order of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: What the mix takes of all sizes, and of one source at most.
SHARE, MOST = 1.5, 2.0
#: Words that the knapsack fits exactly; the greedy pass before it leaves no more than this or the longest length.
KNAPSACK = 16_384
#: Documents of one length that are ranked in one group.
GROUP = 2_000
#: Rows up to which a table of counts is broadcast; a larger one is shuffled.
BROADCAST = 300_000


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[Source]:
    """Targets by weight; those above ``most`` times their size stop there and the rest is shared again."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = [weights[i % len(weights)] for i in range(len(ordered))]
    left = min(share, most) * sum(n for _, n in ordered)
    target, free = [0.0] * len(ordered), set(range(len(ordered)))
    while free:
        whole = sum(weight[i] for i in free)
        full = [i for i in free if left * weight[i] / whole > most * ordered[i][1]]
        if not full:
            for i in free:
                target[i] = left * weight[i] / whole
            break
        for i in full:
            target[i] = most * ordered[i][1]
            free.remove(i)
        left -= sum(target[i] for i in full)
    return [Source(name, n, t) for (name, n), t in zip(ordered, target, strict=True)]


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum comes nearest to the budget; of two, the smaller sum.

    Bounded by binary splitting; the sums reached are bits of an integer, kept after each item for the way back.
    """
    items = []
    for i, (n, c) in enumerate(zip(lengths, counts, strict=True)):
        c, step = min(c, 2 * budget // n if n else 0), 1
        while c > 0:
            items.append((i, min(step, c)))
            c -= step
            step *= 2
    mask, reached = (1 << (2 * budget + 1)) - 1, [1]
    for i, k in items:
        now = reached[-1]
        reached.append((now | now << (k * lengths[i])) & mask)
        if reached[-1] >> budget & 1:
            break
    under = (reached[-1] & ((1 << (budget + 1)) - 1)).bit_length() - 1
    over = reached[-1] >> (budget + 1)
    above = budget + (over & -over).bit_length() if over else under
    left, taken = above if over and above - budget < budget - under else under, [0] * len(lengths)
    for (i, k), before in zip(reversed(items[: len(reached) - 1]), reversed(reached[:-1]), strict=True):
        if not before >> left & 1:
            taken[i] += k
            left -= k * lengths[i]
    return taken


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (ascending) to take for a budget of words: the even share, then the rest.

    The rest is below one document of each length. Single documents, the longest first, bring it down to the size
    of the knapsack; the knapsack fits what is left and comes as near to it as any choice of the documents then spare.
    As it may take any of those of at most twice what is left, the sum ends within half the shortest spare length of
    the budget.
    """
    whole = int(np.dot(lengths, counts))
    if budget <= 0 or not whole:
        return np.zeros_like(counts)
    if budget >= whole:
        return counts.copy()
    taken = np.array([int(c) * budget // whole for c in counts.tolist()], np.int64)
    left = budget - int(np.dot(lengths, taken))
    spare = counts - taken
    room = max(KNAPSACK, int(lengths[0]))
    for i in range(len(lengths) - 1, -1, -1):
        n = int(lengths[i])
        if left <= room:
            break
        k = min(int(spare[i]), max(0, (left - room // 2) // n))
        taken[i] += k
        spare[i] -= k
        left -= k * n
    fits = [i for i in range(bisect_right(lengths.tolist(), 2 * left)) if spare[i] > 0]
    if fits and left > 0:
        chosen = knapsack([int(lengths[i]) for i in fits], [int(spare[i]) for i in fits], left)
        taken[fits] += np.array(chosen, np.int64)
    return taken


def mix(docs: DataFrame, seed: int = 7, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """How many words the mix takes of every row, with its source's size and target.

    Returns the id (or the columns in ``keep``, under any names; rows are drawn by the first of them), and behind
    ``prefix`` ``size`` (words of the whole text; null: 0), ``source_size``, ``target`` and ``taken``: 0, ``size`` or
    twice ``size``. Sources go by code point, a null source last and on its own. Rows are chosen by a seeded hash of
    id and source, ties by the columns kept; repeated rows count one by one. Rows without words take nothing and take
    no part in any join; an empty table gives no rows. Only the table of sources reaches the driver; the histogram of
    one source is one group of bounded size (its distinct lengths), and rows of one length are ranked in groups of
    about GROUP.
    """
    if most != int(most) or most < 1:
        raise ValueError("a source repeats a whole number of times at most")
    keep = [id_col] if keep is None else keep
    kept = [f"__keep{i}" for i in range(len(keep))]
    rows = cut(docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    counted = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    found = targets([(x[0], x[1]) for x in counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n"))).collect()], weights, share, most)
    spark = docs.sparkSession
    table = spark.createDataFrame([(x.name, x.size, x.target, min(int(x.target // x.size), int(most)) if x.size else 0) for x in found], "source string, source_size long, target double, epochs int")
    budgets = {x.name: round(x.target) - x.size * (min(int(x.target // x.size), int(most)) if x.size else 0) for x in found}
    shared = spark.sparkContext.broadcast(budgets)

    def choose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        name = key[0] if isinstance(key[0], str) else None
        group = group.sort_values("size")
        taken = fit_counts(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), shared.value.get(name, 0))
        return pd.DataFrame({"source": name, "size": group["size"], "n": group["n"], "quota": taken}).astype({"source": object})

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """An inner join in which null keys are equal; every row of the left side has its match."""
        right = right.withColumnsRenamed({c: f"__{c}" for c in on})
        few = F.broadcast(right) if right.count() <= BROADCAST else right
        return left.join(few, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]).drop(*(f"__{c}" for c in on))

    chosen = cut(counted.where(F.col("size") > 0).groupBy("source").applyInPandas(choose, "source string, size long, n long, quota long"))
    draw = F.xxhash64(F.lit(seed), F.col(kept[0]), F.col("source"))
    parts = F.ceil(F.col("n") / GROUP)
    fraction = F.shiftrightunsigned("draw", 11).cast("double") / F.lit(float(1 << 53))
    dealt = joined(rows.where(F.col("size") > 0), chosen, ["source", "size"]).withColumn("draw", draw).withColumn("part", F.least(F.floor(fraction * parts), parts - 1))
    # how many rows the parts before each part hold, from counts alone
    counts = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = joined(dealt, cut(counts.withColumn("before", before)), ["source", "size", "part"])
    # only the part in which the quota ends is ranked; the others are in or out as a whole
    ends = (F.col("before") < F.col("quota")) & (F.col("quota") < F.col("before") + F.col("m"))
    whole = ranked.where(~ends).withColumn("extra", (F.col("before") + F.col("m") <= F.col("quota")).cast("long"))
    order = Window.partitionBy("source", "size", "part").orderBy("draw", *kept)
    part = ranked.where(ends).withColumn("extra", (F.col("before") + F.row_number().over(order) <= F.col("quota")).cast("long"))
    columns = [*kept, "source", "size", "extra"]
    every = whole.select(*columns).unionByName(part.select(*columns)).unionByName(rows.where(F.col("size") == 0).withColumn("extra", F.lit(0).cast("long")).select(*columns))
    out = joined(every, table, ["source"])
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), F.col("size").alias(f"{prefix}size"), F.col("source_size").alias(f"{prefix}source_size"), F.col("target").alias(f"{prefix}target"), (F.col("size") * (F.col("epochs") + F.col("extra"))).alias(f"{prefix}taken"))
