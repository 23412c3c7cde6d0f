"""Concordance of a risk with times, and its bootstrap, in proportion to the rows.

A pair counts if the earlier time is an event and the other time is strictly later; it agrees if the earlier one has the
higher risk, and by half if the risks are equal. Risks are replaced by their ranks, and ranks are compared digit by
digit: two ranks differ first at one digit, so a row meets, at each level, only the rows with the same digits above it,
and among those only the sums of the later rows by digit. So the pairs of all rows are running sums over rows by level,
and no pair is made. An area under a curve is the concordance of cases (time 0) with controls (time 1).

For a bootstrap the weights of all replicates are one vector a row, drawn in the task that sums it from a hash of the
row's id; as many rows are shuffled as without replicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.functions.storage import cut
from strandworks.operators.scan import PART, numbered, ranges_of, running, spread

#: Bits of a digit in plain sums and with replicates; numbers of a vector that a task holds at once.
BITS, VECTOR_BITS, NUMBERS = 4, 2, 2_000_000
#: Weights are summed by group first for this many groups at most, of this many rows each on average.
GROUPS, EQUAL = 1000, 4
#: Increment and multipliers that mix a hash with a replicate's number (fixed values of a known generator).
STEP, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def ranked(rows: DataFrame, by: list[str], risk: str) -> DataFrame:
    """Adds rank, from 0, of the distinct risks of a group."""
    found = numbered(rows.select(*by, risk).distinct(), "rank", by, [risk])
    return rows.join(found.withColumn("rank", F.col("rank") - 1), [*by, risk])


def by_level(rows: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """A row for each level of a rank: level, the digits above it as prefix, and the digit; and the number of levels."""
    most = rows.agg(F.max("rank")).collect()[0][0] or 0
    levels = max(1, -(-int(most).bit_length() // bits))
    shift = lambda n: F.expr(f"shiftright(rank, {n})")
    each = F.array(*(F.struct(F.lit(i).alias("level"), shift(bits * (i + 1)).alias("prefix"), F.pmod(shift(bits * i), F.lit(1 << bits)).cast("int").alias("digit")) for i in range(levels)))
    return rows.withColumn("__l", F.explode(each)).select("*", "__l.level", "__l.prefix", "__l.digit").drop("__l", "rank"), levels


def cindex(df: DataFrame, risk: str = "risk", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, pairs, agree, cindex) by counting over the digits of ranked risks; a row is shuffled once a level."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(*by, F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"), F.col(risk).cast("double").alias("risk"), w.cast("double").alias("weight")).dropna().groupBy(*by, "time", "event", "risk").agg(F.sum("weight").alias("weight"))
    dealt, levels = by_level(cut(ranked(rows, by, "risk")), BITS)
    digits = range(1 << BITS)
    at = lambda k, what: F.sum(F.when(F.col("digit") == k, what).otherwise(0.0))
    key = [*by, "level", "prefix"]
    steps = dealt.groupBy(*key, "time").agg(*(at(k, F.col("weight")).alias(f"w{k}") for k in digits), *(at(k, F.col("weight") * (F.col("event") == 1).cast("int")).alias(f"e{k}") for k in digits))
    table = running(spread(steps, key, ["time"]), key, ["time"], {f"t{k}": F.col(f"w{k}") for k in digits}, down=True)
    later = [F.col(f"t{k}") - F.col(f"w{k}") for k in digits]
    below, agree = F.lit(0.0), F.lit(0.0)
    for k in digits:
        agree = agree + F.col(f"e{k}") * (below + F.when(F.col("level") == 0, later[k] / 2).otherwise(0.0))
        below = below + later[k]
    pairs = F.when(F.col("level") == levels - 1, sum((F.col(f"e{k}") for k in digits), F.lit(0.0)) * below).otherwise(0.0)  # every row has the same digits above
    counted = table.select(*by, agree.alias("agree"), pairs.alias("pairs"))
    return counted.groupBy(*by).agg(F.sum("pairs").alias("pairs"), F.sum("agree").alias("agree")).withColumn("cindex", F.try_divide(F.col("agree"), F.col("pairs")))


def poisson_bounds() -> np.ndarray:
    """P(a Poisson(1) draw is no more than k), up to where doubles end."""
    out, term = [], math.exp(-1)
    while term > 1e-17:
        out.append((out[-1] if out else 0.0) + term)
        term /= len(out)
    return np.array(out)


BOUNDS = poisson_bounds()


def poisson_weights(ids: np.ndarray, replicates: int) -> np.ndarray:
    """A row of Poisson(1) weights for each hashed id: the quantile of the hash mixed with the replicate's number."""
    x = ids.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(STEP)
    for shift, factor in zip((30, 27), MIX, strict=True):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.searchsorted(BOUNDS, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(float)


class Sweep:
    """Sums by digit over the rows of one key, from the latest time on; every number is a vector over replicates."""

    def __init__(self, key: tuple, digits: int, replicates: int):
        self.key, self.time = key, None
        self.later, self.same, self.events = (np.zeros((digits, replicates)) for _ in range(3))
        self.agree, self.pairs = np.zeros(replicates), np.zeros(replicates)

    def add(self, time: np.ndarray, digit: np.ndarray, own: np.ndarray, others: np.ndarray, tie: float) -> None:
        """Rows in falling order of time, with their weights as the earlier and as the later one of a pair."""
        first = np.r_[True, time[1:] != time[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(time)), 0))
        goes_on = self.time == time[0]
        before = self.later if goes_on else self.later + self.same
        base = np.where((start == 0)[:, None, None], before[None], (self.later + self.same)[None]) if goes_on else before[None]
        below = np.zeros_like(own)
        for k in range(len(self.later)):
            mine = digit == k
            seen = np.vstack([np.zeros((1, own.shape[1])), np.cumsum(np.where(mine[:, None], others, 0.0), axis=0)])[start] + base[:, k]
            self.agree += (own[mine] * (below[mine] + tie * seen[mine])).sum(axis=0)
            below += seen
            self.events[k] += own[mine].sum(axis=0)
        self.pairs += (own * below).sum(axis=0)
        tail = start == start[-1]
        by_digit = lambda rows: np.stack([others[rows & (digit == k)].sum(axis=0) for k in range(len(self.later))])
        if goes_on and start[-1] == 0:
            self.same += by_digit(tail)
        else:
            self.later, self.same = self.later + self.same + by_digit(~tail), by_digit(tail)
        self.time = time[-1]


def _across(events: np.ndarray, later: np.ndarray, tie: float) -> tuple[np.ndarray, np.ndarray]:
    """Agreeing and all pairs of one range's events with what stands later, by digit."""
    below = np.cumsum(later, axis=0) - later
    return (events * (below + tie * later)).sum(axis=0), events.sum(axis=0) * later.sum(axis=0)


def summed_weights(rows: DataFrame, replicates: int) -> DataFrame:
    """(time, event, risk, replicate, weight): the Poisson weights of rows that are equal in all three, summed.

    Rows are dealt in their order, so a task emits a vector for each of its groups: as many as there are groups and tasks."""
    group = ["time", "event", "risk"]
    chunk = max(1, NUMBERS // replicates)
    ranged = rows.select(*group, "key").repartitionByRange(ranges_of(rows), *group, "key").sortWithinPartitions(*group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, np.zeros(replicates)
        for batch in batches:
            out = []
            for at in range(0, len(batch), chunk):
                b = batch.iloc[at : at + chunk]
                key = b[group].to_numpy(float)
                starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
                for k, w in zip(key[starts], np.add.reduceat(poisson_weights(b["key"].to_numpy(), replicates), starts, axis=0), strict=True):
                    if now is not None and tuple(k) != now:
                        out.append((*now, total))
                        total = np.zeros(replicates)
                    now, total = tuple(k), total + w
            yield pd.DataFrame(out, columns=[*group, "w"])
        if now is not None:
            yield pd.DataFrame([(*now, total)], columns=[*group, "w"])

    vectors = ranged.mapInPandas(run, "time double, event double, risk double, w array<double>")
    each = vectors.select(*group, F.posexplode("w").alias("replicate", "weight"))
    return each.groupBy(*group, "replicate").agg(F.sum("weight").alias("weight"))


def cindex_replicates(rows: DataFrame, replicates: int, factors: bool = False) -> DataFrame:
    """(replicate, pairs, agree, cindex) under the Poisson weights of every replicate.

    ``rows``: time, event, risk (no nulls), ``key`` (a hash of the row's id) and, with ``factors``, an array by which a
    row's weights are multiplied when it is the earlier one of a pair. Where many rows are equal but for their id, their
    weights are summed first and each row is drawn once; otherwise it is drawn once a level.
    """
    if not factors:
        groups = rows.groupBy("time", "event", "risk").agg(F.count("*").alias("n")).agg(F.count("*").alias("g"), F.sum("n").alias("n")).collect()[0]
        if 0 < groups["g"] <= GROUPS and groups["n"] >= EQUAL * groups["g"]:
            return cindex(summed_weights(rows, replicates), by=["replicate"], weight="weight")
    dealt, levels = by_level(ranked(rows, [], "risk"), VECTOR_BITS)
    digits, chunk = 1 << VECTOR_BITS, max(1, NUMBERS // replicates)
    order = ["level", "prefix", F.desc("time")]
    columns = ["level", "prefix", "digit", "time", "event", "key", *(["factor"] if factors else [])]
    ranged = dealt.select(*columns).repartitionByRange(ranges_of(rows), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agree, pairs = np.zeros(replicates), np.zeros(replicates)
        sweep, part, edge = None, 0, True

        def edges(s: Sweep) -> tuple:
            return (part, *s.key, True, s.events.ravel(), (s.later + s.same).ravel())

        out = []
        for batch in batches:
            for at in range(0, len(batch), chunk):
                b = batch.iloc[at : at + chunk]
                part = int(b["part"].iloc[0])
                weights = poisson_weights(b["key"].to_numpy(), replicates)
                own = weights * (b["event"].to_numpy() == 1)[:, None]
                if factors:
                    own = own * np.stack([np.ones(replicates) if f is None else np.asarray(f, float) for f in b["factor"]])
                level, prefix = b["level"].to_numpy(), b["prefix"].to_numpy()
                ends = np.flatnonzero((level[1:] != level[:-1]) | (prefix[1:] != prefix[:-1])) + 1
                for i, j in zip(np.r_[0, ends], np.r_[ends, len(b)], strict=True):
                    key = (int(level[i]), int(prefix[i]))
                    if sweep is None or sweep.key != key:
                        if sweep is not None:
                            agree, pairs = agree + sweep.agree, pairs + (sweep.pairs if sweep.key[0] == levels - 1 else 0)
                            if edge:
                                out.append(edges(sweep))
                            edge = False
                        sweep = Sweep(key, digits, replicates)
                    sweep.add(b["time"].to_numpy(float)[i:j], b["digit"].to_numpy()[i:j], own[i:j], weights[i:j], 0.5 if key[0] == 0 else 0.0)
        if sweep is not None:
            agree, pairs = agree + sweep.agree, pairs + (sweep.pairs if sweep.key[0] == levels - 1 else 0)
            out += [edges(sweep), (part, 0, 0, False, agree, pairs)]
        yield pd.DataFrame(out, columns=["part", "level", "prefix", "edge", "a", "b"])

    sums = cut(ranged.mapInPandas(run, "part int, level int, prefix long, edge boolean, a array<double>, b array<double>"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, later = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if key != (r.level, r.prefix):
                    key, later = (r.level, r.prefix), np.zeros((digits, replicates))
                agree, pairs = _across(np.asarray(r.a).reshape(digits, -1), later, 0.5 if r.level == 0 else 0.0)
                later = later + np.asarray(r.b).reshape(digits, -1)
                out.append((agree, pairs if r.level == levels - 1 else np.zeros(replicates)))
            yield pd.DataFrame(out, columns=["a", "b"])

    # two rows for each range, one by one in order: the ranges of one key hold ever earlier times
    keys = ["level", "prefix"]
    over = sums.where("edge").repartition(*keys).sortWithinPartitions(*keys, "part").select(*keys, "a", "b").mapInPandas(joined, "a array<double>, b array<double>")
    every = sums.where(~F.col("edge")).select("a", "b").unionByName(over).select(F.posexplode(F.arrays_zip("a", "b")).alias("replicate", "x"))
    return every.groupBy("replicate").agg(F.sum("x.b").alias("pairs"), F.sum("x.a").alias("agree")).withColumn("cindex", F.try_divide(F.col("agree"), F.col("pairs")))


def percentile_ci(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*(by or [])).agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"), F.count("*").alias("replicates"))


def _hashed(df: DataFrame, seed: int) -> F.Column:
    return F.xxhash64(F.lit(seed), "id").alias("key")


def cindex_ci(df: DataFrame, risk: str = "risk", replicates: int = 500, seed: int = 2026) -> DataFrame:
    """Bootstrap interval of the C-index with Poisson weights."""
    rows = df.select(F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"), F.col(risk).cast("double").alias("risk"), _hashed(df, seed)).dropna()
    return percentile_ci(cindex_replicates(rows, replicates), "cindex")


def auc_ci(df: DataFrame, score: str = "p", replicates: int = 2000, seed: int = 2026, y: str = "y") -> DataFrame:
    """Bootstrap interval of the AUC with Poisson weights; replicates with one class are skipped."""
    rows = df.where(F.col(y).isin(0, 1)).select((1 - F.col(y)).cast("double").alias("time"), F.col(y).cast("int").alias("event"), F.col(score).cast("double").alias("risk"), _hashed(df, seed)).dropna()
    return percentile_ci(cindex_replicates(rows, replicates), "cindex")


def censoring_replicates(rows: DataFrame, t0: float, replicates: int) -> DataFrame:
    """(time, log): the logarithm of the censoring survival just before each time up to t0 with an event, a number for
    each replicate. Two passes over ranges of time; between them, two vectors a range go through the driver."""
    ranged = spread(rows.select("time", "event", "key"), [], ["time"])
    chunk = max(1, NUMBERS // replicates)
    spark = rows.sparkSession

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = np.zeros(replicates), None
        for batch in batches:
            for at in range(0, len(batch), chunk):
                part = int(batch[PART].iloc[0])
                total = total + poisson_weights(batch["key"].to_numpy()[at : at + chunk], replicates).sum(axis=0)
        if part is not None:
            yield pd.DataFrame([(part, total)], columns=["part", "a"])

    weights = {r["part"]: np.array(r["a"]) for r in ranged.mapInPandas(weigh, "part int, a array<double>").collect()}  # a row for each range
    left = spark.sparkContext.broadcast({p: sum((w for q, w in weights.items() if q >= p), np.zeros(replicates)) for p in weights})

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, at_risk, part, now = np.zeros(replicates), None, None, None

        def closed(now: list) -> list:
            """The survival before the time ``now``, if it has an event; then what it takes off."""
            nonlocal log, at_risk
            time, gone, censored, event = now
            row = [(part, time, False, log)] if event and time <= t0 else []
            with np.errstate(divide="ignore", invalid="ignore"):
                log = log + np.where(censored > 0, np.log(np.maximum(1 - censored / np.where(at_risk > 0, at_risk, 1), 0)), 0.0)
            at_risk = at_risk - gone
            return row

        for batch in batches:
            out = []
            for at in range(0, len(batch), chunk):
                b = batch.iloc[at : at + chunk]
                if part is None:
                    part = int(b[PART].iloc[0])
                    at_risk = left.value[part]
                w, time, event = poisson_weights(b["key"].to_numpy(), replicates), b["time"].to_numpy(float), b["event"].to_numpy()
                starts = np.flatnonzero(np.r_[True, time[1:] != time[:-1]])
                gone, censored, events = np.add.reduceat(w, starts, axis=0), np.add.reduceat(w * (event == 0)[:, None], starts, axis=0), np.add.reduceat(event, starts)
                for t, g, c, e in zip(time[starts], gone, censored, events, strict=True):
                    if now is not None and now[0] == t:
                        now = [t, now[1] + g, now[2] + c, now[3] + e]
                    else:
                        out += closed(now) if now is not None else []
                        now = [t, g, c, e]
            yield pd.DataFrame(out, columns=["part", "time", "whole", "log"])
        if now is not None:
            last = closed(now)
            yield pd.DataFrame([*last, (part, 0.0, True, log)], columns=["part", "time", "whole", "log"])

    # a kept range is one partition
    steps = cut(ranged.sortWithinPartitions("time").mapInPandas(step, "part int, time double, whole boolean, log array<double>"))
    ends = {r["part"]: np.array(r["log"]) for r in steps.where("whole").collect()}  # a row for each range
    table = [(p, [float(x) for x in sum((v for q, v in ends.items() if q < p), np.zeros(replicates))]) for p in ends]
    offsets = spark.createDataFrame(table, "part int, off array<double>")
    return steps.where(~F.col("whole")).join(F.broadcast(offsets), "part").select("time", F.zip_with("log", "off", lambda x, y: x + y).alias("log"))


def time_auc_ci(df: DataFrame, t0: float, marker: str = "risk", replicates: int = 300, seed: int = 2026) -> DataFrame:
    """Bootstrap interval of the AUC at t0 with inverse-probability-of-censoring weights, drawn anew in each replicate."""
    rows = cut(df.select(F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"), F.col(marker).cast("double").alias("risk"), _hashed(df, seed)).dropna())
    before = censoring_replicates(rows, t0, replicates)
    cases = rows.where((F.col("time") <= t0) & (F.col("event") == 1)).join(before, "time")
    cases = cases.select(F.lit(0.0).alias("time"), "event", "risk", "key", F.transform("log", lambda x: 1 / F.greatest(F.exp(x), F.lit(1e-6))).alias("factor"))
    controls = rows.where(F.col("time") > t0).select(F.lit(1.0).alias("time"), F.lit(0).alias("event"), "risk", "key", F.lit(None).cast("array<double>").alias("factor"))
    return percentile_ci(cindex_replicates(cases.unionByName(controls), replicates, True), "cindex")
