"""Primers and in-silico PCR on columns of sequence text."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.functions.storage import cut

# Unified nearest-neighbour enthalpies (kcal/mol) and entropies (cal/mol/K) of dinucleotides.
NEIGHBOURS = {
    "AA": (-7.9, -22.2),
    "AT": (-7.2, -20.4),
    "TA": (-7.2, -21.3),
    "CA": (-8.5, -22.7),
    "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0),
    "GA": (-8.2, -22.2),
    "CG": (-10.6, -27.2),
    "GC": (-9.8, -24.4),
    "GG": (-8.0, -19.9),
}
# Initiation at a G or C end and at an A or T end.
ENDS = {"GC": (0.1, -2.8), "AT": (2.3, 4.1)}
GAS = 1.987
ZERO = 273.15
#: Primer concentration (mol/L), salt, magnesium and nucleotides (mmol/L).
PRIMER, SODIUM, MAGNESIUM, NUCLEOTIDES = 0.2e-6, 50.0, 3.0, 0.8


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def gc_fraction(seq: Column) -> Column:
    return F.try_divide(F.length(F.translate(seq, "AT", "")).cast("double"), F.length(seq))


def longest_run(seq: Column) -> Column:
    """The longest repeat of one letter."""
    return F.greatest(*(F.coalesce(F.array_max(F.transform(F.regexp_extract_all(seq, F.lit(f"({c}+)")), F.length)), F.lit(0)) for c in "ACGTN"))


def _pair_energies() -> np.ndarray:
    """Energies of letter pairs (in the order ACGT) in whole tenths, negated: enthalpy times 2^32 plus entropy."""
    out = np.zeros((5, 5), np.int64)  # the fifth is any other letter
    for i, a in enumerate("ACGT"):
        for j, b in enumerate("ACGT"):
            h, s = NEIGHBOURS.get(a + b) or NEIGHBOURS[(b + a).translate(str.maketrans("ACGT", "TGCA"))]
            out[i, j] = (round(-10 * h) << 32) + round(-10 * s)
    return out.ravel()


PAIR_ENERGIES = _pair_energies()
CODES = np.full(256, 4, np.intp)
CODES[list(b"ACGT")] = range(4)


@F.pandas_udf(T.LongType())
def _energies(seq: pd.Series) -> pd.Series:
    """Sum of a sequence's pairs; null for fewer than two letters or others than ACGT. A batch is one array of letters."""
    texts = ["" if x is None else x for x in seq]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    code = CODES[np.frombuffer("".join(texts).encode("latin-1", "replace"), np.uint8)]
    summed = np.concatenate([[0, 0], np.cumsum(PAIR_ENERGIES[code[:-1] * 5 + code[1:]])])  # up to the pair that ends before a place
    other = np.concatenate([[0], np.cumsum(code == 4)])
    some = size > 1
    ok = some & (other[end] == other[end - size])
    value = np.zeros(len(texts), np.int64)
    value[some] = summed[end[some]] - summed[end[some] - size[some] + 1]
    return pd.Series(value, dtype="Int64").mask(~ok)


def melting_temp(seq: Column, primer: float = PRIMER, sodium: float = SODIUM, magnesium: float = MAGNESIUM, nucleotides: float = NUCLEOTIDES) -> Column:
    """Nearest-neighbour melting temperature in degrees with a salt correction; magnesium counts as sodium.

    The energies of all letter pairs of a batch are summed as whole numbers; the rest is a column expression. Null for
    sequences of one letter, or of others than A, C, G and T."""
    total, size = _energies(seq), F.length(seq)
    ends = [F.when(F.substring(seq, at, 1).isin("G", "C"), F.lit(ENDS["GC"][k])).otherwise(F.lit(ENDS["AT"][k])) for k in (0, 1) for at in (1, -1)]
    h = F.shiftright(total, 32) / F.lit(-10.0) + ends[0] + ends[1]
    s = total.bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(-10.0) + ends[2] + ends[3]
    salt = math.log((sodium + 120 * math.sqrt(max(magnesium - nucleotides, 0.0))) / 1000)
    gc = F.try_divide((2 * size - F.length(F.replace(seq, F.lit("G"), F.lit(""))) - F.length(F.replace(seq, F.lit("C"), F.lit("")))).cast("double"), size)
    inverse = (s + GAS * math.log(primer / 4)) / (h * 1000) + (4.29 * gc - 3.95) * 1e-5 * salt + 9.40e-6 * salt**2
    return 1 / inverse - ZERO


def complementary_stretch(a: str, b: str) -> int:
    """The longest stretch of a that also stands in the reverse complement of b."""
    other = b.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    row = np.zeros(len(other) + 1, int)
    best = 0
    letters = np.array(list(other)) if other else np.array([], str)
    for c in a:
        row[1:] = np.where(letters == c, row[:-1] + 1, 0)
        best = max(best, int(row.max(initial=0)))
    return best


@F.pandas_udf(T.IntegerType())
def dimer(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest complementary stretch of two primers."""
    return pd.Series([None if x is None or y is None else complementary_stretch(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def share_complement(a: Column, b: Column, k: int) -> Column:
    """Whether some ``k`` letters in a row of a also stand in the reverse complement of b: ``dimer(a, b) >= k``."""
    other = reverse_complement(b)
    return F.when(F.length(a) >= k, F.exists(F.sequence(F.lit(1), F.length(a) - (k - 1)), lambda i: F.contains(other, F.substring(a, i, F.lit(k))))).otherwise(F.lit(False))


def primer_candidates(transcripts: DataFrame, lengths: tuple[int, int] = (19, 24), tm: tuple[float, float] = (58.5, 62.0)) -> DataFrame:
    """All primers of each transcript's coding part that meet the rules, on both strands.

    ``transcripts``: gene, seq, low, high (1-based coding part). Returns gene, strand, first and last base, primer, tm.
    Cheap rules run before the melting temperature, and the look for complements runs on what is left.
    """
    start = F.explode(F.sequence(F.col("low"), F.greatest(F.col("low"), F.least(F.col("high"), F.length("seq")) - lengths[0] + 1)))
    every = transcripts.select("gene", "seq", F.least("high", F.length("seq")).alias("high"), start.alias("first")).withColumn("n", F.explode(F.sequence(F.lit(lengths[0]), F.lit(lengths[1])))).withColumn("last", F.col("first") + F.col("n") - 1).where(F.col("last") <= F.col("high"))
    cut = every.select("gene", "first", "last", F.substring("seq", F.col("first"), F.col("n")).alias("sub")).where(~F.col("sub").contains("N"))
    plus = cut.select("gene", F.lit("F").alias("strand"), "first", "last", F.col("sub").alias("primer"))
    minus = cut.select("gene", F.lit("R").alias("strand"), "first", "last", reverse_complement(F.col("sub")).alias("primer"))
    p = F.col("primer")
    tail = F.length(F.translate(F.substring(p, -5, 5), "AT", ""))
    sound = plus.unionByName(minus).where(gc_fraction(p).between(0.40, 0.62) & F.substring(p, -1, 1).isin("G", "C") & (tail <= 3) & ~p.rlike("A{4}|C{4}|G{4}|T{4}"))
    warm = sound.withColumn("tm", melting_temp(p)).where(F.col("tm").between(*tm))
    return warm.where(~share_complement(p, p, 7))


def primer_pairs(candidates: DataFrame, exons: DataFrame, amplicon: tuple[int, int] = (80, 160), junction: bool = True) -> DataFrame:
    """Forward and reverse primers of one gene whose product fits, scored.

    ``exons``: gene and ends (array of last bases of all exons but the last). The range join is an equi-join on the
    gene and a bucket of positions as wide as the longest product, against this bucket and the next.
    """
    low, high = amplicon
    f = candidates.where(F.col("strand") == "F").select("gene", F.col("first").alias("f1"), F.col("last").alias("f2"), F.col("primer").alias("fwd"), F.col("tm").alias("fwd_tm"), F.explode(F.array(F.floor(F.col("first") / high), F.floor(F.col("first") / high) + 1)).alias("bucket"))
    r = candidates.where(F.col("strand") == "R").select("gene", F.col("first").alias("r1"), F.col("last").alias("r2"), F.col("primer").alias("rev"), F.col("tm").alias("rev_tm"), F.floor(F.col("last") / high).alias("bucket"))
    size = F.col("r2") - F.col("f1") + 1
    near = f.join(r, ["gene", "bucket"]).where(size.between(low, high) & (F.abs(F.col("fwd_tm") - F.col("rev_tm")) <= 1.5)).withColumn("amplicon", size)
    apart = near.where(~share_complement(F.substring("fwd", -5, 5), F.substring("rev", -5, 5), 4) & ~share_complement(F.col("fwd"), F.col("rev"), 8))
    held = apart.join(exons, "gene", "left").withColumn("ends", F.coalesce("ends", F.array().cast("array<int>")))

    def spans(a: str, b: str) -> Column:
        return F.exists("ends", lambda j: (j >= F.col(a)) & (j < F.col(b)) & (j - F.col(a) + 1 >= 4) & (F.col(b) - j >= 4))

    own = spans("f1", "f2") | spans("r1", "r2")
    cross = F.exists("ends", lambda j: (j >= F.col("f2")) & (j < F.col("r1")))
    score = F.when(own, 2).otherwise(0) + F.when(cross, 1).otherwise(0) - F.abs(F.col("fwd_tm") - F.col("rev_tm")) - F.abs(gc_fraction(F.col("fwd")) - 0.5) - F.abs(gc_fraction(F.col("rev")) - 0.5)
    kind = F.when(own, "primer spans junction").when(cross, "amplicon spans junction").otherwise("no junction")
    out = held.withColumn("junction", kind).withColumn("score", F.round(score, 9))
    out = out.where(own | cross) if junction else out
    return out.select("gene", "fwd", "fwd_tm", F.col("f1").alias("fwd_pos"), "rev", "rev_tm", F.col("r2").alias("rev_pos"), "amplicon", "junction", "score")


def pick_pairs(pairs: DataFrame, most: int = 3, apart: int = 30) -> DataFrame:
    """The best pairs of each gene whose forward starts lie more than ``apart`` bases from each other.

    Only the best pair of each forward start can be picked, so a gene's group is bounded by its length.
    """
    best = pairs.withColumn("__r", F.row_number().over(Window.partitionBy("gene", "fwd_pos").orderBy(F.desc("score"), "rev_pos", "fwd", "rev"))).where(F.col("__r") == 1).drop("__r")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "fwd_pos", "rev_pos"], ascending=[False, True, True])
        kept: list[int] = []
        for i, at in zip(group.index, group["fwd_pos"], strict=True):
            if all(abs(at - group.at[k, "fwd_pos"]) > apart for k in kept):
                kept.append(i)
            if len(kept) == most:
                break
        return group.loc[kept].assign(rank=range(1, len(kept) + 1))

    schema = ", ".join(f"{c} {t}" for c, t in best.dtypes) + ", rank int"
    return best.groupBy("gene").applyInPandas(pick, schema)


#: Tiers of rules, tried in turn for genes without a pair: product, melting range, lengths, whether a junction is asked.
TIERS = (((80, 160), (58.5, 62.0), (19, 24), True), ((70, 200), (57.5, 63.0), (18, 25), True), ((70, 220), (57.0, 64.0), (18, 26), True), ((70, 220), (57.0, 64.0), (18, 26), False))


def design_primers(transcripts: DataFrame, exons: DataFrame, tiers: tuple = TIERS, most: int = 3) -> DataFrame:
    """Ranked primer pairs of each gene, from the first tier that has any.

    Primers are found once, under the widest rules of all tiers; a tier takes those that meet its own."""
    lengths = (min(t[2][0] for t in tiers), max(t[2][1] for t in tiers))
    left = cut(primer_candidates(transcripts, lengths, (min(t[1][0] for t in tiers), max(t[1][1] for t in tiers))))
    done = []
    for i, (product, tm, (short, long), junction) in enumerate(tiers):
        own = left.where(F.col("tm").between(*tm) & (F.col("last") - F.col("first") + 1).between(short, long))
        found = cut(pick_pairs(primer_pairs(own, exons, product, junction), most).withColumn("tier", F.lit(i)))
        done.append(found)
        left = left.join(found.select("gene").distinct(), "gene", "left_anti")
    return reduce(DataFrame.unionByName, done)


def annealing_hits(hits: DataFrame, identity: float = 95.0) -> DataFrame:
    """Alignments that can prime: near full length, with the 3' end; adds strand, gene and side (F or R)."""
    kept = hits.where((F.col("pid") >= identity) & (F.col("alen") >= F.col("plen") - 1) & (F.col("qe") >= F.col("plen") - 1))
    return kept.withColumn("strand", F.when(F.col("se") > F.col("ss"), "plus").otherwise("minus")).withColumn("gene", F.regexp_replace("q", "_[FR]$", "")).withColumn("side", F.substring("q", -1, 1))


def in_silico_pcr(hits: DataFrame, low: int = 50, high: int = 2000) -> DataFrame:
    """Sites and products of each gene: the first plus-strand start of F and the last minus-strand start of R on one subject."""
    f, r = (F.col("side") == "F") & (F.col("strand") == "plus"), (F.col("side") == "R") & (F.col("strand") == "minus")
    by = hits.groupBy("gene", "s").agg(F.count_if(f).alias("nf"), F.count_if(r).alias("nr"), F.min(F.when(f, F.col("ss"))).alias("a"), F.max(F.when(r, F.col("ss"))).alias("b"))
    size = F.col("b") - F.col("a") + 1
    fits = size.between(low, high)
    return by.groupBy("gene").agg(F.sum("nf").alias("n_f_sites"), F.sum("nr").alias("n_r_sites"), F.count_if(fits).alias("n_amplicons"), F.array_join(F.array_sort(F.collect_set(F.when(fits, F.col("s").cast("string")))), ";").alias("accessions"))


def final_assays(candidates: DataFrame, pcr: DataFrame) -> DataFrame:
    """Each gene's first pair with its products; genes without a result keep nulls."""
    return candidates.where(F.col("rank") == 1).join(pcr.select("gene", F.col("n_amplicons").alias("n_isoforms_amplified"), "accessions"), "gene", "left").orderBy(F.desc("role"), "gene")
