"""Quantitative PCR plates: quality gates, efficiencies, stability of references and fold changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandworks.functions.columns import average_rank
from strandworks.functions.tails import t_pvalue
from strandworks.operators.expression import bh_fdr

#: Cycles beyond which a well counts as empty, deviation of replicates that asks for a new run, cycles of separation.
CQ_MOST, SD_MOST, APART = 35.0, 0.5, 5.0


def technical(plate: DataFrame, most: float = CQ_MOST) -> DataFrame:
    """Mean, deviation and count of the technical replicates of each (gene, sample)."""
    cq = F.when(F.col("cq") <= most, F.col("cq"))
    return plate.where(F.col("well_type") == "sample").groupBy("gene", "sample").agg(F.avg(cq).alias("mean"), F.stddev_samp(cq).alias("sd"), F.count(cq).alias("n"))


def qc_flags(plate: DataFrame, most: float = CQ_MOST, sd: float = SD_MOST, apart: float = APART) -> DataFrame:
    """(flag, gene, sample, value, against): noisy replicates, contaminated blanks and carried-over genomic DNA."""
    tech = technical(plate, most)
    cq = F.when(F.col("cq") <= most, F.col("cq"))
    noisy = tech.where(F.col("sd") > sd).select(F.lit("technical_sd").alias("flag"), "gene", "sample", F.col("sd").alias("value"), F.lit(sd).alias("against"))
    worst = tech.groupBy("gene").agg(F.max("mean").alias("against"))
    blank = plate.where(F.col("well_type") == "NTC").groupBy("gene").agg(F.min(cq).alias("value")).join(worst, "gene").where(F.col("value") < F.col("against") + apart).select(F.lit("ntc").alias("flag"), "gene", F.lit(None).cast("string").alias("sample"), "value", "against")
    rt = plate.where(F.col("well_type") == "noRT").groupBy("gene", "sample").agg(F.min(cq).alias("value")).join(tech.select("gene", "sample", F.col("mean").alias("against")), ["gene", "sample"]).where(F.col("value") < F.col("against") + apart).select(F.lit("no_rt").alias("flag"), "gene", "sample", "value", "against")
    return noisy.unionByName(blank).unionByName(rt)


def efficiency(plate: DataFrame, least: int = 6) -> DataFrame:
    """Slope, E, R2 and the verdict of each gene's standard curve over raw cycles; too few wells give nulls and fail."""
    std = plate.where((F.col("well_type") == "std") & F.col("cq").isNotNull() & (F.col("dilution") > 0)).withColumn("q", F.log10("dilution"))
    genes = plate.where(F.col("well_type") == "std").select("gene").distinct()
    fit = std.groupBy("gene").agg(F.count("*").alias("n"), F.regr_slope("cq", "q").alias("slope"), F.regr_r2("cq", "q").alias("r2"))
    fit = genes.join(fit, "gene", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= least
    fit = fit.select("gene", "n", F.when(enough, F.col("slope")).alias("slope"), F.when(enough, F.col("r2")).alias("r2"))
    e = F.when(F.col("slope") != 0, F.pow(F.lit(10.0), -1 / F.col("slope")))
    good = F.col("e").isNotNull() & ((F.col("e") - 1) * 100).between(90, 110) & (F.col("r2") >= 0.99)
    return fit.withColumn("e", e).withColumn("passed", F.coalesce(good, F.lit(False)))


def relative_quantity(plate: DataFrame, tech: DataFrame, eff: DataFrame, calibrator: str = "parental") -> DataFrame:
    """E^(calibrator mean - Cq) of each (sample, gene); the calibrator is the mean of its samples in the same model."""
    meta = plate.where(F.col("well_type") == "sample").groupBy("sample").agg(F.min("model").alias("model"), F.min("condition").alias("condition"), F.min("replicate").alias("replicate"))
    rows = tech.join(meta, "sample").join(eff.select("gene", "e"), "gene", "left")
    cal = F.avg(F.when(F.col("condition") == calibrator, F.col("mean"))).over(Window.partitionBy("model", "gene"))
    return rows.withColumn("q", F.pow(F.coalesce("e", F.lit(2.0)), cal - F.col("mean"))).select("sample", "model", "condition", "replicate", "gene", "q")


def genorm(quantities: DataFrame, references: list[str]) -> DataFrame:
    """M of each reference: the mean deviation of its log ratio to each other reference over samples."""
    l = quantities.where(F.col("gene").isin(references)).select("sample", "gene", F.log2("q").alias("l"))
    other = l.select("sample", F.col("gene").alias("h"), F.col("l").alias("lh"))
    pairs = l.join(other, "sample").where(F.col("gene") != F.col("h")).groupBy("gene", "h").agg(F.stddev_samp(F.col("l") - F.col("lh")).alias("sd"))
    return pairs.groupBy("gene").agg(F.avg("sd").alias("m"))


def normfinder(quantities: DataFrame, references: list[str], group: str = "condition") -> DataFrame:
    """Stability of each reference: root of the mean variance within groups plus root of that between their means."""
    l = quantities.where(F.col("gene").isin(references)).withColumn("l", F.log2("q"))
    parts = l.groupBy("gene", group).agg(F.var_samp("l").alias("v"), F.avg("l").alias("m"))
    return parts.groupBy("gene").agg((F.sqrt(F.avg("v")) + F.sqrt(F.coalesce(F.var_samp("m"), F.lit(0.0)))).alias("nf"))


def stable_references(m: DataFrame, nf: DataFrame, n: int = 2) -> DataFrame:
    """The references with the smallest sum of both ranks; ties by gene."""
    both = m.join(nf, "gene").withColumn("rank", average_rank("m", []) + average_rank("nf", []))  # a row for each reference
    return both.withColumn("place", F.row_number().over(Window.orderBy("rank", "gene"))).withColumn("chosen", F.col("place") <= n).select("gene", "m", "nf", "rank", "chosen")


def normalised_quantity(quantities: DataFrame, chosen: DataFrame) -> DataFrame:
    """Quantities over the geometric mean of the chosen references of the sample."""
    norm = quantities.join(F.broadcast(chosen.where("chosen").select("gene")), "gene", "left_semi").groupBy("sample").agg(F.exp(F.avg(F.ln("q"))).alias("norm"))
    return quantities.join(norm, "sample").withColumn("nrq", F.col("q") / F.col("norm")).drop("norm")


def fold_change(normalised: DataFrame, targets: list[str], treated: str = "resistant", control: str = "parental") -> DataFrame:
    """log2 fold change of each (model, gene) over pairs of one replicate, its t and p, and the FDR within a model."""
    l = normalised.where(F.col("gene").isin(targets)).groupBy("model", "gene", "replicate").agg(F.avg(F.when(F.col("condition") == treated, F.log2("nrq"))).alias("a"), F.avg(F.when(F.col("condition") == control, F.log2("nrq"))).alias("b"))
    d = l.where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("d", F.col("a") - F.col("b"))
    out = d.groupBy("model", "gene").agg(F.count("*").alias("n"), F.avg("d").alias("log2fc"), F.stddev_samp("d").alias("sd")).where(F.col("n") >= 2)
    out = out.withColumn("t", F.try_divide(F.col("log2fc"), F.col("sd") / F.sqrt(F.col("n").cast("double"))))
    return bh_fdr(out.withColumn("p", t_pvalue(F.col("t"), (F.col("n") - 1).cast("double"))), ["model"])
