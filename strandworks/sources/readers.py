"""Readers of the text formats of the field, and sinks of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = "\t", partitions: int | None = None) -> DataFrame:
    """A delimited table with a header and an explicit schema; compressed files are dealt anew, as they are one split."""
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=False)
    df = df.select(*columns) if columns else df
    return df.repartition(partitions) if partitions else df


def matrix_to_long(df: DataFrame, ids: list[str], value: str = "value", name: str = "sample") -> DataFrame:
    """A wide table's columns but ``ids`` as rows."""
    return df.unpivot(ids, [c for c in df.columns if c not in ids], name, value)


def read_wide_matrix(spark: SparkSession, path: str, sep: str = "\t", keep_zeros: bool = False) -> DataFrame:
    """(row, column, value) of a text matrix with very many columns: lines are split, never made columns.

    The first line of the file names the row column and the others. Zeros are left out unless asked for.
    """
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    head = lines.agg(F.min(F.struct("n", "value")).alias("m")).select(F.col("m.n").alias("h"), F.split("m.value", sep).alias("names"))  # one row
    cells = lines.join(F.broadcast(head), F.col("n") > F.col("h")).select(F.split("value", sep).alias("v"), "names")
    long = cells.select(F.col("v")[0].alias("row"), F.col("names"), F.posexplode(F.slice("v", F.lit(2), F.size("v") - 1)).alias("i", "x"))
    out = long.select("row", F.get("names", F.col("i") + 1).alias("column"), F.expr("try_cast(x AS double)").alias("value"))
    return out if keep_zeros else out.where(F.col("value") != 0)


def read_gmt(spark: SparkSession, path: str, library: str | None = None) -> DataFrame:
    """(library, term, gene): a line is a term, a description and genes; a weight after a comma and blanks are dropped."""
    parts = F.split("value", "\t")
    genes = F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))
    # the term and the genes are columns of the line before the genes become rows: a line is not split again for each
    lines = spark.read.text(path).select(F.coalesce(F.lit(library), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.gmt|\.txt)?$", 1)).alias("library"), parts[0].alias("term"), genes.alias("genes"))
    named = lines.select("library", "term", F.explode("genes").alias("g"))
    return named.select("library", "term", F.trim(F.split_part("g", F.lit(","), F.lit(1))).alias("gene")).where(F.col("gene") != "").distinct()


def read_series_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(probe, sample, value) between the table markers, and (sample, title) from the header lines."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    plain = F.transform(F.split("value", "\t"), lambda x: F.trim(F.translate(x, '"', "")))
    tabs = lines.select(plain.alias("v"))
    head = tabs.where(F.col("v")[0] == "ID_REF").select(F.slice("v", F.lit(2), F.size("v") - 1).alias("samples")).limit(1)
    title = tabs.where(F.col("v")[0] == "!Sample_title").select(F.posexplode(F.slice("v", F.lit(2), F.size("v") - 1)).alias("i", "title"))
    ids = tabs.where(F.col("v")[0] == "!Sample_geo_accession").select(F.posexplode(F.slice("v", F.lit(2), F.size("v") - 1)).alias("i", "sample"))
    body = tabs.where(~F.col("v")[0].startswith("!") & (F.col("v")[0] != "ID_REF") & (F.size("v") > 1))
    cells = body.join(F.broadcast(head)).select(F.col("v")[0].alias("probe"), F.posexplode(F.arrays_zip(F.slice("v", F.lit(2), F.size("v") - 1).alias("x"), F.col("samples"))).alias("i", "c"))  # one header row
    return cells.select("probe", F.col("c.samples").alias("sample"), F.expr("try_cast(c.x AS double)").alias("value")), ids.join(title, "i").select("sample", "title")


def read_platform(spark: SparkSession, path: str) -> DataFrame:
    """A platform table without its comment lines, as (id, symbol) from its ID and GENE_SYMBOL columns."""
    rows = spark.read.text(path).where(~F.substring("value", 1, 1).isin("#", "!", "^") & (F.length("value") > 0)).select(F.split("value", "\t").alias("v"))
    head = rows.where(F.col("v")[0] == "ID").limit(1).select(F.array_position("v", "GENE_SYMBOL").cast("int").alias("at"))
    return rows.where(F.col("v")[0] != "ID").join(F.broadcast(head)).select(F.col("v")[0].alias("id"), F.try_element_at("v", "at").alias("symbol")).where(F.col("symbol") != "")  # one header row


BLAST = "q string, s string, pid double, alen double, mm double, gap double, qs double, qe double, ss double, se double, ev double, bit double"


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    """Tabular alignments: comment lines and lines with fewer than 12 fields are dropped."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=BLAST, mode="PERMISSIVE")
    return rows.where(F.col("ev").isNotNull() & F.col("bit").isNotNull())


def read_fasta_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(q, plen) of short one-line records: a name line and a sequence line each."""
    lines = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\n")
    return lines.select(F.trim(parts[0]).alias("q"), F.length(F.regexp_replace(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ""), r"\s", "")).alias("plen"))


def read_pdbqt(spark: SparkSession, path: str) -> DataFrame:
    """(mol, atom, res, x, y, z, atype) of a folder of fixed-column atom files; mol is the file's name."""
    line = F.col("value")
    rows = spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.pdbqt$", "").alias("mol"), line).where(line.startswith("ATOM") | line.startswith("HETATM"))
    res = F.concat(F.trim(F.substring(line, 18, 3)), F.trim(F.substring(line, 23, 4)))
    return rows.select("mol", F.trim(F.substring(line, 13, 4)).alias("atom"), res.alias("res"), *(F.expr(f"try_cast(trim(substring(value, {at}, 8)) AS double)").alias(c) for c, at in (("x", 31), ("y", 39), ("z", 47))), F.trim(F.substring(line, 78, 4)).alias("atype"))


def split_keys(results: DataFrame, key: str, names: list[str], sep: str = r"\|") -> DataFrame:
    """A joined key as columns; missing parts are null."""
    parts = F.split(F.col(key), sep)
    return results.select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)), *(c for c in results.columns if c != key))


def write_results(df: DataFrame, path: str, by: list[str] | None = None, kind: str = "parquet", mode: str = "overwrite") -> None:
    """A result table as Parquet, CSV or JSON lines, partitioned by columns if asked."""
    writer = df.write.mode(mode)
    writer = writer.partitionBy(*by) if by else writer
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)
