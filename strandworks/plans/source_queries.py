"""Queries on the readers: driver tables are written as text in the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.functions.columns import rounded
from strandworks.functions.storage import shared_dir
from strandworks.plans.views import view, with_views
from strandworks.sources import readers as rd

QUERIES: dict = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = (lambda spark, sf_dir, fn=fn: rounded(fn(spark, lambda v: view(spark, sf_dir, v))), with_views(sql))
        return fn

    return add


def folder(spark: SparkSession) -> str:
    """A new place in the folder that the cluster names for checkpoints."""
    return f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"


def as_text(lines: DataFrame) -> str:
    """Write the one column of ``lines`` as text and return where."""
    path = folder(lines.sparkSession)
    lines.write.text(path)
    return path


@query("SELECT p_partkey, p_brand, round(p_retailprice, 6) + 0.0 AS p_retailprice FROM part")
def io1_delimited(spark, v):
    path = folder(spark)
    v("part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    return rd.read_delimited(spark, path, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double", ["p_partkey", "p_brand", "p_retailprice"], partitions=8)


@query("SELECT 'brands' AS library, term, CAST(gene AS VARCHAR) AS gene FROM v_sets WHERE library = 'brand'")
def io3_gmt(spark, v):
    genes = F.concat_ws("\t", F.collect_list(F.concat(F.col("gene").cast("string"), F.when(F.col("gene") % 2 == 0, ",1.0").otherwise(" "))))
    lines = v("v_sets").where("library = 'brand'").groupBy("term").agg(genes.alias("g")).select(F.concat_ws("\t", "term", F.lit("a set"), "g", F.lit("")).alias("value"))
    return rd.read_gmt(spark, as_text(lines), "brands")


def series(v) -> DataFrame:
    """The lines of a series matrix with a column for each sample."""
    samples = [f"S{i}" for i in range(24)]
    quoted = [f'"{x}"' for x in samples]
    wide = v("v_counts").groupBy("gene").pivot("sample", list(range(24))).agg(F.first("count"))
    body = wide.select(F.concat_ws("\t", F.concat(F.lit('"p'), F.col("gene").cast("string"), F.lit('"')), *(F.coalesce(F.col(str(i)).cast("string"), F.lit("null")) for i in range(24))).alias("value"))
    head = ["!Series_title\ta study", "\t".join(["!Sample_title", *(f'"title {i}"' for i in range(24))]), "\t".join(["!Sample_geo_accession", *quoted]), "!series_matrix_table_begin", "\t".join(['"ID_REF"', *quoted]), "!series_matrix_table_end", ""]
    return v("v_counts").sparkSession.createDataFrame([(x,) for x in head], "value string").unionByName(body)


@query("SELECT concat('p', gene) AS probe, concat('S', sample) AS sample, round(count, 6) + 0.0 AS value, concat('title ', sample) AS title FROM v_counts")
def io4_series_matrix(spark, v):
    values, titles = rd.read_series_matrix(spark, as_text(series(v)))
    return values.where(F.col("value").isNotNull()).join(titles, "sample").select("probe", "sample", "value", "title")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS symbol FROM part WHERE p_partkey % 5 <> 0")
def io4_platform(spark, v):
    head = spark.createDataFrame([("#ID = probe",), ("!platform_table_begin",), ("^PLATFORM = x",), ("ID\tSPOT\tGENE_SYMBOL\tOTHER",), ("!platform_table_end",)], "value string")
    rows = v("part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), F.lit("s"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_brand")), F.lit("o")).alias("value"))
    return rd.read_platform(spark, as_text(head.unionByName(rows)))


@query("SELECT q, CAST(s AS VARCHAR) AS s, round(pid, 6) + 0.0 AS pid, round(ss, 6) + 0.0 AS ss, round(se, 6) + 0.0 AS se FROM v_hits")
def io5_alignments(spark, v):
    fields = ["q", "s", "pid", "alen", F.lit("0"), F.lit("0"), F.lit("1"), "qe", "ss", "se", F.lit("1e-5"), F.lit("40.1")]
    full = v("v_hits").select(F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c for c in fields)).alias("value"))
    other = v("v_hits").select(F.when(F.col("s") % 2 == 0, F.concat(F.lit("# query "), "q")).otherwise(F.concat_ws("\t", "q", F.col("s").cast("string"), F.lit("99"))).alias("value"))
    return rd.read_blast(spark, as_text(full.unionByName(other))).select("q", "s", "pid", "ss", "se")


@query("SELECT concat('C', mol % 10) AS atom, concat('RES', mol % 100) AS res, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(z, 3) + 0.0 AS z, atype FROM v_atoms")
def io6_atoms(spark, v):
    mol = F.col("mol")
    line = F.format_string("ATOM  %5d %-4s %-3s A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f    %6.3f %-2s", mol % 100000, F.concat(F.lit("C"), (mol % 10).cast("string")), F.lit("RES"), mol % 100, "x", "y", "z", F.lit(1.0), F.lit(0.0), F.lit(0.1), "atype")
    other = v("v_atoms").select(F.concat(F.lit("REMARK "), mol.cast("string")).alias("value"))
    return rd.read_pdbqt(spark, as_text(v("v_atoms").select(line.alias("value")).unionByName(other))).select("atom", "res", "x", "y", "z", "atype")


@query("SELECT concat('g', gene) AS row, concat('S', sample) AS \"column\", round(count, 6) + 0.0 AS value FROM v_counts WHERE count <> 0")
def io2_wide_text_matrix(spark, v):
    samples = list(range(24))
    wide = v("v_counts").groupBy("gene").pivot("sample", samples).agg(F.first("count"))
    body = wide.select(F.concat_ws("\t", F.concat(F.lit("g"), F.col("gene").cast("string")), *(F.coalesce(F.col(str(i)).cast("string"), F.lit("0")) for i in samples)).alias("value"))
    head = spark.createDataFrame([("\t".join(["gene", *(f"S{i}" for i in samples)]), 0)], "value string, o int")
    one = head.unionByName(body.withColumn("o", F.lit(1))).repartition(1).sortWithinPartitions("o").select("value")
    return rd.read_wide_matrix(spark, as_text(one))  # one file, as the format has one header


@query("WITH r AS (SELECT p_brand AS analysis, p_type AS arm, count(*) AS n, round(avg(p_retailprice), 6) + 0.0 AS value FROM part GROUP BY ALL) SELECT kind, r.* FROM r, (SELECT unnest(['parquet', 'csv', 'json']) AS kind)")
def io7_result_sinks(spark, v):
    results = v("part").groupBy(F.col("p_brand").alias("analysis"), F.col("p_type").alias("arm")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("value"))
    schema, out = "arm string, n long, value double, analysis string", None
    for kind in ("parquet", "csv", "json"):
        path = folder(spark)
        rd.write_results(results, path, ["analysis"], kind)
        read = spark.read.schema(schema)
        back = read.option("header", True).csv(path) if kind == "csv" else read.json(path) if kind == "json" else read.parquet(path)
        back = back.select(F.lit(kind).alias("kind"), "analysis", "arm", "n", "value")
        out = back if out is None else out.unionByName(back)
    return out
