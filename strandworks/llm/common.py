"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.functions.storage import cut, shared_dir, stored

__all__ = ["bounded_batches", "cut", "cut_and_release", "is_train", "partitions", "read_table", "sample_of", "shared_dir", "stored", "worker_state"]

#: Rows in one Arrow batch for operators that hold whole texts in a Python worker.
TEXT_BATCH_ROWS = 1000
#: Bytes in one such batch, whichever is reached first.
TEXT_BATCH_BYTES = 32 << 20
#: Spark's setting that deletes the files of a query's shuffles at its end.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def cut_and_release(df: DataFrame) -> DataFrame:
    """``cut``, with the files of its shuffles deleted on all executors as soon as it is computed.

    For jobs whose rounds of large joins would otherwise add up on the executors' disks. The session's setting holds for
    this one checkpoint and is put back; nothing reads the shuffles again, as the rows come from the checkpoint.
    """
    conf = df.sparkSession.conf
    before = conf.get(RELEASE)
    conf.set(RELEASE, "true")
    try:
        return cut(df.select("*"))  # a new query, as each one keeps the setting that it was made under
    finally:
        conf.set(RELEASE, before)


_STATE: dict = {}


def worker_state(key: tuple, build):
    """What one operator keeps in a Python worker between tasks; another operator's is dropped first.

    Workers outlive jobs, so the caches of a pipeline's stages would add up in their memory.
    """
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = build()
    return _STATE[key]


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_train(doc_id: str, modulus: int, held: int) -> F.Column:
    """Whether a document's checksum lets its labels be learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus != held


def sample_of(df: DataFrame, group: str, share: dict, most: int) -> DataFrame:
    """At most ``most`` rows of each group, those with the smallest hash ``h`` among a share of the hashes.

    ``share`` gives each group's part of the hash range, so a window sees no more than about ``most`` rows of a group.
    """
    part = F.lit(0.0)
    for value, x in share.items():
        part = F.when(F.col(group) == value, F.lit(float(x))).otherwise(part)
    some = df.where(F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53)) < part)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("h"))
    return some.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")
