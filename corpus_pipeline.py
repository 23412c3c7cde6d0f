"""A training-data pipeline: language ID, near-duplicates, pseudonyms, source mix, packing.

Every stage takes all rows that the one before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.llm.common import is_train, read_table, stored
from strandworks.llm.language_id import UNDETERMINED, fit, identify
from strandworks.llm.mixing import mix
from strandworks.llm.near_copies import near_copies
from strandworks.llm.packing import pack
from strandworks.llm.pseudonyms import pseudonymise
from strandworks.llm.queries import PSEUDONYM_KEY

#: Posterior below which a document's language is not known well enough.
LEAST_SCORE = 0.5

#: SQL cannot express the stages (a fitted model, components of near copies, a keyed cipher, a tokenizer): tests use brute force.
ORACLE_SQL = None


#: What a stage's own columns begin with, so that no column of the documents has their name.
OWN = "__stage_"


def own(docs: DataFrame) -> list[F.Column]:
    """The columns of the documents, whatever their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts and texts without a letter go."""
    found = identify(docs, fit(docs, is_train("doc_id", 3, 1)), keep=docs.columns, prefix=OWN)
    return found.where((F.col(OWN + "lang_pred") != UNDETERMINED) & (F.col(OWN + "score") >= LEAST_SCORE)).select(*own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of five-word shingles 0.8 or more): the one with the
    smallest id; repeated rows are one."""
    keyed = docs.withColumn(OWN + "key", F.struct("doc_id", F.xxhash64("text").alias("th")))
    kept = near_copies(keyed, id_col=OWN + "key").select(F.col("component_id").alias(OWN + "key")).distinct()
    return keyed.join(kept, OWN + "key", "left_semi").dropDuplicates([OWN + "key"]).select(*own(docs))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms of the same format and length."""
    rest = [c for c in docs.columns if c != "text"]
    return pseudonymise(docs, PSEUDONYM_KEY, keep=rest, prefix=OWN).select(*own(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    mixed = mix(docs, keep=["doc_id", *(c for c in docs.columns if c != "doc_id")], prefix=OWN)
    times = F.when(F.col(OWN + "size") > 0, F.col(OWN + "taken") / F.col(OWN + "size")).otherwise(0).cast("int")
    return mixed.where(F.col(OWN + "taken") > 0).withColumn(OWN + "copy", F.explode(F.sequence(F.lit(1), times))).select(*own(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("near-dedup", near_dedup), ("PII pseudonyms", pseudonyms), ("source mix", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
