"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.llm.common import is_train, read_table
from strandworks.llm.conversation_trie import prefix_trie
from strandworks.llm.exact_topk import top_k
from strandworks.llm.language_id import fit, identify
from strandworks.llm.mixing import mix
from strandworks.llm.nn_descent import nearest
from strandworks.llm.packing import pack
from strandworks.llm.pseudonyms import pseudonymise
from strandworks.llm import quality_knn
from strandworks.llm.quality_rules import apply_rules
from strandworks.llm.rule_sql import OP11_SQL
from strandworks.llm.simhash_golay import near_duplicates
from strandworks.llm.spelling import variants
from strandworks.llm.suffix_dedup import remove_repeats
from strandworks.llm.token_counts import token_counts
from strandworks.llm.trie_sql import OP12_SQL, OP13_SQL


#: The key of the registered query; a job takes its own from a secret store.
PSEUDONYM_KEY = b"registered query"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), keep_text=True)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, train = read_table(spark, sf_dir, "documents"), is_train("doc_id", 4, 2)
    voters = quality_knn.fit(docs, read_table(spark, sf_dir, "labels"), train)
    return quality_knn.vote(docs, voters).select("doc_id", (~train).alias("held_out"), "score", "predicted")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    train = is_train("doc_id", 3, 1)
    return identify(docs, fit(docs, train)).select("doc_id", (~is_train("doc_id", 3, 1)).alias("held_out"), "lang_pred", "score")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_exact_topk": op2_exact_topk,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_quality": op4_quality,
        "op5_pseudonyms": op5_pseudonyms,
        "op6_nn_descent": op6_nn_descent,
        "op7_packing": op7_packing,
        "op8_mixing": op8_mixing,
        "op9_simhash": op9_simhash,
        "op10_language_id": op10_language_id,
        "op11_quality_rules": op11_quality_rules,
        "op12_spelling": op12_spelling,
        "op13_conversation_trie": op13_conversation_trie,
    }


#: Brute force for op2: every query against every other row.
OP2_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(greatest(least(CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS HUGEINT), 9223372036854775807), -9223372036854775807) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2_SQL, "op11_quality_rules": OP11_SQL, "op12_spelling": OP12_SQL, "op13_conversation_trie": OP13_SQL}
