"""The pipeline's stages on small tables, against what each must keep, drop or change."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandworks.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    random.seed(11)
    vocab = {"en": ["the", "house", "with", "water", "stone", "river", "cloud", "tree"], "fr": ["le", "maison", "avec", "pierre", "été", "fleuve", "nuage", "arbre"]}
    rows = []
    for i in range(120):
        lang = random.choice(list(vocab))
        rows.append((i, " ".join(random.choices(vocab[lang], k=random.randint(20, 90))), lang, f"s{i % 4}"))
    rows += [(200 + i, rows[3][1], rows[3][2], "s1") for i in range(5)]
    rows += [(300, None, "en", "s0"), (301, "", "en", "s0"), (302, "123 456", None, None), (303, rows[5][1] + " 4111111111111111 x@example.com", rows[5][2], None), (304, "own words of this one " + " ".join(f"k{i}" for i in range(40)) + " the house 4111111111111111 x@example.com", "en", None), (3, rows[3][1], rows[3][2], "s3")]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)


def test_stages(spark):
    docs = documents(spark)
    kept = corpus_pipeline.language(spark, docs, "").persist()
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {300, 301, 302}
    once = corpus_pipeline.near_dedup(spark, kept, "").persist()
    ids = [r.doc_id for r in once.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and not {200, 201, 202, 203, 204} & set(ids) and len(ids) >= 115
    assert 303 not in ids and 304 in ids  # 303 is 5 with two words more: a similarity above 0.8
    private = corpus_pipeline.pseudonyms(spark, once, "").persist()
    texts = {r.doc_id: r.text for r in private.collect()}
    assert sorted(texts) == sorted(ids) and "4111111111111111" not in texts[304] and "x@example.com" not in texts[304]
    mixed = corpus_pipeline.mixture(spark, private, "").persist()
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) == 2 and mixed.columns == docs.columns
    words = lambda df: df.agg(F.sum(F.size(F.split("text", " ")))).collect()[0][0]
    assert abs(words(mixed) - 1.5 * words(private)) < 100
    packed = corpus_pipeline.packing(spark, mixed, "").collect()
    assert {r.doc_id for r in packed} == set(times)


def test_stages_with_clashing_columns(spark):
    docs = documents(spark)
    names = ["score", "lang_pred", "n_replaced", "size", "source_size", "target", "taken", "n", "s", "h", "node", "th", "id", "key", "part", "draw", "a.b", "component_id", "fp"]
    more = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES:
        got, want = stage(spark, more, "").persist(), stage(spark, docs, "").persist()
        if "sequence_id" not in got.columns:
            assert got.columns == more.columns
            got = got.select(*docs.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty(spark, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_run_and_names(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100
    assert len(queries()) == 13 and set(oracle_sql()) <= set(queries())
