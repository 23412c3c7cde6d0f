"""The pipeline's near-duplicate stage against brute force over all pairs of five-word shingle sets."""

import random

import numpy as np

import corpus_pipeline
from strandworks.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def kept_by_brute_force(rows):
    root = {i: i for i, _ in rows}
    sets = [shingles(t) for _, t in rows]

    def find(i):
        return i if root[i] == i else find(root[i])

    for n, (i, _) in enumerate(rows):
        for m, (j, _) in enumerate(rows[:n]):
            if len(sets[n] & sets[m]) / len(sets[n] | sets[m]) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in root}


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}


def test_copies_with_changed_words(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        words = rng.choices(vocab, k=rng.randint(60, 200))
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 5):  # k single words changed touch up to 5k shingles: similarities on both sides of 0.8
            copy = list(words)
            for at in rng.sample(range(len(copy)), k):
                copy[at] = rng.choice(vocab)
            rows.append((10 * i + k, " ".join(copy)))
    want = kept_by_brute_force(rows)
    assert 40 < len(want) < 120 and run(spark, rows) == want


def test_one_repeated_line_is_no_copy(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    line = "all rights reserved by the owner of this page "
    rows = [(i, line * 60 + " ".join(rng.choices(vocab, k=25))) for i in range(30)]
    rows += [(100, line * 60), (101, line * 80)]  # one set
    assert run(spark, rows) == kept_by_brute_force(rows) == {*range(30), 100}


def test_a_large_group_and_common_passages(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    base, passage = rng.choices(vocab, k=100), " ".join(rng.choices(vocab, k=30))
    rows = [(i, " ".join(base[:at] + [f"x{i}"] + base[at + 1 :])) for i in range(80) for at in [rng.randrange(10, 90)]]
    rows += [(500 + i, " ".join(rng.choices(vocab, k=60)) + " " + passage) for i in range(60)]
    assert run(spark, rows) == kept_by_brute_force(rows)


def test_two_tables_in_one_worker(spark, monkeypatch):
    """What is common in the table before must not order the shingles of this one."""
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(0, 300, 2):
        words = rng.choices(vocab, k=60)
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words[:58], "x", "y"]))]
    want = kept_by_brute_force(rows)
    before = [(1000 * k + i, t) for k in range(5) for i, t in rows[::2]]
    near_copies.near_copies(spark.createDataFrame(before, "doc_id long, text string").repartition(1)).collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r.component_id for r in near_copies.near_copies(docs).collect()}
    assert found == want


def test_prefixes_are_complete():
    for n in range(1, 400):
        assert near_copies.prefix_size(n) == n - int(np.ceil(np.round(0.8 * n, 9))) + 1
