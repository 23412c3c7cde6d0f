"""The fitted scorers of operators 4 and 10 against plain ones that go text by text, with ties, long texts and clashing names."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from strandworks.llm import language_id, quality_knn
from strandworks.llm.common import is_train

SCHEMA = "doc_id long, text string, lang string, label int, score double, h long, x string"


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, 1, 0.5, 7, "x") for i, t, lang in rows], SCHEMA)


def held(i, modulus, at):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == at


# --- op10 -------------------------------------------------------------------------------------------------------------


def grams(word, n):
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def dictionaries(rows):
    """Log odds of words (kind 0) and of n-grams by language, from counts alone."""
    langs = sorted({lang for _, t, lang in rows if lang is not None and t is not None and re.search(r"[^\W\d_]", t)})
    counts = {k: {lang: Counter() for lang in langs} for k in range(5)}
    for _, t, lang in rows:
        if lang in langs and t is not None:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                counts[0][lang][w] += 1
                for k in range(1, 5):
                    counts[k][lang].update(grams(w, k))
    scores = {}
    for k, by in counts.items():
        terms = set().union(*(set(c) for c in by.values()))
        total = {lang: sum(by[lang].values()) + 0.5 * len(terms) for lang in langs}
        for term in terms:
            log = [math.log((by[lang][term] + 0.5) / total[lang]) for lang in langs]
            mean = sum(log) / len(log)
            scores[k, term] = [max(-math.log(1e4), min(math.log(1e4), x - mean)) * max(k, 1) for x in log]
    return langs, scores


def plain_score(text, langs, scores):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words or not langs:
        return "und", 0.0
    total = [0.0] * len(langs)
    for w in words:
        found = scores.get((0, w))
        if found is None:
            padded, at, used, found = f"^{w}$", 0, 0, [0.0] * len(langs)
            while at < len(padded):
                k = next((k for k in range(4, 0, -1) if (min(k, len(padded) - at), padded[at : at + k]) in scores), None)
                if k is None:
                    at += 1
                    continue
                k = min(k, len(padded) - at)
                found = [a + b for a, b in zip(found, scores[k, padded[at : at + k]], strict=True)]
                used, at = used + k, at + k
            found = [x / max(used, 1) for x in found]
        total = [a + 0.5 * b for a, b in zip(total, found, strict=True)]
    best = max(range(len(langs)), key=lambda i: (round(total[i], 9), -i))
    return langs[best], 1 / sum(math.exp(max(-700, t - total[best])) for t in total)


def test_language_by_dictionaries(spark):
    rng = random.Random(4)
    vocab = {"en": ["the", "house", "with", "water", "stone"], "fr": ["le", "maison", "avec", "pierre", "été"], "de": ["das", "haus", "mit", "wasser", "über"]}
    rows = [(i, " ".join(rng.choices(vocab[lang], k=rng.randint(1, 12))), lang) for i, lang in enumerate(rng.choices(list(vocab), k=120))]
    rows += [(300, "housing, waterfall! 77 pierres", None), (301, "Überhaus", None), (302, "maison haus house", None), (303, "zzz qqq", None), (304, None, "en"), (305, "12 34", "en"), (306, "long" * 9000 + " maison", None), (306, "long" * 9000 + " maison", None), (307, "été " * 20_000, None), (None, "das wasser", "de")]
    train = [(i, t, lang) for i, t, lang in rows if not held(i, 3, 1)]
    langs, scores = dictionaries(train)
    docs = table(spark, rows)
    found = language_id.identify(docs, language_id.fit(docs, is_train("doc_id", 3, 1))).collect()
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in found), key=repr)
    want = sorted(((i, *plain_score(t, langs, scores)) for i, t, _ in rows), key=repr)
    assert len(got) == len(want) and len(langs) == 3
    for (i, a, x), (j, b, y) in zip(got, want, strict=True):
        assert (i, a) == (j, b) and abs(x - y) < 1e-9


# --- op4 --------------------------------------------------------------------------------------------------------------


def test_quality_by_plain_cosines(spark):
    rng = random.Random(6)
    good = ["water", "stone", "house", "tree", "river", "cloud"]
    rows = [(i, " ".join(rng.choices(good, k=rng.randint(3, 30))) if i % 3 else " | ".join(rng.choices(["buy", "NOW!!", "cheap"], k=20)), None) for i in range(240)]
    rows += [(i, "the same text", None) for i in range(240, 300)]  # ties: more equal voters than neighbours
    rows += [(400, None, None), (401, "", "en"), (402, "river " * 50_000, None), (402, "river " * 50_000, None), (403, "x" * 60_000, None), (None, "stone", None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    docs = table(spark, rows)
    voters = quality_knn.fit(docs, labels, is_train("doc_id", 4, 2))
    train = [(i, t) for i, t, _ in rows if i is not None and i < 300 and not held(i, 4, 2)]
    assert len(voters.labels) == len(train)
    latent = lambda texts: voters.latent(quality_knn.features(texts))
    held_vectors, marks = latent([t for _, t in train]), [int(i % 3 > 0) for i, _ in train]
    prior = sum(marks) / len(marks)
    want = []
    for i, t, _ in rows:
        v = latent([t])[0]
        near = [round(float(sum(a * b for a, b in zip(v, u, strict=True))), 9) for u in held_vectors]
        least = sorted(near, reverse=True)[quality_knn.NEIGHBOURS - 1]
        votes = [(max(s, 0) ** quality_knn.SHARPNESS, m) for s, m in zip(near, marks, strict=True) if s >= least]
        total = sum(w for w, _ in votes)
        want.append((i, sum(w * m for w, m in votes) / total if total > 0 else prior))
    got = sorted(((r.doc_id, r.score, r.predicted) for r in quality_knn.vote(docs, voters).collect()), key=lambda r: (str(r[0]), r[1]))
    want.sort(key=lambda r: (str(r[0]), r[1]))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(abs(a[1] - b[1]) < 1e-6 and a[2] == int(a[1] >= 0.7) for a, b in zip(got, want, strict=True))
    assert np.isclose(next(s for i, s, _ in got if i == 400), next(s for i, s, _ in got if i == 401))
