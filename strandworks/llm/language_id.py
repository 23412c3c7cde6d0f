"""Language identification by word-first backoff.

A word seen in training scores by its log frequency in each language. An unseen word falls back to its
character n-grams: each place takes the longest known one, down to single characters.
The model is fitted on a bounded sample of labelled rows; every document is scored over its whole text.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.common import bounded_batches, sample_of, worker_state

UNDETERMINED = "und"
#: Labelled rows of a language that the model is fitted on (those with the smallest hash of id).
FIT_ROWS = 1500
LONGEST_GRAM = 4
#: Words that a worker remembers, and the longest it remembers; longer ones are scored anew each time.
CACHE_ENTRIES = 500_000
CACHE_CHARS = 48
#: How much one word can say: posterior odds stay below certainty on short texts.
FLOOR = 0.5
#: Bound of one term's log odds.
MOST_ODDS = math.log(1e4)
WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The lower-cased runs of letters; numerals outside the decimal digits are no letters."""
    found = WORDS.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]


def grams_of(word: str, n: int) -> list[str]:
    """The character n-grams of a word with its borders marked."""
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(words_of(text or ""))
        rows = []
        for lang, counts in found.items():
            grams: list[Counter] = [Counter() for _ in range(LONGEST_GRAM + 1)]
            for word, n in counts.items():
                rows.append((lang, 0, word, n))
                for k in range(1, LONGEST_GRAM + 1):
                    for g in grams_of(word, k):
                        grams[k][g] += n
            rows += [(lang, k, g, n) for k in range(1, LONGEST_GRAM + 1) for g, n in grams[k].items()]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], names=["lang", "kind", "term", "n"])


@dataclass(frozen=True)
class Model:
    """langs in order; the known words and n-grams with their log probabilities in each language.

    ``words`` and ``grams`` give row numbers in ``word_scores`` and ``gram_scores``; ``key`` tells models apart.
    """

    key: str
    langs: tuple[str, ...]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray

    def backoff(self, word: str) -> np.ndarray:
        """The mean score of the n-grams of an unseen word, weighted by length.

        From left to right, each place takes the longest known n-gram, down to single characters.
        """
        padded, grams = f"^{word}$", self.grams
        rows, at, used = [], 0, 0
        while at < len(padded):
            for k in range(LONGEST_GRAM, 0, -1):
                row = grams.get(padded[at : at + k])
                if row is not None:
                    rows.append(row)
                    k = min(k, len(padded) - at)
                    used += k
                    at += k
                    break
            else:
                at += 1
        return self.gram_scores[rows].sum(axis=0) / max(used, 1)


class Scorer(dict):
    """Row numbers of known words; what is missing is backed off to n-grams and remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(self.model.words)
        self.used = len(self.model.words)
        self.scores = np.zeros((max(2 * self.used, 1024), len(self.model.langs)))
        self.scores[: self.used] = self.model.word_scores

    def __missing__(self, word: str) -> int:
        if self.used == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        row = self.used
        self.scores[row] = self.model.backoff(word)
        self.used += 1
        self[word] = row
        return row

    def score(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words:
            return UNDETERMINED, 0.0
        if not self.model.langs:
            return UNDETERMINED, 0.0
        if self.used > CACHE_ENTRIES + len(self.model.words):
            self.reset()
        short = words if len(max(words, key=len)) <= CACHE_CHARS else [w for w in words if len(w) <= CACHE_CHARS or w in self]
        rows = np.fromiter(map(self.__getitem__, short), np.int64, len(short))
        total = self.scores[rows].sum(axis=0)
        if len(short) < len(words):
            total = total + sum(n * self.model.backoff(w) for w, n in Counter(w for w in words if len(w) > CACHE_CHARS and w not in self).items())
        total = total * FLOOR
        best = int(np.argmax(total))  # ties go to the first language by code point
        return self.model.langs[best], float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def fit(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``fit_rows`` rows of each language, counted in Spark over their whole texts.

    The sample's size bounds the model: all words and n-grams of the sample are in it, however long or rare. Rows whose
    text or language is null are not learned from; where two rows share a hash of their id, either may be taken.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    share = {r["lang"]: min(1.0, 1.2 * fit_rows / r["count"]) for r in labelled.groupBy(F.col(lang_col).alias("lang")).count().collect()}  # a row for each language
    sample = sample_of(labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h")), "lang", share, fit_rows)
    counts = sample.select("text", "lang").mapInArrow(_terms, "lang string, kind int, term string, n long").groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"))
    terms = counts.toArrow().sort_by([("kind", "ascending"), ("term", "ascending")])  # those of at most fit_rows texts of each language
    langs = tuple(sorted(terms["lang"].unique().to_pylist()))
    words, grams, scores = {}, {}, {}
    for kind in range(LONGEST_GRAM + 1):
        part = terms.filter(pc.equal(terms["kind"], kind)).combine_chunks()
        found = pc.unique(part["term"])
        every = np.zeros((len(found), len(langs)))
        every[pc.index_in(part["term"], found).to_numpy(), pc.index_in(part["lang"], pa.array(langs, pa.string())).to_numpy()] = part["n"].to_numpy()
        log = np.log((every + 0.5) / (every.sum(axis=0) + 0.5 * max(1, len(found))))
        log -= log.mean(axis=1, keepdims=True) if len(langs) else 0
        scores[kind] = np.clip(log, -MOST_ODDS, MOST_ODDS) * max(kind, 1)
        target = grams if kind else words
        target.update(zip(found.to_pylist(), range(len(target), len(target) + len(found))))
    grams_score = np.concatenate([scores[k] for k in range(1, LONGEST_GRAM + 1)])
    return Model(uuid.uuid4().hex, langs, words, scores[0], grams, grams_score)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``lang_pred`` and ``score`` (the posterior of that language) for every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0. Ties go to the first language by code point.
    Words of any length count with all their characters. Repeated rows stay and an empty table gives no rows; the
    columns in ``keep`` (by default the id) are carried along under any name, others are dropped, and ``prefix`` goes
    before the names of the two new columns.
    """
    bounded_batches(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = worker_state(("language ID", shared.value.key), lambda: Scorer(shared.value))
        for batch in batches:
            found = [scorer.score(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[f.name for f in out.fields])

    out = T.StructType([*(docs.schema[c] for c in keep), T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())])
    return docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(keep)), F.col(text_col).alias("__text")).mapInArrow(score, out)
