"""Quality by nearest-neighbour voting on latent-semantic vectors.

A text is a bag of hashed words and of word shapes (how a word is cased and what marks surround it), beside a few
traits of the whole text (how often a word repeats the one before it, and the like). Weighted counts of a bounded
sample of labelled rows give a latent-semantic basis by a singular value decomposition; the sample's vectors are
broadcast. Every document's vector meets all of them in blocks of exact cosine products, and the labels of the
nearest vote with their similarity as weight.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.common import bounded_batches, sample_of, worker_state

#: Labelled rows of a label that the classifier is fitted on (those with the smallest hash of id).
FIT_ROWS = 1500
#: Hash buckets of words and of shapes, dimensions of the basis, neighbours that vote.
WORDS, SHAPES, LATENT, NEIGHBOURS = 512, 512, 48, 25
#: Traits of a text, each as a share and its complement, and their weight beside words and shapes.
TRAITS, TRAIT_WEIGHT = 4, 6.0
#: Power of the similarity that weights a vote.
SHARPNESS = 4
#: Words that a worker remembers, and the longest it remembers.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 48
TRAIT = (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"\d+"))


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits become one sign each; other characters stay."""
    for mark, pattern in zip("Aa0", TRAIT, strict=True):
        word = pattern.sub(mark, word)
    return word


class Features(dict):
    """Packed bucket numbers (word, shape) by word."""

    def __missing__(self, word: str) -> tuple[int, int]:
        plain = word.lower().strip(".,;:!?").encode("utf-8", "surrogatepass")
        found = (zlib.crc32(plain) % WORDS, WORDS + zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % SHAPES)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = found
        return found


def features(texts: list[str | None]) -> np.ndarray:
    """Damped counts by bucket, then traits, a row for each text; words, shapes and traits have length one each."""
    buckets = worker_state(("quality",), Features)
    out = np.zeros((len(texts), WORDS + SHAPES + 2 * TRAITS), np.float32)
    bags = out[:, : WORDS + SHAPES]
    for row, whole, text in zip(bags, out, texts, strict=True):
        found = (text or "").split()
        counts = Counter(found)
        if not counts:
            continue
        lines = [x for x in text.split("\n") if x.strip()]
        share = np.array([sum(map(eq, found, found[1:])) / len(found), 1 - len(set(lines)) / max(1, len(lines)), sum(map(str.isupper, found)) / len(found), 1 - len(counts) / len(found)])
        whole[WORDS + SHAPES :: 2] = np.sqrt(share)
        whole[WORDS + SHAPES + 1 :: 2] = np.sqrt(1 - share)
        pairs = np.array(list(map(buckets.__getitem__, counts)))
        n = np.fromiter(counts.values(), float, len(counts))
        row += np.bincount(pairs[:, 0], n, WORDS + SHAPES)
        row += np.bincount(pairs[:, 1], n, WORDS + SHAPES)
    np.log1p(bags, out=bags)
    for part in (slice(0, WORDS), slice(WORDS, WORDS + SHAPES), slice(WORDS + SHAPES, None)):
        size = np.linalg.norm(out[:, part], axis=1, keepdims=True)
        out[:, part] /= np.where(size > 0, size, 1)
    return out


@dataclass(frozen=True)
class Voters:
    """The broadcast model: at most ``fit_rows`` vectors of LATENT numbers for each label."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        out = (rows * self.weight) @ self.basis
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(size > 1e-9, out / np.where(size > 1e-9, size, 1), 0)

    def vote(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), block):
            near = self.latent(features(texts[at : at + block])) @ self.vectors.T
            near = np.round(near, 9)  # equal vectors are equally near, whatever the order of their sums
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            w = np.where(near >= least[:, None], np.maximum(near, 0) ** SHARPNESS, 0)
            total = w.sum(axis=1)
            out[at : at + block] = np.where(total > 0, w @ self.labels / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Voters:
    """Fit on at most ``fit_rows`` ids of each label; weights and basis come from that sample alone.

    Rows with a null id, label or text are not learned from. If an id is labelled twice, the higher label counts; if
    it has several texts, the first of them in order is learned from, so an id is one voter.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).withColumn("h", F.xxhash64("id"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    some = sample_of(known, "label", {k: min(1.0, 1.2 * fit_rows / n) for k, n in counts.items()}, fit_rows)
    chosen = some.select("id", "label")  # at most fit_rows rows of each label
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in rows], pa.binary())], names=["label", "x"])

    found = sorted((r.label, r.x) for r in sample.mapInArrow(run, "label int, x binary").collect())  # a row for each id of the sample
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if not found:
        return Voters(np.ones(1), np.ones((1, 1)), np.zeros((0, 1)), np.zeros(0), prior)
    x = np.array([np.frombuffer(r, np.float32) for _, r in found]).astype(float)
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.3
    weight[WORDS + SHAPES :] = TRAIT_WEIGHT
    scaled = x * weight
    values, vectors = np.linalg.eigh(scaled.T @ scaled)
    basis = vectors[:, ::-1][:, : min(LATENT, len(x))]
    voters = Voters(weight, basis, np.zeros((0, 1)), np.array([label for label, _ in found], float), prior)
    return Voters(weight, basis, voters.latent(x), voters.labels, prior)


def vote(docs: DataFrame, voters: Voters, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from the threshold on) of every row.

    The NEIGHBOURS nearest vote, and all that are as near as the last of them. Null and empty texts have no
    neighbours: their score is the share of label 1 among the labels learned from. Words of any length count with all
    their characters. Repeated rows stay and get one score; an empty table gives no rows; a null id stays null; other
    columns are dropped. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.vote(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
