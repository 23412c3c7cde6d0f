"""Token counts with a whole-token shortcut.

A byte-pair vocabulary whose pieces hold the space mark only at their start never merges
across the end of a word, and one whose pieces hold no line feed never merges across a line.
Both are proved on the vocabulary, as is the list of strings that encode alone as one token.
A text is then a list of pre-tokens; those on the list count one, the library merges the rest,
and each worker remembers what it has merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandworks.llm.common import bounded_batches, worker_state

MARK = "▁"
#: Merged pre-tokens that a worker remembers, and the longest it remembers.
CACHE_ENTRIES = 1_000_000
CACHE_CHARS = 48
RUNS = re.compile(r" +[^ ]*|[^ ]+")


@dataclass(frozen=True)
class Proof:
    """What has been proved of one vocabulary; its size is bounded by the vocabulary's.

    after_space: strings that encode as one token after a space (or at a text's start);
    after_line: strings that do so after a line feed; by_space and by_line: whether texts may be cut there.
    """

    path: str
    after_space: frozenset[str]
    after_line: frozenset[str]
    by_space: bool
    by_line: bool


def prove(path: str) -> Proof:
    """Find, on the driver and without any text, which strings of the vocabulary are whole tokens."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = {model.id_to_piece(i): i for i in ids}
    by_space = all(MARK not in p.lstrip(MARK) for p in pieces) and model.encode("a") == model.encode("a b")[:1] and len(model.encode("a ")) == 2
    by_line = all("\n" not in p for p in pieces) and len(model.encode("\n")) == 2
    spaced = frozenset(p[1:] for p, i in pieces.items() if p[:1] == MARK and MARK not in p[1:] and p[1:] and model.encode(p[1:]) == [i])
    lined = frozenset(p for p, i in pieces.items() if MARK not in p and by_line and model.encode("\n" + p)[2:] == [i])
    return Proof(path, spaced, lined, by_space, by_line)


class Merged(dict):
    """Token counts by pre-token; what is missing is merged by the library."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, prefix: str, known: frozenset[str], empty: int):
        super().__init__(dict.fromkeys(known, 1))
        self.model, self.prefix, self.known, self.empty = model, prefix, known, empty
        self[""] = empty
        self.less = len(model.encode(prefix)) if prefix else 0

    def __missing__(self, key: str) -> int:
        n = len(self.model.encode(self.prefix + key)) - self.less
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
                self.update(dict.fromkeys(self.known, 1))
                self[""] = self.empty
            self[key] = n
        return n


class Counter:
    """Counts the tokens of texts as the library would for the whole text."""

    def __init__(self, proof: Proof):
        self.model, self.proof = sentencepiece.SentencePieceProcessor(model_file=proof.path), proof
        self.spaced = Merged(self.model, "", proof.after_space, 1)
        self.lined = Merged(self.model, "\n", proof.after_line, 0)

    def runs(self, line: str) -> int:
        """A line that holds runs of spaces: a run belongs to the word that follows it."""
        return sum(self.spaced[x[1:]] if x[0] == " " else self.lined[x] for x in RUNS.findall(line))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not (self.proof.by_space and self.proof.by_line):
            return len(self.model.encode(text))
        lines = text.replace(MARK, " ").split("\n")
        first, spaced, lined = lines[0], self.spaced.__getitem__, self.lined
        total = len(lines) - 1
        if first[:1] == " " or "  " in first:
            total += self.runs(" " + first)
        else:
            total += sum(map(spaced, first.split(" ")))
        for line in lines[1:]:
            if "  " in line:
                total += self.runs(line)
            elif line:
                words = line.split(" ")
                total += lined[words[0]] + sum(map(spaced, words[1:]))
        return total


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of each whole text.

    Returns a row for each row of ``docs`` (repeated rows stay repeated): the id, ``n_bytes``, ``n_tokens``
    and ``over_limit``. Null and empty texts have 0 bytes and 0 tokens; a null id stays null; further columns
    are ignored. One narrow pass: nothing is shuffled, and a worker holds one bounded batch of texts.
    """
    bounded_batches(docs.sparkSession)
    proof = docs.sparkSession.sparkContext.broadcast(prove(model_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(("token counts", proof.value.path), lambda: Counter(proof.value))
        for batch in batches:
            texts = batch.column(1)
            size = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            tokens = [counter.count(x.as_py()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    out = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(count, out)
