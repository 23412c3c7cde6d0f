"""Vector bin packing of token sequences with the dot-product heuristic.

A document's ids are cut at multiples of the sequence length; full pieces are sequences of their own. What is left
of each document is an item with three demands: tokens, segments and loss-bearing tokens. An open sequence takes
the item whose demands have the largest dot product with what it has left, until nothing fits. Items with equal
demands are one class, so a step looks at classes, not at items. If a gap of some size stays and the limits on
segments and loss-bearing tokens allow it, the next item is cut to fill it.

Ids are those of the ``tokenizers`` file. Where that file is a plain byte-level BPE whose merges stand in the order of
their ids, merging by rank gives the same ids (a token's own merges never depend on what surrounds it), so the ranks
are read from the file and ``tiktoken`` merges by them; texts that may hold a special string go to the library.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandworks.llm.common import bounded_batches, worker_state

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
TOKENS, SEGMENTS, LOSS = 2048, 64, 2048
#: Items that are packed together; a sequence never waits for more of them.
ITEMS = 8192
#: A gap of fewer tokens is left as padding.
SMALLEST_CUT = 8
END_ID = 1
#: The pattern of the byte-level pre-tokenizer, and (below) the bytes it writes as themselves; fixed values.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: A run of white space for which the merging library's pattern needs more stack than it has.
LONG_SPACE = 100_000
SPACES = re.compile(r"(?<!\s)\s{%d}" % LONG_SPACE)  # looked for where a run begins
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))


def byte_ranks(path: str) -> tuple[dict[bytes, int], list[str]] | None:
    """The ranks of a byte-level BPE file and its special strings; None if merging by rank may differ from the file."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "unk_token"))
    if not plain or file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    rest = [b for b in range(256) if b not in PLAIN_BYTES]
    signs = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = [x["content"] for x in file.get("added_tokens", [])]
    ranks = {bytes(map(signs.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"].get("".join(m), -1) for m in pairs]
    if made != sorted(set(made)) or len(made) + 256 != len(ranks):
        return None
    return ranks, special


class Ids:
    """Little-endian ids of whole texts, as the library gives them."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        found = byte_ranks(path)
        self.special = found[1] if found else []
        self.merges = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=found[0], special_tokens={}) if found else None

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.merges is None or any(x in text for x in self.special) or len(text) >= LONG_SPACE and SPACES.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.merges.encode_ordinary(text), "<u4").tobytes()


@dataclass
class Item:
    """A piece that is yet to be placed; ids are kept, as it may be cut once more.

    ``bears``: from where to where its document's tokens bear loss.
    """

    owner: int
    start: int
    ids: bytes
    bears: tuple[int, int]

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return max(0, min(self.start + self.tokens, self.bears[1]) - max(self.start, self.bears[0]))


@dataclass
class Sequence:
    pieces: list[tuple[Item, int]] = field(default_factory=list)
    tokens: int = 0
    loss: int = 0

    def add(self, item: Item) -> None:
        self.pieces.append((item, self.tokens))
        self.tokens += item.tokens
        self.loss += item.loss


class _Classes:
    """Items by their demands: a row of ``need`` and of ``count`` for each (tokens, loss), grown by doubling.

    Rows that are used up are dropped once they are half of all, so a step scores what is left.
    """

    def __init__(self, items: list[Item], limit: np.ndarray):
        self.limit, self.held = limit, {}
        for item in items:
            self.held.setdefault((item.tokens, item.loss), []).append(item)
        for x in self.held.values():
            x.reverse()
        self.keys = sorted(self.held, reverse=True)
        self.need = np.array([(t, 1, x) for t, x in self.keys], float).reshape(-1, 3) / limit
        self.count = np.array([len(self.held[k]) for k in self.keys], np.int64)
        self.place = {k: i for i, k in enumerate(self.keys)}
        weight = (self.need * self.count[:, None]).sum(axis=0) / max(1, self.count.sum())
        self.weight, self.scaled, self.used = weight, self.need * weight, 0

    def take(self, i: int) -> Item:
        item = self.held[self.keys[i]].pop()
        self.count[i] -= 1
        self.used += not self.count[i]
        return item

    def put(self, item: Item) -> None:
        key = (item.tokens, item.loss)
        if key not in self.place:
            n = len(self.keys)
            self.place[key] = n
            self.keys.append(key)
            self.held[key] = []
            if n == len(self.count):
                more = max(64, n)
                self.need = np.concatenate([self.need, np.full((more, 3), np.inf)])
                self.scaled = np.concatenate([self.scaled, np.zeros((more, 3))])
                self.count = np.concatenate([self.count, np.zeros(more, np.int64)])
            self.need[n] = np.array([key[0], 1, key[1]], float) / self.limit
            self.scaled[n] = self.need[n] * self.weight
            self.used += 1
        i = self.place[key]
        self.used -= not self.count[i]
        self.count[i] += 1
        self.held[key].append(item)

    def compact(self) -> None:
        if 2 * self.used > len(self.keys):
            live = np.nonzero(self.count)[0]
            self.keys = [self.keys[i] for i in live]
            self.held = {k: self.held[k] for k in self.keys}
            self.place = {k: i for i, k in enumerate(self.keys)}
            self.need, self.scaled, self.count, self.used = self.need[live], self.scaled[live], self.count[live], 0


def pack_items(items: list[Item], limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> list[Sequence]:
    """Place items under the three limits; every token is placed, and no limit is exceeded.

    A dimension's weight is the mean demand over its limit, so the scarcest dimension counts most. Ties go to the
    class with more tokens and, in a class, to the item that came first. An item that exceeds a limit alone is cut.
    """
    limit = np.array(limits, float)
    fit, todo = [], list(reversed(items))
    while todo:
        item = todo.pop()
        if item.tokens > limits[0] or item.loss > limits[2]:
            todo += reversed(_cut(item, min(limits[0], limits[2])))
        else:
            fit.append(item)
    left_over = _Classes(fit, limit)
    out: list[Sequence] = []
    while left_over.count.any():
        now, left = Sequence(), np.ones(3)
        while len(now.pieces) < limits[1]:
            fits = (left_over.count > 0) & (left_over.need <= left + 1e-12).all(axis=1)
            value = np.where(fits, left_over.scaled @ left, -1.0)
            best = int(np.argmax(value))
            if value[best] < 0:
                break
            now.add(left_over.take(best))
            left = 1 - np.array([now.tokens, len(now.pieces), now.loss]) / limit
        gap = min(limits[0] - now.tokens, limits[2] - now.loss)
        if gap >= SMALLEST_CUT and len(now.pieces) < limits[1] and left_over.count.any():
            item = left_over.take(int(np.argmax(left_over.count > 0)))  # about the largest, of which the gap takes the least part
            head = Item(item.owner, item.start, item.ids[: 4 * gap], item.bears)
            now.add(head)
            if gap < item.tokens:
                left_over.put(Item(item.owner, item.start + gap, item.ids[4 * gap :], item.bears))
        out.append(now)
        left_over.compact()
    return out


def _cut(item: Item, size: int) -> list[Item]:
    """Pieces of at most ``size`` tokens."""
    return [Item(item.owner, item.start + at, item.ids[4 * at : 4 * (at + size)], item.bears) for at in range(0, item.tokens, size)]


def pack(docs: DataFrame, tokenizer_path: str, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None) -> DataFrame:
    """The pieces of every text and their places in sequences of at most ``limits[0]`` tokens.

    Returns for each piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` (with the id that ends a
    document), ``sequence_id`` and ``offset``. A document is its prompt (if ``prompt_col`` names one) and its text;
    every token of the text bears loss, those of the prompt and the one that ends a document don't. With plain texts
    and limits of as many loss-bearing tokens as tokens, the third limit follows from the first one.

    Null and empty texts have the last token alone; an empty table gives no rows. Repeated rows are packed each; a
    null id stays null; further columns are ignored. Partitions are packed on their own, ITEMS items at a time, in the
    order of the input, so nothing is shuffled, memory is bounded and a task that runs again gives the same
    sequences; the last sequence of each partition may be short.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, number = worker_state(("packing", tokenizer_path), lambda: Ids(tokenizer_path)), TaskContext.get().partitionId() << 40
        step = min(limits[0], limits[2])
        owners: list = []
        totals: list[int] = []
        waiting: list[Item] = []
        end = END_ID.to_bytes(4, "little")

        def rows(sequences: list[Sequence]) -> pa.RecordBatch:
            nonlocal number
            found = []
            for sequence in sequences:
                for item, offset in sequence.pieces:
                    found.append((owners[item.owner], item.start, item.tokens, zlib.crc32(item.ids), totals[item.owner], number, offset))
                number += 1
            columns = list(zip(*found, strict=True)) or [[]] * 7
            kinds = [id_type, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.types[0]
            full = []
            for owner, text, prompt in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ahead = ids_of.of(prompt.as_py())
                ids = ahead + ids_of.of(text.as_py()) + end
                n = len(ids) // 4
                bears = (len(ahead) // 4, n - 1)
                owners.append(owner)
                totals.append(n)
                whole = n // step * step if limits[0] == step else 0
                for at in range(0, whole, step):
                    one = Sequence()
                    one.add(Item(len(owners) - 1, at, ids[4 * at : 4 * (at + step)], bears))
                    full.append(one)
                if whole < n:
                    waiting.append(Item(len(owners) - 1, whole, ids[4 * whole :], bears))
            yield rows(full)
            if len(waiting) >= ITEMS:
                done = pack_items(waiting, limits)
                yield rows(done[:-1])
                rest = [item for item, _ in done[-1].pieces]
                kept = sorted({x.owner for x in rest})
                place = {x: i for i, x in enumerate(kept)}
                owners, totals = [owners[i] for i in kept], [totals[i] for i in kept]
                waiting = [Item(place[x.owner], x.start, x.ids, x.bears) for x in rest]
        if waiting:
            yield rows(pack_items(waiting, limits))

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in names[1:])])
    prompt = F.col(prompt_col) if prompt_col else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), prompt.alias("prompt")).mapInArrow(run, out)
