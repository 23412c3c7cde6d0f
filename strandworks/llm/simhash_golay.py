"""SimHash near-duplicates through Golay-code fuzzy keys.

The perfect binary Golay code (23, 12, 7) puts every 23-bit word within three bits of exactly one codeword.
A word's keys are the indices of the codewords that it and the words one flip away decode to: one key if the
word lies within two bits of its codeword, six otherwise. Two words that differ in at most two bits share a key,
as the word between them is one flip from both.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in at most three bits,
either some segment is equal, and one of them has a next segment that differs in at most two bits; or each segment
differs in exactly one bit. In the first case the equal segment and a codeword index of the next one are a shared key.
In the second one a shared key has the codeword indices of two segments (one row's own index of the first and the other
row's own index of the second: each is an index one flip away for the other row), the half of the third segment that
is equal, and whether the segments' parities agree, which single errors in all of them leave as it is. A row has about
50 keys of some 35 bits. Rows are joined on them and verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.common import bounded_batches, cut, partitions, worker_state
from strandworks.operators.graph import connected_components

SEED = 42
#: (lowest bit, number of bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: (lowest bit, number of bits) of the halves of the last segment.
HALVES = ((0, 10), (10, 11))
#: Generator polynomial of the code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: Fingerprints that share a key beyond which they are compared in blocks of this size, each pair of blocks a task.
BLOCK = 2048
#: Distance beyond which the keys are no longer complete.
MOST_BITS = 3


def _remainder(words: np.ndarray) -> np.ndarray:
    """The words (23 bits) modulo the generator: 11 bits."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@cache
def _errors() -> np.ndarray:
    """The error of at most three bits for each of the 2048 syndromes; the code is perfect, so each has one."""
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)], np.int64)
    table = np.full(2048, -1, np.int64)
    table[_remainder(errors)] = errors
    assert (table >= 0).all()
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ _errors()[_remainder(words)]) >> 11


@cache
def _syndromes() -> np.ndarray:
    return _remainder(1 << np.arange(23, dtype=np.int64))


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """24 codeword indices for each word: its own and those one flip away; repeats are left in."""
    syndrome = _remainder(words)
    own = (words ^ _errors()[syndrome]) >> 11
    flips = 1 << np.arange(23, dtype=np.int64)
    near = (words[:, None] ^ flips) ^ _errors()[syndrome[:, None] ^ _syndromes()]
    return np.column_stack([own, near >> 11])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a text: a bit is set if more than half of its shingles' XXH64 have it set."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(line, SEED)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = (starts + lengths)[words - 1 :].tolist()
    pieces = [line[a:b] for a, b in zip(starts.tolist(), ends, strict=False)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096]
        ones += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.arange(64, dtype=object))[2 * ones > len(hashes)].sum()) if (2 * ones > len(hashes)).any() else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The id and ``fp`` (the fingerprint as a signed long) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("simhash",), dict)
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())]))


def keys_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of unsigned 64-bit fingerprints, and the place of the fingerprint that each belongs to."""
    parts = [(words >> np.uint64(low) & np.uint64((1 << size) - 1)).astype(np.int64) for low, size in SEGMENTS]
    near = [fuzzy_keys(x) for x in parts]
    first = [_firsts(x) for x in near]
    keys, owners = [], []

    def put(tag: int, key: np.ndarray, on: np.ndarray) -> None:
        keys.append((tag << 48) | key[on])
        owners.append(np.nonzero(on)[0])

    for i in range(3):
        j = (i + 1) % 3
        put(i, parts[i][:, None] << 12 | near[j], first[j])
    parity = [np.bitwise_count(x).astype(np.int64) & 1 for x in parts]
    signs = ((parity[0] ^ parity[1]) << 1 | (parity[0] ^ parity[2]))[:, None]
    other = first[0].copy()
    other[:, 0] = False  # the pair of both own indices is among those before
    for k, (low, size) in enumerate(HALVES):
        rest = (parts[2] >> low & ((1 << size) - 1))[:, None] << 2 | signs
        put(3 + k, (near[0][:, :1] << 12 | near[1]) << 13 | rest, first[1])
        put(3 + k, (near[0] << 12 | near[1][:, :1]) << 13 | rest, other)
    return np.concatenate(keys), np.concatenate(owners)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(every), 4096):
            fp = every[at : at + 4096]
            keys, owners = keys_of(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[owners])], names=["k", "fp"])


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where a key stands for the first time in its row."""
    order = np.argsort(keys, axis=1, kind="stable")
    ranked = np.take_along_axis(keys, order, axis=1)
    new = np.column_stack([np.ones(len(keys), bool), ranked[:, 1:] != ranked[:, :-1]])
    out = np.zeros_like(new)
    np.put_along_axis(out, order, new, axis=1)
    return out


def _forest(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected between two blocks (or in one): each fingerprint and its group's least.

    Groups are merged by whole arrays: the roots of all close pairs of a strip at once, until none differ.
    """
    nodes, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = inverse[: len(left)], inverse[len(left) :]
    root = np.arange(len(nodes))
    ours, theirs = left.view(np.uint64), right.view(np.uint64)
    for at in range(0, len(ours), 256):
        i, j = np.nonzero(np.bitwise_count(ours[at : at + 256, None] ^ theirs[None, :]) <= bits)
        x, y = a[at + i], b[j]
        while len(x):
            rx, ry = root[x], root[y]
            apart = rx != ry
            x, y = x[apart], y[apart]
            np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
            while not np.array_equal(up := root[root], root):
                root = up
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def _group_links(bits: int):
    """Links within each key's fingerprints, for mapInArrow on rows (k, fp) sorted by k: fewer than a group has rows."""

    def linked(k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0]
        sizes = np.diff(np.append(starts, len(k)))
        two = starts[sizes == 2]
        left, right = fp[two], fp[two + 1]
        near = np.bitwise_count(left.view(np.uint64) ^ right.view(np.uint64)) <= bits
        found = [(left[near], right[near])]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            group = np.sort(fp[at : at + n])
            found.append(_forest(group, group, bits))
        pairs = np.unique(np.column_stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                k, fp = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((k, fp)))
                last = int(np.searchsorted(k, k[-1]))
                if last:
                    yield linked(k[:last], fp[:last])
                k, fp = k[last:], fp[last:]
        if len(k):
            yield linked(k, fp)

    return run


def links(prints: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b) of different fingerprints, so that their components are those of all that differ in at most ``bits`` bits.

    ``prints``: distinct fingerprints, column ``fp``. Every close pair shares a key. The fingerprints of a key are
    compared with one another and yield a spanning forest, not their pairs; keys with more than a block of them are
    cut into blocks and each pair of blocks yields one. So no group is gathered in one task, and links grow with the
    rows, not with their square.
    """
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"the keys are complete for up to {MOST_BITS} bits")
    spark = prints.sparkSession
    keyed = cut(prints.select("fp").mapInArrow(_keys, "k long, fp long"))
    large = cut(keyed.groupBy("k").count().where(F.col("count") > BLOCK))
    small = keyed.join(large, "k", "left_anti").repartition(partitions(spark), "k").sortWithinPartitions("k")
    joined = small.mapInArrow(_group_links(bits), "a long, b long").distinct()

    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    held = keyed.join(large, "k").withColumn("n", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = held.select("k", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select("k", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fp, own = np.sort(group["fp"].to_numpy()), group["own"].to_numpy()
        if key[1] == key[2]:
            left = right = fp
        else:
            fp = group["fp"].to_numpy()
            left, right = np.sort(fp[own == key[1]]), np.sort(fp[own == key[2]])
        a, b = _forest(left, right, bits)
        return pd.DataFrame({"a": a, "b": b})

    blocked = dealt.repartition(partitions(spark), "k", "i", "j").groupBy("k", "i", "j").applyInPandas(compare, "a long, b long")
    return joined.unionByName(blocked)


def near_duplicates(docs: DataFrame, bits: int = MOST_BITS, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable) of every row.

    Equal fingerprints are one node, so groups of copies cost one row each before any join. Null and empty texts
    have fingerprint zero and are linked like others; a null id takes no part in the minimum. Repeated rows stay; an
    empty table gives no rows; further columns are ignored. Texts may have any length.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words))
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    groups = connected_components(links(nodes, bits), "a", "b", cut)
    member = nodes.join(groups, nodes["fp"] == groups["vertex"], "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
