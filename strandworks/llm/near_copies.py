"""Near copies by exact similarity of shingle sets.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of at least 0.8. With all
sets in one order, such a pair has a shingle in common among the first n - ceil(0.8 n) + 1 of each set, so the join on
those finds every pair. Shingles that a sample holds often come last in the order: they would join texts that share
no more than a passage. Any order is complete, so the sample bears on the work alone, not on the result.

The sets' SimHash fingerprints come first: those within three bits of each other (joined on their Golay-code keys) are
candidates whatever their prefixes, one for each text. The prefix join then finds every pair that they miss.

Candidates must pass bounds by size and place, then one by counts (sets that differ in d shingles in some part of the
hashes' range differ in no fewer altogether), and are then verified on the whole sets. A shingle's pivot is the text
whose shingles are shared most. Each text first meets one pivot only, so that a large group of copies is linked by one
row each; then pivots meet those texts that are not connected with them yet; then all pairs that are not are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandworks.llm.common import bounded_batches
from strandworks.llm.common import cut_and_release as cut
from strandworks.llm.simhash_golay import links
from strandworks.operators.graph import connected_components

SEED = 42
WORDS = 5
#: One in so many texts is looked at for common shingles; how often they stand there, and how many are put last.
SAMPLE, COMMON, MOST_COMMON = 16, 4, 500_000
#: Parts of the hashes by which sets are counted, and rows up to which a table is broadcast rather than shuffled.
PARTS, BROADCAST = 256, 500_000
#: Odd multipliers of a shingle's words.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; a text of fewer words is one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64, len(found))
    total = sum(words[i : len(words) - WORDS + 1 + i] * FACTORS[i] for i in range(WORDS))
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(total ^ (total >> np.uint64(32)))


def set_fingerprint(s: np.ndarray) -> int:
    """The SimHash of a shingle set: a bit is set if more than half of the hashes have it set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 4096):
        block = s[at : at + 4096].astype("<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(s), bitorder="little").tobytes(), "little")


def prefix_size(n: int) -> int:
    """How many shingles of a set of n must be looked at: n less 0.8 n rounded up, and one."""
    return n - (4 * n + 4) // 5 + 1


def _lists(sets: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """The id and ``s`` (the whole shingle set) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(x.as_py()) for x in batch.column(1)])], names=[id_col, "s"])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("s", T.ArrayType(T.LongType()))]))


def _common(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Shingles that stand often in a sample, sorted; at most MOST_COMMON."""
    some = shingle_sets(docs.where(F.pmod(F.xxhash64(id_col), F.lit(SAMPLE)) == 0), id_col, text_col)
    counts = some.select(F.explode("s").alias("h")).groupBy("h").count().where(F.col("count") >= COMMON)
    found = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).select("h").collect()
    return np.sort(np.array([x.h for x in found], np.int64).view(np.uint64))


def _prefixes(docs: DataFrame, common: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Of every row: ``node`` (a hash of its set), ``fp`` (its SimHash), ``n`` (the set's size), ``p`` (its counts by part
    of the hashes, a byte each, 255 for more) and ``s``, the first of the set in order."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value  # of this run; a worker may have served another table before
        for batch in batches:
            nodes, prints, sizes, counts, firsts = [], [], [], [], []
            for x in batch.column(1):
                s = shingle_set(x.as_py())
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                prints.append(set_fingerprint(s))
                sizes.append(len(s))
                counts.append(np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes())
                often = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                firsts.append(np.concatenate([s[~often], s[often]])[: prefix_size(len(s))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)), pa.array(sizes, pa.int32()), pa.array(counts, pa.binary()), _lists(firsts)], names=[id_col, "node", "fp", "n", "p", "s"])

    out = [docs.schema[id_col], T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("p", T.BinaryType()), T.StructField("s", T.ArrayType(T.LongType()))]
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(out))


def _possible(n: str, at: str, n2: str, at2: str) -> F.Column:
    """Whether sets of these sizes may be similar enough if this shingle, at these places, is the first they share.

    Sets that are similar enough pass at the first one, as no more than what stands from there on is in both.
    """
    return 9 * F.least(F.col(n) - F.col(at), F.col(n2) - F.col(at2)) >= 4 * (F.col(n) + F.col(n2))


def _similar_counts(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs (a, b) whose counts by part leave it possible that they are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int32) for i in (2, 3))
            keep = 9 * np.abs(x - y).sum(axis=1) <= batch.column(4).to_numpy()
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (named.select(F.col("node").alias(k), F.col("p").alias(f"p{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", "pa", "pb", (F.col("na") + F.col("nb")).cast("long").alias("n")).mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose whole sets have a similarity of at least 0.8. ``named``: ``node``, ``least`` id, ``n``, ``p``."""
    pairs = cut(_similar_counts(pairs, named))
    held = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    where = cut(named.join(held, "node").select(F.col("least").alias(id_col), "node"))
    found = docs.join(F.broadcast(where) if where.count() <= BROADCAST else where, id_col)
    sets = cut(shingle_sets(found.select("node", text_col), "node", text_col).dropDuplicates(["node"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                keep.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), "s"), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("s2")), "b")
    return both.select("a", "b", "s", "s2").mapInArrow(run, "a long, b long")


def _close_prints(named: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints differ in few bits: each node and its fingerprint's representative, and
    each representative and that of the smallest fingerprint linked to its own. No more pairs than nodes, however
    large a group of copies is."""
    prints = cut(named.groupBy("fp").agg(F.min("node").alias("rep")))
    same = named.join(prints, "fp").select(F.col("rep").alias("x"), F.col("node").alias("y"))
    close = links(prints).select(F.least("a", "b").alias("small"), F.greatest("a", "b").alias("fp")).groupBy("fp").agg(F.min("small").alias("small"))
    reps = prints.select(F.col("fp").alias("small"), F.col("rep").alias("x"))
    other = close.join(prints, "fp").withColumnRenamed("rep", "y").join(reps, "small").select("x", "y")
    return same.unionByName(other).where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _with_pivot(rows: DataFrame) -> DataFrame:
    """Each row and, with 2 after their names, the columns of the pivot of its shingle: the text of the highest score."""
    cols = [c for c in rows.columns if c not in ("h", "score")]
    pivots = rows.groupBy("h").agg(F.max(F.struct("score", *cols)).alias("p"))
    pivots = pivots.select("h", *(F.col(f"p.{c}").alias(f"{c}2") for c in ("score", *cols)))
    return rows.join(pivots, "h").where(F.col("node") != F.col("node2"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``component_id`` (the smallest id reachable through near copies) of every row.

    Words are runs of other than white space, in lower case for ASCII; shingles are counted once. Equal sets are one
    node. Null and empty texts are copies of one another. An id has one text; repeated rows stay; an empty table gives
    no rows; further columns are ignored.
    """
    docs = docs.select(F.col(id_col), F.col(text_col))
    prints = cut(_prefixes(docs, _common(docs, id_col, text_col), id_col, text_col))
    named = cut(prints.groupBy("node").agg(F.min(id_col).alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("p").alias("p")))
    rows = prints.select("node", "n", "s").dropDuplicates(["node"]).select("node", "n", F.posexplode("s").alias("at", "h"))
    shared = cut(rows.withColumn("c", F.count("*").over(Window.partitionBy("h"))).where(F.col("c") > 1))

    score = shared.groupBy("node").agg((F.sum("c") / F.max("n")).alias("score"))
    scored = cut(shared.drop("c").join(score, "node"))
    best = _with_pivot(scored).where(_possible("n", "at", "n2", "at2")).groupBy("node").agg(F.max(F.struct("score2", "node2")).alias("best"))
    own = best.select(F.least("node", "best.node2").alias("a"), F.greatest("node", "best.node2").alias("b"))
    met = cut(_close_prints(named).unionByName(own).distinct())
    links_found = cut(_verified(met, docs, named, id_col, text_col))

    for with_pivots in (True, False):
        groups = connected_components(links_found, "a", "b", cut).withColumnRenamed("vertex", "node")
        placed = cut(scored.join(groups, "node", "left").select("h", "node", "n", "at", "score", F.coalesce("component", "node").alias("g")))
        several = placed.groupBy("h").agg(F.min("g").alias("least"), F.max("g").alias("most")).where(F.col("least") < F.col("most")).select("h")
        left = placed.join(several, "h", "left_semi")
        if with_pivots:
            joined = _with_pivot(left)
        else:
            right = left.select("h", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "at", "g")))
            joined = left.join(right, "h").where(F.col("node") < F.col("node2"))
        pair = (F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
        rest = joined.where((F.col("g") != F.col("g2")) & _possible("n", "at", "n2", "at2")).select(*pair).distinct()
        rest = cut(rest.join(met, ["a", "b"], "left_anti"))
        links_found = cut(links_found.unionByName(_verified(rest, docs, named, id_col, text_col)))
        met = met.unionByName(rest)

    found = connected_components(links_found, "a", "b", cut).withColumnRenamed("vertex", "node")
    member = named.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("g"))
    least = member.groupBy("g").agg(F.min("least").alias("component_id"))
    return prints.select(id_col, "node").join(member.join(least, "g").select("node", "component_id"), "node").select(id_col, "component_id")
