"""A prefix trie of conversations from composable fingerprints.

A sequence of turns has a fingerprint that is a polynomial of its turns' digests modulo a prime. Fingerprints with the
length of what they stand for form a monoid: those of two sequences give that of their concatenation, and those of a
whole and of its head give that of the rest. So a rebuilt conversation's prefixes (the head of a base conversation, then
the rest of its own turns) are computed from the running products of the stored conversations; no rebuilt text is made.

Running products are made range by range over the sorted turns and carried into the next ranges, so a long
conversation is spread over tasks. A prefix is a node; the turns that its members end with are referenced where they are
stored, and nodes whose references differ are verified to have equal texts there. Sums over subtrees are found by
doubling: with the sums of the 2^k levels below every node, and each node's ancestor 2^k levels above, one join gives
those of 2^(k+1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.llm.common import bounded_batches, cut, partitions, stored

#: The modulus of fingerprints, their base, and the base's inverse.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"turns").digest()) % PRIME
INVERSE = pow(BASE, -1, PRIME)
#: Conversations that share a base, and the lengths of the heads that they may take from it: below HEADS.
SHARED, HEADS = 20, 4
LOW = (1 << 64) - 1
ENDLESS = hashlib.sha256(b"").hexdigest()


class Print(NamedTuple):
    """The fingerprint ``h`` of ``n`` turns."""

    h: int
    n: int

    def __mul__(self, other: Print) -> Print:  # noqa: D105
        return Print((self.h * pow(BASE, other.n, PRIME) + other.h) % PRIME, self.n + other.n)

    def after(self, head: Print) -> Print:
        """What follows ``head`` in this sequence."""
        return Print((self.h - head.h * pow(BASE, self.n - head.n, PRIME)) % PRIME, self.n - head.n)


def turn_value(role: str, text: str) -> int:
    r, t = (x.encode("utf-8", "surrogatepass") for x in (role, text))
    return int.from_bytes(hashlib.blake2b(len(r).to_bytes(8) + r + t, digest_size=16).digest()) % PRIME


def _two(values: list[int]) -> list[pa.Array]:
    """Numbers below 2^127 as two columns of longs."""
    return [pa.array(np.array([v >> 64 for v in values], np.int64)), pa.array(np.array([v & LOW for v in values], np.uint64).view(np.int64))]


def _one(high: pa.Array, low: pa.Array) -> list[int]:
    return [(x << 64) | (y & LOW) for x, y in zip(high.to_pylist(), low.to_pylist(), strict=True)]


def stored_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """All turns in order, in shared storage: ``at`` (a turn's reference), conv_id, part, k (from 1) and the running
    product (hx, hy) within the conversation and the part, the turn's digest (tx, ty), its words, role and text."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().alias("part"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, index = None, Print(0, 0), 0
        for batch in batches:
            products, values, places, words = [], [], [], []
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if c != conv:
                    conv, now = c, Print(0, 0)
                values.append(turn_value(role, text))
                now = Print((now.h * BASE + values[-1]) % PRIME, now.n + 1)
                products.append(now.h)
                places.append(now.n)
                words.append(len(text.encode("utf-8", "surrogatepass").split()))
            first = (batch.column(1)[0].as_py() << 40) + index if len(places) else 0
            index += len(places)
            at = pa.array(np.arange(first, first + len(places), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([at, batch.column(0), batch.column(1), pa.array(places, pa.int64()), *_two(products), *_two(values), pa.array(words, pa.int64()), batch.column(2), batch.column(3)], names=["at", "conv_id", "part", "k", "hx", "hy", "tx", "ty", "words", "role", "text"])

    return stored(ranged.mapInArrow(run, "at long, conv_id long, part int, k long, hx long, hy long, tx long, ty long, words long, role string, text string"))


def carries(turns: DataFrame) -> dict[tuple[int, int], Print]:
    """For each conversation that goes on from one part into another, what comes before it there: no more entries than
    parts."""
    ranges = sorted((r["part"], r["low"], r["high"]) for r in turns.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high")).collect())  # a row for each part
    over = sorted({low for (_, _, high), (_, low, _) in zip(ranges, ranges[1:], strict=False) if low == high})
    if not over:
        return {}
    # fewer conversations than parts go on into another one, and each has a row for each of its parts
    some = turns.join(F.broadcast(turns.sparkSession.createDataFrame([(c,) for c in over], "conv_id long")), "conv_id")
    last = some.groupBy("conv_id", "part").agg(F.max(F.struct("k", "hx", "hy")).alias("m")).select("conv_id", "part", "m.k", "m.hx", "m.hy")
    out: dict[tuple[int, int], Print] = {}
    conv, before = None, Print(0, 0)
    for r in sorted(last.collect()):
        if r["conv_id"] != conv:
            conv, before = r["conv_id"], Print(0, 0)
        out[conv, r["part"]] = before
        before = before * Print((r["hx"] << 64) | (r["hy"] & LOW), r["k"])
    return {key: p for key, p in out.items() if p.n}


def running_products(turns: DataFrame) -> DataFrame:
    """The stored turns without texts; places and products count from the start of a conversation."""
    shared = turns.sparkSession.sparkContext.broadcast(carries(turns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = shared.value
        for batch in batches:
            places, products = batch.column(3).to_pylist(), _one(batch.column(4), batch.column(5))
            for i, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if key in before:
                    whole = before[key] * Print(products[i], places[i])
                    products[i], places[i] = whole
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.int64()), *_two(products), *(batch.column(i) for i in (6, 7, 8))], names=["at", "conv_id", "k", "hx", "hy", "tx", "ty", "words"])

    return turns.select("at", "conv_id", "part", "k", "hx", "hy", "tx", "ty", "words").mapInArrow(run, "at long, conv_id long, k long, hx long, hy long, tx long, ty long, words long")


def _facts(products: DataFrame) -> DataFrame:
    """One row a conversation: its length ``n``, and of its first HEADS - 1 turns product, words and reference."""
    first = [F.max(F.when(F.col("k") == i, F.col(c))).alias(f"{c}{i}") for i in range(1, HEADS) for c in ("hx", "hy", "words", "at")]
    return products.groupBy("conv_id").agg(F.max("k").alias("n"), *first)


def members(products: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: conv_id, depth, the fingerprints of it and of the prefix before it,
    words and reference of its last turn, and whether the conversation ends there. The root has null for both."""
    facts = cut(_facts(products))
    base = F.col("conv_id") - F.col("conv_id") % SHARED
    wanted = F.when(F.col("conv_id") == base, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    bases = facts.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("bn"), *(F.col(f"{c}{i}").alias(f"b{c}{i}") for i in range(1, HEADS) for c in ("hx", "hy", "words", "at")))
    both = facts.withColumn("base", base).withColumn("h", wanted.cast("long")).join(bases, "base", "left")
    both = both.withColumn("head", F.least("h", F.coalesce("bn", F.lit(0).cast("long")))).withColumn("length", F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h")))

    def product(of: str, at: F.Column) -> F.Column:
        return F.coalesce(*(F.when(at == i, F.col(f"{of}{i}")) for i in range(1, HEADS)), F.lit(0).cast("long"))

    both = cut(both.select("conv_id", "h", "head", "length", *(F.col(f"b{c}{i}") for i in range(1, HEADS) for c in ("hx", "hy", "words", "at")), *(product(c, F.col("h")).alias(f"o{c}") for c in ("hx", "hy")), *(product(f"b{c}", F.col("head")).alias(f"p{c}") for c in ("hx", "hy"))))
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = both.select("conv_id", zero.alias("depth"), zero.alias("x"), zero.alias("y"), none.alias("px"), none.alias("py"), zero.alias("words"), none.alias("at"), (F.col("length") == 0).alias("ends"))
    depth = F.col("depth")
    heads = both.where("head > 0").withColumn("depth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("head"))))
    heads = heads.select("conv_id", "depth", product("bhx", depth).alias("x"), product("bhy", depth).alias("y"), product("bhx", depth - 1).alias("px"), product("bhy", depth - 1).alias("py"), product("bwords", depth).alias("words"), product("bat", depth).alias("at"), (F.col("length") == depth).alias("ends"))
    own = products.join(both.select("conv_id", "h", "head", "length", "ohx", "ohy", "phx", "phy"), "conv_id").where("k > h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, h, head, length = (b.column(i).to_pylist() for i in (1, 2, 3, 4))
            product, value, skipped, taken = (_one(b.column(i), b.column(i + 1)) for i in (5, 7, 9, 11))
            prints = [Print(t, m) * Print(w, k).after(Print(s, n)) for t, m, w, k, s, n in zip(taken, head, product, place, skipped, h, strict=True)]
            before = [(p.h - v) * INVERSE % PRIME for p, v in zip(prints, value, strict=True)]
            depths = [p.n for p in prints]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(depths, pa.int64()), *_two([p.h for p in prints]), *_two(before), b.column(13), b.column(14), pa.array([d == e for d, e in zip(depths, length, strict=True)], pa.bool_())], names=["conv_id", "depth", "x", "y", "px", "py", "words", "at", "ends"])

    rest = own.select("conv_id", "k", "h", "head", "length", "hx", "hy", "tx", "ty", "ohx", "ohy", "phx", "phy", "words", "at").mapInArrow(run, "conv_id long, depth long, x long, y long, px long, py long, words long, at long, ends boolean")
    return root.unionByName(heads).unionByName(rest)


KEY = ["depth", "x", "y"]


def verify(every: DataFrame, turns: DataFrame) -> None:
    """Raise if two members of a node do not end with the same role and text; node by node from the root on, equal last
    turns and equal nodes before make equal sequences. Each stored turn that a node refers to is looked at once."""
    refs = every.where("depth > 0").groupBy(*KEY, "at").agg(F.min("px").alias("px"), F.max("px").alias("px2"), F.min("py").alias("py"), F.max("py").alias("py2"))
    refs = cut(refs)
    several = refs.groupBy(*KEY).agg(F.count("*").alias("n"), (F.min("px") == F.max("px2")).alias("a"), (F.min("py") == F.max("py2")).alias("b"))
    apart = several.where(~F.col("a") | ~F.col("b"))
    texts = refs.join(several.where("n > 1").select(*KEY), KEY, "left_semi").join(turns.select("at", F.struct("role", "text").alias("turn")), "at")
    differ = texts.groupBy(*KEY).agg(F.min("turn").alias("low"), F.max("turn").alias("high")).where(F.col("low") != F.col("high"))
    if differ.select("depth").unionByName(apart.select("depth")).take(1):
        raise RuntimeError("two sequences have one fingerprint; choose another base")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens of the root and of every node of two or more members, by doubling."""
    some = nodes.where("n_convs > 1 OR depth = 0")
    up = F.when(F.col("depth") > 0, F.col("depth") - 1)
    state = cut(some.select(*KEY, F.when(F.col("n_children") == 0, 1).otherwise(F.col("singles")).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), up.alias("ad"), F.col("px").alias("ax"), F.col("py").alias("ay")))
    while True:
        climbing = state.where(F.col("ad").isNotNull())
        if not climbing.take(1):
            return state.select(*KEY, "n_leaves", "saved_tokens")
        sums = climbing.groupBy(F.col("ad").alias("depth"), F.col("ax").alias("x"), F.col("ay").alias("y")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        onward = state.select(F.col("depth").alias("ad"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("ad").alias("bd"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
        moved = climbing.join(onward, ["ad", "ax", "ay"]).select(*KEY, "n_leaves", "saved_tokens", F.col("bd").alias("ad"), F.col("bx").alias("ax"), F.col("by").alias("ay"))
        still = state.where(F.col("ad").isNull()).unionByName(moved)
        state = cut(still.join(sums, KEY, "left").select(*KEY, (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens"), "ad", "ax", "ay"))


def ends_digests(every: DataFrame) -> DataFrame:
    """The digest of the ids that end at each node, in order. A digest of a list is made from its start to its end, so a
    node's ids pass through one task; they are sorted on disk and read one by one."""
    ranged = every.where("ends").select(*KEY, "conv_id").repartition(partitions(every.sparkSession), *KEY).sortWithinPartitions(*KEY, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in key), pa.array([digest.hexdigest()])], names=[*KEY, "ends_sha256"])

        for batch in batches:
            for *node, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if node != key:
                    if key is not None:
                        yield done()
                    key, digest = node, hashlib.sha256(b"%d" % c)
                else:
                    digest.update(b",%d" % c)
        if key is not None:
            yield done()

    return ranged.mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations.

    A conversation takes its first turns (by the checksum of its id, below HEADS) from the one whose id is the multiple
    of SHARED below it, if that exists, and goes on with its own. Turns of one place go by role, then text; repeated rows
    are repeated turns. Null roles and texts are empty, a null turn comes first, rows with a null id take no part. Texts
    and conversations of any length count whole; a conversation may have no turn left. An empty table gives no rows;
    other columns are ignored.
    """
    turns = stored_turns(conversations, conv_col, turn_col, role_col, text_col)
    every = stored(members(running_products(turns)))
    verify(every, turns)
    nodes = cut(every.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("px").alias("px"), F.max("py").alias("py")))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("singles"))
    counted = cut(nodes.join(kids, KEY, "left").na.fill(0, ["n_children", "singles"]))
    top = counted.where("depth = 0").first()
    # the root has a child for each first turn there is; its id is one number
    above = counted.where("depth > 0 AND n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("above"))
    linked = counted.where("depth > 1").join(above, ["depth", "px", "py"]).withColumnRenamed("above", "parent_conv_id")
    first = counted.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top["conv_id"] if top else None).cast("long")))
    placed = linked.unionByName(first, allowMissingColumns=False).join(subtree_sums(counted), KEY, "left").join(ends_digests(every), KEY, "left")
    return placed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(ENDLESS)).alias("ends_sha256"))
