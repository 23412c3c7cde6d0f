"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. Nodes are dealt along a few random directions into small blocks, whose exact neighbours
are a poor first graph. NN-descent then improves it: in each round a node's new neighbours (forward and backward) are
joined with all its neighbours, as a neighbour of a neighbour is likely to be one, and closer ones replace those held.
Pairs that were compared before are not compared again: only entries that came since then are new. Rounds go on until
few entries change. A query starts at its own node and walks the graph greedily, opening the closest nodes that it
has not opened, until none is left in its beam. What it finds is ranked by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.llm.common import cut, partitions

#: Neighbours of a node in the graph, directions of the first graph and rows of its blocks.
DEGREE, DIRECTIONS, BLOCK = 32, 3, 512
#: New entries of a node that one round joins (a random sample, as the method has it); the others wait for later rounds.
SAMPLE = 16
#: Share of changed entries at which rounds stop, and their number in any case.
TOLERANCE, ROUNDS = 0.04, 30
#: Nodes that a query holds.
BEAM = 96
SEED = 11
#: States of an entry: compared before, new but waiting, new and joined in the coming round.
OLD, LATER, NOW = 0, 1, 2
EDGES = "u long, v long, s float, state int"


def sound_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (doubles) without null, zero or non-finite vectors."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))


def _unit(lists: pa.ListArray, dim: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _packed(unit: np.ndarray) -> list[bytes]:
    """Vectors as signed bytes, scaled to their largest component: enough to find neighbours, not to score them."""
    scaled = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)
    return [row.tobytes() for row in scaled]


def _unpacked(raw: pa.Array, dim: int) -> np.ndarray:
    out = np.frombuffer(b"".join(raw.to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _nodes(vectors: DataFrame, dim: int, k: int) -> DataFrame:
    """One row for each different vector: ``node``, ``v``, ``x`` (the vector in signed bytes), and its k + 1 smallest
    ids, each with its number of rows. The limit is applied before the shuffle as well, so a vector that very many
    rows share sends a few rows from each task."""
    counted = vectors.groupBy("v", "id").agg(F.count("*").alias("n"))
    few = counted.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    merged = few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("ids"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_packed(_unit(batch.column(0), dim)), pa.binary())], names=["v", "ids", "x"])

    packed = merged.mapInArrow(pack, "v array<double>, ids array<struct<id: long, n: long>>, x binary")
    return cut(packed.withColumn("node", F.monotonically_increasing_id()))


def _by_key(chunk: Callable[[pa.Table], pa.RecordBatch], shrink: Callable[[pa.Table], pa.RecordBatch] | None = None):
    """A function for mapInArrow on rows sorted by their first column: ``chunk`` sees all rows of a key at once.

    ``shrink``: what may stand for the rows of a key that have come so far, if the key is not finished.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() == keys[-1]:
                held.append(batch)
                if shrink and len(held) > 16:
                    held = [shrink(pa.Table.from_batches(held))]
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            yield chunk(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield chunk(pa.Table.from_batches(held))

    return run


def _distinct_best(u: np.ndarray, v: np.ndarray, s: np.ndarray, state: np.ndarray, degree: int) -> tuple[np.ndarray, ...]:
    """The ``degree`` closest entries of each u, ties to the smaller v; of equal ones the older."""
    order = np.lexsort((state, v, u))
    u, v, s, state = u[order], v[order], s[order], state[order]
    once = np.ones(len(u), bool)
    once[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, s, state = u[once], v[once], s[once], state[once]
    order = np.lexsort((v, -s, u))
    u, v, s, state = u[order], v[order], s[order], state[order]
    keep = np.arange(len(u)) - np.searchsorted(u, u) < degree
    return u[keep], v[keep], s[keep], state[keep]


def _draws(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    x = (u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (v.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _columns(table: pa.Table) -> list[np.ndarray]:
    return [table.column(i).to_numpy() for i in range(4)]


def _merged(edges: DataFrame, degree: int) -> DataFrame:
    """The closest entries of each node, and which of the new ones are joined next."""

    def shrink(table: pa.Table) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(map(pa.array, _distinct_best(*_columns(table), degree))), names=["u", "v", "s", "state"])

    def chunk(table: pa.Table) -> pa.RecordBatch:
        u, v, s, state = _distinct_best(*_columns(table), degree)
        fresh = np.nonzero(state != OLD)[0]
        order = fresh[np.lexsort((_draws(u[fresh], v[fresh]), u[fresh]))]
        turn = np.arange(len(order)) - np.searchsorted(u[order], u[order])
        state = state.copy()
        state[order] = np.where(turn < SAMPLE, NOW, LATER)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, s, state)], names=["u", "v", "s", "state"])

    return edges.repartition(partitions(edges.sparkSession), "u").sortWithinPartitions("u").mapInArrow(_by_key(chunk, shrink), EDGES)


def _top(u: np.ndarray, v: np.ndarray, s: np.ndarray, degree: int) -> pa.RecordBatch:
    u, v, s, state = _distinct_best(u, v, s.astype(np.float32), np.full(len(u), LATER, np.int32), degree)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, s, state)], names=["u", "v", "s", "state"])


def _first(nodes: DataFrame, dim: int, degree: int) -> DataFrame:
    """Exact neighbours in blocks along random directions."""
    rng = np.random.default_rng(SEED)
    parts, pieces = [], partitions(nodes.sparkSession)
    for _ in range(DIRECTIONS):
        planes = rng.normal(size=(dim, 7)).astype(np.float32)

        def place(batches: Iterator[pa.RecordBatch], planes=planes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    p = _unpacked(batch.column(1), dim) @ planes
                    sign = (p[:, :6] > 0) @ (1 << np.arange(6))
                    sign ^= sign >> 1  # neighbours in order differ in few signs
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sign + 0.5 + np.tanh(p[:, 6]) / 2.001)], names=["node", "x", "at"])

        def block(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            n = min(degree, len(ids) - 1)
            for at in range(0, len(ids) if n > 0 else 0, 512):
                rows = np.arange(at, min(at + 512, len(ids)))
                s = x[rows] @ x.T
                s[np.arange(len(rows)), rows] = -2
                j = np.argpartition(-s, n - 1, axis=1)[:, :n]
                yield _top(np.repeat(ids[rows], n), ids[j.ravel()], np.round(np.take_along_axis(s, j, axis=1).ravel(), 6), degree)

        def compare(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, x = np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
            for batch in batches:
                if batch.num_rows:
                    ids, x = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([x, _unpacked(batch.column(1), dim)])
                while len(ids) >= 2 * BLOCK:
                    yield from block(ids[:BLOCK], x[:BLOCK])
                    ids, x = ids[BLOCK:], x[BLOCK:]
            for part in np.array_split(np.arange(len(ids)), max(1, round(len(ids) / BLOCK))):
                yield from block(ids[part], x[part])

        spread = nodes.select("node", "x").mapInArrow(place, "node long, x binary, at double")
        spread = spread.repartitionByRange(pieces, "at", "node").sortWithinPartitions("at", "node")
        parts.append(spread.select("node", "x").mapInArrow(compare, EDGES))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _join(edges: DataFrame, nodes: DataFrame, dim: int, degree: int) -> DataFrame:
    """Closer pairs among the neighbours of each node: its new ones with all, forward and backward.

    Forward entries come first; of the backward ones a sample is taken, before the shuffle as well, so a node that
    very many others hold sends a few rows from each task. Nodes without anything new send no vectors.
    """
    def limited(rows: DataFrame, most: int) -> DataFrame:
        order = Window.partitionBy("c").orderBy("back", F.xxhash64("c", "m"), "m")
        return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("c", "m", "new")

    def around(state: int) -> DataFrame:
        some = edges.where(F.col("state") == state).withColumn("new", F.lit(state == NOW))
        return some.select(F.col("u").alias("c"), F.col("v").alias("m"), "new", F.lit(False).alias("back")).unionByName(some.select(F.col("v").alias("c"), F.col("u").alias("m"), "new", F.lit(True).alias("back")))

    fresh = cut(limited(around(NOW), 2 * SAMPLE))
    settled = limited(around(OLD).join(fresh.select("c").distinct(), "c", "left_semi"), degree + SAMPLE)
    low = edges.groupBy("u").agg(F.when(F.count("*") < degree, F.lit(-2.0).cast("float")).otherwise(F.min("s")).alias("low"))
    held = nodes.select(F.col("node").alias("m"), "x").join(low.withColumnRenamed("u", "m"), "m", "left").select("m", "x", F.coalesce("low", F.lit(-2.0).cast("float")).alias("low"))
    dealt = fresh.unionByName(settled).join(held, "m").select("c", "m", "new", "low", "x")

    def compare(table: pa.Table) -> pa.RecordBatch:
        c, m, new, low = (table.column(i).to_numpy() for i in range(4))
        x = _unpacked(table.column(4).combine_chunks(), dim) if len(c) else np.zeros((0, dim), np.float32)
        starts = np.nonzero(np.concatenate([[True], c[1:] != c[:-1]]))[0] if len(c) else np.zeros(0, int)
        us, vs, ss = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for a, b in zip(starts, np.append(starts[1:], len(c)), strict=True):
            mine, fresh = m[a:b], np.nonzero(new[a:b])[0]
            s = np.round(x[a:b][fresh] @ x[a:b].T, 6)
            s[mine[fresh][:, None] == mine[None, :]] = -3
            for near, left, right in ((s > low[a:b][fresh][:, None], fresh, None), (s > low[a:b][None, :], None, fresh)):
                i, j = np.nonzero(near)
                us.append(mine[left[i]] if right is None else mine[j])
                vs.append(mine[j] if right is None else mine[right[i]])
                ss.append(s[i, j])
        return _top(np.concatenate(us), np.concatenate(vs), np.concatenate(ss), degree)

    return dealt.repartition(partitions(edges.sparkSession), "c").sortWithinPartitions("c").mapInArrow(_by_key(compare), EDGES)


def build_graph(nodes: DataFrame, dim: int, degree: int = DEGREE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Entries (u, v, s) of each node's ``degree`` closest nodes; one checkpoint a round.

    Rounds stop once the share of entries that have not been joined is below ``tolerance``.
    """
    edges = cut(_merged(_first(nodes, dim, degree), degree))
    for _ in range(rounds):
        total, fresh = edges.agg(F.count("*"), F.count(F.when(F.col("state") != OLD, 1))).collect()[0]
        if fresh <= tolerance * total:
            break
        found = _join(edges, nodes, dim, degree)
        before = edges.withColumn("state", F.when(F.col("state") == LATER, LATER).otherwise(OLD))
        edges = cut(_merged(before.unionByName(found), degree))
    return edges


def _scored(pairs: DataFrame, dim: int) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", _unpacked(batch.column(2), dim), _unpacked(batch.column(3), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(s, 6).astype(np.float32))], names=["q", "v", "s"])

    return pairs.mapInArrow(score, "q long, v long, s float")


def _walk(queries: DataFrame, edges: DataFrame, nodes: DataFrame, dim: int, degree: int, beam: int) -> DataFrame:
    """The nodes that each query holds at the end of its walk: ``q`` (its node) and ``v``.

    The graph of the walk has each node's entries and the closest of those that hold it, so its degree is bounded.
    """
    back = edges.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u"))).where(F.col("r") <= 2 * degree)
    both = edges.select("u", "v").unionByName(back.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = cut(both.groupBy("u").agg(F.collect_set("v").alias("near")))
    held = queries.select(F.col("node").alias("q"), F.col("node").alias("v"), F.lit(2.0).cast("float").alias("s"), F.lit(False).alias("open"))
    best = Window.partitionBy("q").orderBy(F.desc("s"), "v")
    ours, theirs = queries.select(F.col("node").alias("q"), F.col("x").alias("qx")), nodes.select(F.col("node").alias("v"), "x")
    while held.where(~F.col("open")).take(1):  # ends: an opened node that a beam has dropped is too far to come back
        turn = held.where(~F.col("open")).select("q", F.col("v").alias("u"))
        new = turn.join(around, "u").select("q", F.explode("near").alias("v")).distinct().join(held.select("q", "v"), ["q", "v"], "left_anti")
        found = _scored(new.join(theirs, "v").join(ours, "q").select("q", "v", "qx", "x"), dim).withColumn("open", F.lit(False))
        held = held.select("q", "v", "s", F.lit(True).alias("open")).unionByName(found)
        held = cut(held.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r"))
    return held.select("q", "v")


def nearest(table: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", degree: int = DEGREE, rounds: int = ROUNDS, beam: int = BEAM) -> DataFrame:
    """Each query's k nearest rows by cosine, as far as the walk finds them; ties go to the smaller id.

    ``is_query`` is a condition on the column ``id``. Null ids, null and zero vectors, and vectors that hold null or
    non-finite components, take no part; shorter vectors end in zeros; an empty table gives no rows. Every row is a
    candidate, also where rows share an id or a vector, but rows of the query's own id are not; if several rows of an
    id ask, their pairs are ranked together. Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the cosine
    of the original vectors in double precision. Every row is in the graph; nothing but counts reaches the driver.
    """
    spark = table.sparkSession
    vectors = cut(sound_vectors(table, id_col, vector_col))
    dim = vectors.agg(F.max(F.size("v"))).collect()[0][0]
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nodes = _nodes(vectors, dim, k)
    edges = build_graph(nodes, dim, degree, rounds)
    asked = vectors.where(F.coalesce(is_query, F.lit(False))).groupBy("id", "v").agg(F.count("*").alias("times"))
    whose = cut(asked.join(nodes.select("v", "node"), "v").select(F.col("id").alias("query_id"), "times", "v", "node"))
    starts = nodes.join(whose.select("node").distinct(), "node", "left_semi").select("node", "x")
    walked = _walk(starts, edges, nodes, dim, degree, beam)
    pairs = whose.select("query_id", "times", F.col("v").alias("qv"), "node").join(walked.select(F.col("q").alias("node"), F.col("v").alias("at")), "node")
    close = pairs.join(nodes.select(F.col("node").alias("at"), F.col("v").alias("cv"), "ids"), "at").select("query_id", "times", "ids", "qv", "cv")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.clip(np.einsum("ij,ij->i", _unit(batch.column(3), dim), _unit(batch.column(4), dim)), -1, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s)], names=["query_id", "times", "ids", "score"])

    scored = close.mapInArrow(cosine, "query_id long, times long, ids array<struct<id: long, n: long>>, score double")
    rows = scored.select("query_id", "times", "score", F.explode("ids").alias("c")).where(F.col("c.id") != F.col("query_id"))
    rows = rows.withColumn("copies", F.least(F.col("c.n") * F.col("times"), F.lit(k))).select("query_id", "score", F.col("c.id").alias("vec_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
