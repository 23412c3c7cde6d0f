"""Exact top-k inner products of integer vectors, pruned by norms and partial sums.

Candidates are dealt by descending length into packed blocks. All vectors are rotated by the eigenvectors of the
Gram matrix (the right singular vectors of the table), so that the first coordinates hold most of a product. For a
query q, a block is left out if |q| times its longest vector cannot reach q's k-th score so far; a candidate is left
out if its partial sum plus the product of the residual lengths (Cauchy-Schwarz) cannot. Survivors get the exact
integer product. Blocks are searched in bands, the longest first and each band larger than those before it; a band's
results raise the scores to beat, and before a band is shuffled each block of queries keeps only the candidate blocks
that are long enough for one of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.llm.common import cut, partitions

#: Candidates and queries of one packed block.
BLOCK, QUERIES = 4096, 1024
#: Shares of the coordinates at which partial sums are compared.
STAGES = (0.125, 0.25, 0.5)
#: Rounding of the rotated products, relative to the product of lengths.
SLACK = 1e-9
#: Products below these are exact in double precision, and in longs; others are added as integers of any size.
EXACT, LONG = 2.0**52, 2.0**62
#: The largest score and its negative, to which scores beyond are set.
ENDS = (1 - 2**63, 2**63 - 1)
#: Length from which integer vectors take no part: sums of their squares may not fit a double.
LONGEST = 2.0**400
#: Blocks of the first band, how many times as many a band has as those before it, and the blocks whose lengths are
#: looked at to choose them.
FIRST, GROWTH, LOOKED_AT = 4, 3, 1000
PACKED = "block long, most double, n int, dim int, ids binary, data binary"


def integer_vectors(table: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id`` and ``v`` = floor(scale * x) of the vectors that take part; a row for each row.

    Null vectors and ids, and vectors that hold null or non-finite components, take no part; nor do those of a length of
    LONGEST or more. The integers are doubles, which hold them exactly: below 2^53 any whole number is one, and above it
    a double times the scale, a power of two, is whole.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("the scale is a power of two")
    # the function floor gives a long, which may be too small: large doubles are whole as they are
    whole = lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)
    wide = F.transform(F.col(vector_col), lambda x: whole(x.cast("double") * F.lit(float(scale))))
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(LONGEST / scale)))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = table.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), wide.alias("v"))
    return rows.withColumn("norm", square).where(F.col("norm") < F.lit(LONGEST**2))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch as rows; shorter ones end in zeros."""
    lists = batch.column(batch.schema.get_field_index("v"))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """The d x d Gram matrix; d*d numbers reach the driver, whatever the number of rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch, dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim), pa.int32()), pa.array(total.ravel())], names=["i", "g"])

    out = np.zeros(dim * dim)
    for x in vectors.select("v").mapInArrow(add, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect():
        out[x.i] = x.g
    return out.reshape(dim, dim)


def _packed(vectors: DataFrame, dim: int, rows: int) -> DataFrame:
    """Packed blocks of at most ``rows`` vectors in the order they come in; ``block`` is unique."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = _matrix(part, dim)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                most = float(np.sqrt((x**2).sum(axis=1).max()))
                yield pa.RecordBatch.from_pylist([{"most": most, "n": len(ids), "dim": dim, "ids": ids.tobytes(), "data": x.tobytes()}], schema=pa.schema([("most", pa.float64()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]))

    packed = vectors.select("id", "v").mapInArrow(pack, "most double, n int, dim int, ids binary, data binary")
    held = cut(packed.withColumn("at", F.monotonically_increasing_id()))
    order = held.select("at").withColumn("block", F.row_number().over(Window.orderBy("at")).cast("long") - 1)  # a row for each block
    return cut(held.join(order, "at").select("block", "most", "n", "dim", "ids", "data"))


def _unpack(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], float).reshape(row["n"], row["dim"])


def exact_product(x: np.ndarray, y: np.ndarray) -> int:
    """The inner product of whole numbers of any size, set to the ends of a long if it is beyond."""
    total = sum(int(a) * int(b) for a, b in zip(x, y, strict=True) if a and b)
    return min(max(total, ENDS[0]), ENDS[1])


def search_block(qids: np.ndarray, q: np.ndarray, beat: np.ndarray, cids: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of all candidates that may be among a query's k best, given the scores to beat."""
    order = np.lexsort((cids, -(c**2).sum(axis=1)))
    cids, c = cids[order], c[order]
    qr, cr = q @ rotation, c @ rotation
    qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    dim = c.shape[1]
    stages = sorted({min(dim, max(1, round(dim * s))) for s in STAGES})
    rest_q = {m: np.linalg.norm(qr[:, m:], axis=1) for m in stages}
    rest_c = {m: np.linalg.norm(cr[:, m:], axis=1) for m in stages}
    slack = SLACK * qn[:, None] * (cn.max() if len(cn) else 0) + 1e-6
    beat = beat.copy()  # at the ends of a long a double is no more than the long itself, so ties stay in
    found: list[tuple[int, int, int]] = []
    for at in range(0, len(cids), 512):
        part = slice(at, at + 512)
        alive = np.nonzero(qn * cn[at] + slack[:, 0] >= beat)[0]
        if not len(alive):
            break  # all that follow are no longer
        keep, done, partial = np.ones((len(alive), len(cids[part])), bool), 0, np.zeros((len(alive), len(cids[part])))
        for m in stages:
            partial += qr[alive, done:m] @ cr[part, done:m].T
            keep &= partial + rest_q[m][alive, None] * rest_c[m][None, part] + slack[alive] >= beat[alive, None]
            done = m
            if not keep.any():
                break
        i, j = np.nonzero(keep)
        if not len(i):
            continue
        longest = qn.max() * cn[at]
        if longest < EXACT:
            score = ((q[alive] @ c[part].T)[i, j] if len(i) * 8 > keep.size else np.einsum("ij,ij->i", q[alive[i]], c[part][j])).astype(np.int64)
        elif longest < LONG:
            score = np.einsum("ij,ij->i", q[alive[i]].astype(np.int64), c[part][j].astype(np.int64))
        else:
            score = np.array([exact_product(x, y) for x, y in zip(q[alive[i]], c[part][j], strict=True)], np.int64)
        sound = (score >= beat[alive[i]]) & (qids[alive[i]] != cids[part][j])
        i, j, score = i[sound], j[sound], score[sound]
        best = np.lexsort((cids[part][j], -score, i))
        i, j, score = i[best], j[best], score[best]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        for a, b, s in zip(alive[i[rank < k]], j[rank < k], score[rank < k], strict=True):
            found.append((int(a), int(cids[part][b]), int(s)))
        for a in np.unique(alive[i[(rank == k - 1)]]):
            beat[a] = max(beat[a], score[(alive[i] == a) & (rank == k - 1)][0])
    found.sort(key=lambda x: (x[0], -x[2], x[1]))
    out, last, rank = [], -1, 0
    for a, b, s in found:
        rank = rank + 1 if a == last else 0
        last = a
        if rank < k:
            out.append((int(qids[a]), b, s))
    return out


def _long_enough(queries: DataFrame, candidates: DataFrame, first: int, last: int) -> DataFrame:
    """``c`` and ``q``: the pairs of a candidate block from ``first`` to ``last`` and a query block that may matter.

    Blocks stand in order of falling length, so a query block needs those before the first that is too short for all
    its queries. The lengths of LOOKED_AT evenly spaced blocks tell where that is; only they reach the driver.
    """
    step = max(1, (last - first + 1) // LOOKED_AT)
    marks = candidates.where(F.col("block").between(first, last) & ((F.col("block") - first) % step == 0)).select("block", "most").orderBy("block").collect()
    at, most = [int(x.block) for x in marks], [float(x.most) for x in marks]
    schema = "q long, upto long"

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for need in batch.column(1).to_pylist():
                short = int(np.searchsorted(-np.array(most), -need, side="right"))  # the first mark below what is needed
                ends.append(at[short] if short < len(at) else last + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.int64())], names=["q", "upto"])

    return queries.select("block", "need").mapInArrow(reach, schema).where(F.col("upto") > first).select("q", F.explode(F.sequence(F.lit(first).cast("long"), F.col("upto") - 1)).alias("c"))


def _search(candidates: DataFrame, queries: DataFrame, first: int, last: int, rotation, k: int) -> DataFrame:
    """Every needed pair of a candidate block and a query block in a task of its own. ``queries`` hold their lows."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            cids, c = _unpack(left.iloc[0])
            qids, q = _unpack(right.iloc[0])
            lows = np.full(len(qids), -np.inf) if right.iloc[0]["lows"] is None else np.frombuffer(right.iloc[0]["lows"], float)
            rows = search_block(qids, q, lows, cids, c, rotation.value, k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    pairs = cut(_long_enough(queries, candidates, first, last))
    left = candidates.withColumnRenamed("block", "c").join(pairs, "c")
    right = queries.withColumnRenamed("block", "q").join(pairs, "q")
    return left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(run, "query_id long, vec_id long, score long")


def top_k(table: DataFrame, is_query: F.Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products with all other rows; ties go to the smaller id.

    ``is_query`` is a condition on the column ``id``. Vectors become floor(scale * x); see :func:`integer_vectors` for
    the rows that take no part. Shorter vectors end in zeros. Every row is a candidate, also where rows share an id,
    but rows of the query's own id are not; if several rows of an id ask, their pairs are ranked together. Scores beyond
    a long are set to its ends before they are ranked. Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; fewer rows if there are fewer candidates, none for an
    empty table. Blocks of queries meet blocks of rows; a pair of blocks is one group, so no task and not the driver
    holds more than two blocks.
    """
    spark = table.sparkSession
    vectors = cut(integer_vectors(table, scale, id_col, vector_col).withColumn("q", F.coalesce(is_query, F.lit(False))))
    dim = vectors.agg(F.max(F.size("v"))).collect()[0][0]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not dim or dim < 1:
        return empty
    _, basis = np.linalg.eigh(_gram(vectors, dim))
    rotation = spark.sparkContext.broadcast(np.ascontiguousarray(basis[:, ::-1]))
    queries = _packed(vectors.where("q"), dim, QUERIES)
    ordered = vectors.repartitionByRange(partitions(spark), F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    candidates = _packed(ordered, dim, BLOCK)
    if not queries.take(1):
        return empty
    blocks = candidates.count()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found, first, width = None, 0, FIRST
    while first < blocks:
        last = min(blocks, first + width) - 1
        asked = queries.withColumn("lows", F.lit(None).cast("binary")).withColumn("need", F.lit(float("-inf"))) if found is None else queries.join(_lows(queries, found.where(F.col("rank") == k)), "block", "left")
        new = _search(candidates, asked, first, last, rotation, k)
        every = new if found is None else found.drop("rank").unionByName(new)
        found = cut(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        first, width = last + 1, GROWTH * (last + 1)
    return found.select("query_id", "rank", "vec_id", "score")


def _lows(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """The score to beat of each query, packed in the order of its block, and ``need``: the length below which no
    candidate can reach the score to beat of any of them."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, data, n, dim in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                size = np.linalg.norm(np.frombuffer(data, float).reshape(n, dim), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.frombuffer(ids, np.int64)), pa.array(size), pa.array(np.arange(n), pa.int32())], names=["block", "query_id", "size", "at"])

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        low = group["score"].astype(float).fillna(-np.inf).to_numpy()
        size = group["size"].to_numpy()
        need = np.where(low > 0, low * (1 - 1e-9) / np.where(size > 0, size, 1), -np.inf)  # rounding must not lose a tie
        return pd.DataFrame({"block": [key[0]], "lows": [low.tobytes()], "need": [float(need.min())]})

    named = queries.select("block", "ids", "data", "n", "dim").mapInArrow(unpack, "block long, query_id long, size double, at int")
    return named.join(ranked.select("query_id", "score"), "query_id", "left").groupBy("block").applyInPandas(pack, "block long, lows binary, need double")
