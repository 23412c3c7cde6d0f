"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

Every window of WIDTH bytes belongs to the smallest hash among its anchors (substrings of GRAM bytes), which depends
on the window's bytes alone, so equal windows meet under one anchor. Runs of windows with one anchor are rows. Runs
whose windows are all the same as another run's are repeated as a whole. The other runs under a shared anchor are
suffix-sorted: shards of runs get their own suffix order and Burrows-Wheeler transform over symbols of STEP bytes;
the transforms are merged by refining an interleave symbol by symbol. Where neighbours in the merged order begin to
differ gives their common prefix, and intervals that agree for WIDTH bytes are the repeated windows.

Nothing is removed on a rolling hash alone: those only bring candidates together. Whole runs, and windows under very
common anchors, are equal if their 128-bit BLAKE2 digests are; symbols of the transforms are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.common import bounded_batches, cut, partitions, stored
from strandworks.llm.repeats import merged_repeats, rolling, segments

#: Bytes of a repeated string, and of a symbol of the transforms.
WIDTH, STEP = 400, 50
#: Bytes of the runs whose transforms are merged in one go, at least one anchor's.
BUCKET = 2 << 20
#: Different runs under one anchor beyond which its windows are dealt by their own digests instead. Both ways give the
#: same result; the second one spreads a very common anchor over many tasks.
MANY = 4000
RUNS = "kid long, th long, a int, n int, anchor long, content binary, again boolean"


def digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _runs(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            contents: list[bytes] = []
            for kid, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_buffer()
                if raw is None or raw.size < width:
                    continue
                first, length, anchor, again = segments(np.frombuffer(raw, np.uint8), width, gram)
                n, view = len(first), memoryview(raw)
                contents += [digest(view[a:b]) for a, b in zip(first.tolist(), (first + length + width - 1).tolist(), strict=True)]
                out.append((np.full(n, kid), np.full(n, th), first.astype(np.int32), length.astype(np.int32), anchor.view(np.int64), again))
            if out:
                kid, th, first, length, anchor, again = (pa.array(np.concatenate(x)) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([kid, th, first, length, anchor, pa.array(contents, pa.binary()), again], names=["kid", "th", "a", "n", "anchor", "content", "again"])

    return run


SLICES = pa.schema([("key", pa.int64()), ("kid", pa.int64()), ("th", pa.int64()), ("a", pa.int32()), ("target", pa.bool_()), ("many", pa.bool_()), ("bytes", pa.binary())])


def _slices(width: int):
    """The bytes of the runs that are to be compared, under their anchor; a row of the input is a text and its runs.

    Of a run under a very common anchor, each window goes under its own hash with its digest as its bytes. Repeated
    rows of one text are read once.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SLICES, strict=True)], schema=SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for kid, th, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if not runs or (kid, th) in done:
                    continue
                done.add((kid, th))
                raw = memoryview(text.as_buffer())
                for r in runs:
                    piece = raw[r["a"] : r["a"] + r["n"] + width - 1]
                    if r["many"]:
                        (whole,) = rolling(np.frombuffer(piece, np.uint8), (width,))
                        rows += [(h, kid, th, r["a"] + i, r["target"], True, digest(piece[i : i + width])) for i, h in enumerate(whole.view(np.int64).tolist())]
                    else:
                        rows.append((r["anchor"], kid, th, r["a"], r["target"], False, bytes(piece)))
                    if len(rows) >= 2000:
                        yield flush(rows)
                        rows = []
            if rows:
                yield flush(rows)

    return run


def _merge(width: int, step: int):
    """Repeated windows of whole anchors, a bucket at a time; the rows of a partition are sorted by key.

    Windows of very common anchors stream by: of each hash only the first is held until a second one comes.
    """

    def ranges(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["kid", "th", "s", "e"])

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        found: list[tuple[int, int, int, int]] = []
        for i, starts, ends in merged_repeats([r[6] for r in rows], width, step):
            _, kid, th, a, target, _, _ = rows[i]
            if target:
                found += [(kid, th, a + int(s), a + int(e)) for s, e in zip(starts, ends, strict=True)]
        return ranges(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, key, first = 0, None, {}
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[5]:
                    if row[0] != key:
                        key, first = row[0], {}
                    before = first.get(row[6], False)
                    first[row[6]] = row if before is False else None
                    if before is not False:
                        found += [(x[1], x[2], x[3], x[3] + width) for x in (before, row) if x is not None and x[4]]
                    continue
                if size >= BUCKET and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
            if found:
                yield ranges(found)
        if held:
            yield flush(held)

    return run


def repeated_ranges(texts: DataFrame, width: int = WIDTH, step: int = STEP, gram: int = 32) -> DataFrame:
    """``kid``, ``th``, ``s``, ``e``: byte ranges covered by repeated windows; they may overlap.

    ``texts``: kid and th (together the key of a text), text, and what else the caller keeps beside a text.
    """
    runs = stored(texts.select("kid", "th", "text").mapInArrow(_runs(width, gram), RUNS))
    seen = runs.groupBy("anchor").agg(F.count("*").alias("total"), F.max("again").alias("again")).where((F.col("total") > 1) | F.col("again")).select("anchor")
    live = cut(runs.join(seen, "anchor", "left_semi"))
    # on its own, so that the join with a very common anchor's number of runs can be split
    contents = cut(live.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.max("again").alias("again"), F.min(F.struct("kid", "th", "a", "n")).alias("one")))
    variants = contents.groupBy("anchor").agg(F.count("*").alias("variants"))
    judged = cut(contents.join(variants, "anchor").where((F.col("copies") > 1) | (F.col("variants") > 1) | F.col("again")))
    whole = live.join(judged.where(F.col("copies") > 1).select("anchor", "content"), ["anchor", "content"], "left_semi").select("kid", "th", F.col("a").alias("s"), (F.col("a") + F.col("n") + width - 1).alias("e"))

    work = judged.where((F.col("variants") > 1) | F.col("again") & (F.col("copies") == 1)).select("one.*", F.struct(F.col("one.a").alias("a"), F.col("one.n").alias("n"), "anchor", (F.col("copies") == 1).alias("target"), (F.col("variants") > MANY).alias("many")).alias("r"))
    by_text = work.groupBy("kid", "th").agg(F.collect_list("r").alias("runs"))
    slices = texts.join(by_text, ["kid", "th"], "left").select("kid", "th", "text", "runs", *(c for c in texts.columns if c not in ("kid", "th", "text"))).mapInArrow(_slices(width), "key long, kid long, th long, a int, target boolean, many boolean, bytes binary")
    merged = slices.repartition(partitions(texts.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_merge(width, step), "kid long, th long, s int, e int")
    return whole.unionByName(merged)


def union_of(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, with those that meet made one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, step: int = STEP, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Each text without the bytes covered by strings of ``width`` bytes that also start elsewhere.

    Texts are UTF-8 bytes; strings never cross texts and are judged on the input. Returns for every row: the id (of
    any type), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs of removed bytes), ``kept_sha256`` and, if asked
    for, ``text``: what is kept as a string, without the parts of a character that a removal cuts in two.

    Null and empty texts, and texts shorter than ``width``, lose nothing; an empty table gives no rows. Repeated rows
    are copies of each other, so their strings are repeated; rows of one id may hold different texts. A null id is
    allowed. Further columns are ignored. ``width`` is a multiple of ``step``.
    """
    bounded_batches(docs.sparkSession)
    # the two hashes only name a text: rows that share both have the same text and lose the same bytes
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("kid"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    # all columns go through both joins, so that they read one exchange: the texts are shuffled once
    ranges = repeated_ranges(texts, width, step)
    by_text = ranges.groupBy("kid", "th").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    fields = [docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("text", T.StringType())]
    out = T.StructType(fields if keep_text else fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = memoryview(text.as_buffer() or b"")
                spans = union_of([(r["s"], r["e"]) for r in ranges or []])
                sha, at, kept = hashlib.sha256(), 0, []
                for s, e in [*spans, (len(raw), len(raw))]:
                    sha.update(raw[at:s])
                    if keep_text:
                        kept.append(raw[at:s])
                    at = e
                rows.append((len(raw), sum(e - s for s, e in spans), len(spans), sha.hexdigest(), *([b"".join(kept).decode("utf-8", "ignore")] if keep_text else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * (len(out) - 1)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=out.names)  # noqa: B905

    return texts.join(by_text, ["kid", "th"], "left").select("id", "text", "ranges").mapInArrow(run, out)
