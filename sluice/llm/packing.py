"""Operator 8: best-fit packing of tokenised documents into fixed-length sequences.

Method: pattern packing by non-negative least squares. The lengths of all pieces form a histogram
of at most `capacity` bins. Patterns of two or three lengths that fill a sequence exactly are
enumerated, their repeat counts are fitted to the histogram by non-negative least squares
(cyclic coordinate descent), rounded down so that no length is overdrawn, and what remains is
packed by best fit decreasing in counted form. The driver sees the histogram and the plan, both
bounded by the capacity and not by the data; pieces learn their place by a join with the plan.

Null texts count as empty: they give one piece that holds the end id alone. Repeated rows are
packed each. Columns other than the id and the text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import subwords
from .common import give_back, materialize, ragged, slices, together

CAPACITY = 2048
END_ID = 0
#: Grid step of the first two lengths of a three-document pattern.
TRIPLE_STEP = 16
SWEEPS = 40
#: Text bytes encoded at once.
SLICE = 2 << 20
#: Words whose ids a worker keeps: the pipeline's other stages need memory too.
REMEMBERED = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "rank_from", "rank_to", "first_sequence", "offset")])


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most `capacity` ids of each document's ids and the end id."""
    path = vocabulary or subwords.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, most=SLICE):
            for part in slices(batch, most=SLICE):
                ids, counts = subwords.encode(part.column("text"), path, REMEMBERED)
                ends = np.cumsum(counts)
                own = np.insert(ids, ends, end_id).astype("<u4")
                counts = counts + 1
                first = np.cumsum(counts) - counts  # of each document in own
                of_doc = -(-counts // capacity)
                piece = ragged(np.zeros(len(of_doc), np.int64), of_doc)
                start, row = piece * capacity, np.repeat(np.arange(len(of_doc)), of_doc)
                length = np.minimum(counts[row] - start, capacity)
                marks = [zlib.crc32(own[a : a + n]) for a, n in zip(first[row] + start, length, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)).cast(pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(marks, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def patterns(histogram: np.ndarray, step: int = TRIPLE_STEP) -> np.ndarray:
    """Rows of three lengths, the last 0 for pairs, that sum to the capacity and occur in the histogram."""
    capacity = len(histogram) - 1
    a = np.arange(1, capacity // 2 + 1)
    pairs = np.stack([capacity - a, a, np.zeros_like(a)], 1)
    grid = np.arange(step, capacity, step)
    x, y = (m.ravel() for m in np.meshgrid(grid, grid))
    z = capacity - x - y
    fits = (x >= y) & (y >= z) & (z > 0)
    found = np.concatenate([pairs, np.stack([x, y, z], 1)[fits]])
    there = histogram > 0
    there[0] = True
    return found[there[found].all(1)]


def fit(found: np.ndarray, histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance of the patterns' sum from the histogram."""
    uses = []
    for row in found.tolist():
        own: dict[int, int] = {}
        for n in row:
            if n:
                own[n] = own.get(n, 0) + 1
        uses.append((list(own.items()), sum(k * k for k in own.values())))
    rest, x = histogram.astype(float).tolist(), [0.0] * len(uses)
    for _ in range(sweeps):
        moved = 0.0
        for j, (own, norm) in enumerate(uses):
            step = max(-x[j], sum(k * rest[n] for n, k in own) / norm)
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, k in own:
                    rest[n] -= k * step
        if moved < 0.01:
            break
    return np.array(x)


def plan(histogram: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank from, rank to, first sequence, offset): the pieces of a length with these
    ranks go to successive sequences, each at this offset. histogram[n] counts pieces of length n."""
    capacity = len(histogram) - 1
    rest = histogram.astype(np.int64).copy()
    used = np.zeros_like(rest)
    runs: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def place(length: int, times: int, first: int, offset: int) -> None:
        runs.append((length, int(used[length]), int(used[length]) + times, first, offset))
        used[length] += times
        rest[length] -= times

    if rest[capacity]:
        sequence = int(rest[capacity])
        place(capacity, sequence, 0, 0)
    found = patterns(rest)
    counts = fit(found, rest)
    for j in np.argsort(-counts, kind="stable"):
        own = [n for n in found[j].tolist() if n]
        times = min([int(counts[j] + 1e-9), *(int(rest[n]) // own.count(n) for n in own)])
        if times > 0:
            offset = 0
            for n in own:
                place(n, times, sequence, offset)
                offset += n
            sequence += times
    free: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []

    def open_run(room: int, first: int, times: int) -> None:
        if room:
            if room not in free:
                free[room] = []
                insort(sizes, room)
            free[room].append((first, times))

    for length in range(capacity - 1, 0, -1):
        while rest[length]:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                deep = capacity // length
                full, left = divmod(int(rest[length]), deep)
                if full:
                    for k in range(deep):
                        place(length, full, sequence, k * length)
                    open_run(capacity - deep * length, sequence, full)
                    sequence += full
                if left:
                    for k in range(left):
                        place(length, 1, sequence, k * length)
                    open_run(capacity - left * length, sequence, 1)
                    sequence += 1
                continue
            room = sizes[at]
            first, there = free[room].pop()
            if not free[room]:
                del free[room], sizes[at]
            times = min(there, int(rest[length]))
            if times < there:
                open_run(room, first + times, there - times)
            place(length, times, first, capacity - room)
            open_run(room - length, first, times)
    return runs


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID, buckets: int | None = None) -> DataFrame:
    """Every piece with its sequence and its place there. Ranks within a length are counted per
    bucket of documents and shifted by the counts of the buckets before, so that a common length
    is spread over many tasks."""
    spark = docs.sparkSession
    n = buckets or max(16, spark.sparkContext.defaultParallelism * 4)
    pieces = materialize(token_pieces(docs, capacity, vocabulary, end_id).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int")))
    per_bucket = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():
        histogram[row["length"]] = row["n"]
    runs = spark.createDataFrame(plan(histogram), PLAN)
    before = per_bucket.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("within") + F.col("before"))
    # the plan has a few thousand rows whatever the input: capacity bounds it
    placed = ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & (ranked["rank"] >= runs["rank_from"]) & (ranked["rank"] < runs["rank_to"]))
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
