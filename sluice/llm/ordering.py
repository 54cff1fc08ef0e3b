"""Operator 1: training-order materialisation of token ids as binary shards.

The ids of all documents, each closed by the end id, form one stream in the stored table's scan
order; the stream is cut into sequences of `stride` ids, the last one filled up with the pad id.
A keyed Feistel permutation with cycle-walking sends sequence i to global slot p(i), so the order
of training is a shuffle that nobody has to store and that can be undone. Slots are dealt to
shards of `per_shard` slots in range order; a shard is one file of records of fixed length (the
ids little-endian, then one line feed, which the text writer adds), so record r of a shard lies at
byte r * record length, and a reader resumes anywhere by seeking.

Texts are encoded once. Their ids are stored in the shared folder with their place in their scan
partition; the driver adds up one total per partition (16 bytes each), which places every stored
run in the stream. From then on everything derives from that stored table, so a task that runs
again gives the same sequences, whatever order a second scan of the input would have. Tasks of the
last step hold whole ranges of neighbouring shards.

Files are written by Spark's writer through its commit protocol, so lost executors leave no
partial shards. Null texts count as empty: the end id alone. Repeated rows are written each; ids
of documents and other columns play no part. An empty table gives no shards and no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import subwords
from .common import give_back, materialize, shared_dir, slices, together

STRIDE, PER_SHARD, KEY, ROUNDS = 2048, 4096, 20_240_601, 4
END_ID = PAD_ID = 0
#: Text bytes encoded at once: larger slices repeat fewer words.
SLICE = 4 << 20
#: Neighbouring shards that one task writes, at most.
SHARDS_A_TASK = 16
_KIND = np.dtype("<u2")  # the vocabulary has fewer than 65,536 entries
_M = np.uint64(0x9E3779B97F4A7C15)


def _half_bits(size: int) -> int:
    return max(1, -(-max(1, (size - 1).bit_length()) // 2))


def _round(half: np.ndarray, key: int, r: int, mask: np.uint64) -> np.ndarray:
    x = (half + np.uint64((key * 2654435761 + r * 40503 + 1) & (2**64 - 1))) * _M
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & mask


def permute(index: np.ndarray, size: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slot of each index below size, or with `back` the index of each slot: a balanced Feistel
    network over the next even power of two, applied again until the value is below size."""
    bits = np.uint64(_half_bits(size))
    mask = np.uint64((1 << int(bits)) - 1)
    value = np.asarray(index).astype(np.uint64)
    todo = np.ones(len(value), bool)
    while todo.any():
        left, right = value[todo] >> bits, value[todo] & mask
        for r in range(ROUNDS):
            if back:
                left, right = right ^ _round(left, key, ROUNDS - 1 - r, mask), left
            else:
                left, right = right, left ^ _round(right, key, r, mask)
        value[todo] = (left << bits) | right
        todo = value >= np.uint64(size)
    return value.astype(np.int64)


def pack(ids: np.ndarray) -> bytes:
    """Compressed ids: they are stored once and shuffled once."""
    return pa.Codec("zstd", compression_level=3).compress(ids.astype(_KIND).tobytes(), asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 2 * n, codec="zstd", asbytes=True), _KIND)


def encoded_stream(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Stored runs of ids: (part, at, n, ids), each run's place in its scan partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in together(batches, most=SLICE):
            for piece in slices(batch, most=SLICE):
                ids, counts = subwords.encode(piece.column("text"), vocabulary)
                own = np.insert(ids, np.cumsum(counts), END_ID)
                yield pa.RecordBatch.from_arrays([piece.column("part").slice(0, 1), *(pa.array([x], pa.int64()) for x in (at, len(own))), pa.array([pack(own)], pa.binary())], ["part", "at", "n", "ids"])
                at += len(own)
        give_back()

    return materialize(docs.select("text", F.spark_partition_id().alias("part")).mapInArrow(run, "part int, at long, n long, ids binary"))


def write_shards(docs: DataFrame, path: str, stride: int = STRIDE, per_shard: int = PER_SHARD, key: int = KEY, vocabulary: str | None = None) -> int:
    """Write the shards below path and return the number of sequences."""
    stream = encoded_stream(docs, vocabulary or subwords.vocabulary_path())
    sizes = stream.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toArrow()
    parts, n = (sizes.column(c).to_numpy() for c in ("part", "n"))
    sequences = -(-int(n.sum()) // stride)
    if not sequences:
        return 0
    shared = docs.sparkSession.sparkContext.broadcast((parts, np.cumsum(n) - n))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sequences that lie inside a run, and what it holds of those it shares with others."""
        parts, bases = shared.value
        subwords.forget()
        for batch in batches:
            for r in batch.to_pylist():
                base = int(bases[np.searchsorted(parts, r["part"])]) + r["at"]
                ids = unpack(r["ids"], r["n"])
                cuts = np.unique(np.concatenate([[0, len(ids)], np.arange(-base % stride, len(ids), stride)]))
                starts = base + cuts[:-1]
                pieces = [pack(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(permute(starts // stride, sequences, key)), pa.array((starts % stride).astype(np.int32)), pa.array(np.diff(cuts).astype(np.int32)), pa.array(pieces, pa.binary())], ["slot", "at", "n", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole sequences as they are; parts of the others are held until the end and joined."""

        def out(slots: list[int], rows: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(rows, pa.binary())], ["slot", "ids"])

        held: dict[int, np.ndarray] = {}
        subwords.forget()
        for batch in batches:
            slots, rows = [], []
            for r in batch.to_pylist():
                own = unpack(r["ids"], r["n"])
                if r["n"] == stride:
                    slots.append(r["slot"])
                    rows.append(own.tobytes())
                else:
                    held.setdefault(r["slot"], np.full(stride, PAD_ID, _KIND))[r["at"] : r["at"] + r["n"]] = own
            yield out(slots, rows)
        yield out(list(held), [x.tobytes() for x in held.values()])

    shards = -(-sequences // per_shard)
    a_task = max(1, min(SHARDS_A_TASK, shards // 1024))
    shard = F.floor(F.col("slot") / per_shard)
    dealt = stream.mapInArrow(cut, "slot long, at int, n int, ids binary").repartitionById(-(-shards // a_task), F.floor(shard / a_task).cast("int"))
    whole = dealt.mapInArrow(join, "slot long, ids binary").withColumn("shard", shard.cast("int")).sortWithinPartitions("shard", "slot")
    whole.select(F.col("ids").cast("string").alias("value"), "shard").write.partitionBy("shard").text(path)
    return sequences


def read_slots(spark: SparkSession, path: str, sequences: int, first_slot: int = 0, stride: int = STRIDE, per_shard: int = PER_SHARD, key: int = KEY, with_ids: bool = False) -> DataFrame:
    """The records from first_slot on, in slot order within each shard: slot, shard, row, the
    sequence it came from, and the crc32 of its ids (with_ids: the ids too)."""
    record = stride * 2 + 1
    schema = "slot long, shard int, row int, sequence long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if not sequences:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords.forget()
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, record)
                rows = np.arange(max(0, first_slot - shard * per_shard), len(data))
                slots = shard * per_shard + rows
                raw = [data[r, :-1].tobytes() for r in rows]
                columns = [pa.array(slots.astype(np.int64)), pa.array(np.full(len(rows), shard, np.int32)), pa.array(rows.astype(np.int32)), pa.array(permute(slots, sequences, key, back=True)), pa.array([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in raw], pa.int64())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u2").astype(np.int32) for x in raw], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "row", "sequence", "ids_crc32", "ids"][: len(columns)])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    files = files.withColumn("shard", F.regexp_extract("path", r"shard=(\d+)", 1).cast("int")).where(F.col("shard") >= first_slot // per_shard)
    return files.select("shard", "content").mapInArrow(run, schema)


def training_order(docs: DataFrame) -> DataFrame:
    """Write the shards to the shared folder and return what they hold, read back from the files."""
    path = shared_dir(docs.sparkSession)
    return read_slots(docs.sparkSession, path, write_shards(docs, path))
