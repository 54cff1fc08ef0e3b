"""What the training-data operators share: the shared folder, Arrow tokenisation, hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Text bytes handled at once inside a task; longer single texts form a slice of their own.
SLICE_BYTES = 2 << 20
_local: dict[str, str] = {}

# Workers share an executor's memory with the JVM, so what is freed goes back to the system: Arrow's
# own allocator would keep it, and so would malloc above these thresholds.
pa.set_memory_pool(pa.system_memory_pool())
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3
_libc = ctypes.CDLL(None)
if hasattr(_libc, "mallopt"):
    _libc.mallopt(_M_MMAP_THRESHOLD, 8 << 20)
    _libc.mallopt(_M_TRIM_THRESHOLD, 16 << 20)


def give_back() -> None:
    """Return freed memory to the system; called when a task's work is done."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


#: Rows of a batch: texts are long, and a batch is held several times over in an executor's memory.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1500, "spark.sql.parquet.columnarReaderBatchSize": 1024}


def short_batches(spark: SparkSession) -> None:
    """Arrow and Parquet batches of fewer rows than Spark's default. A smaller setting of the session stays."""
    for name, rows in BATCH_ROWS.items():
        if not 0 < int(spark.conf.get(name)) <= rows:
            spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that is unset
    a temporary folder takes its place on a single machine, and a cluster is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _local["top"] = _local.get("top") or tempfile.mkdtemp(prefix="sluice-")
    return f"{top.rstrip('/')}/sluice-{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def text_udf(work: Callable[[pa.RecordBatch], pa.Array], returns: str | DataType, most: int = SLICE_BYTES) -> Callable[[Column], Column]:
    """A column function of a text column: work answers a slice of rows with one value per row. The
    other columns of a row never leave the JVM, so no name of theirs can clash."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        batches = (pa.RecordBatch.from_arrays([a], ["text"]) for a in arrays)
        for batch in together(batches, most=most):
            found = [work(part) for part in slices(batch, most=most)]
            yield found[0] if len(found) == 1 else pa.concat_arrays(found)
        give_back()

    return F.arrow_udf(run, returns)


def small_enough(df: DataFrame, row_bytes: int, most: int = 64 << 20) -> DataFrame:
    """df, marked for broadcast if its rows times row_bytes stay within `most` bytes; beyond that the
    join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: the folds by which labels are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `most` bytes of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        start = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, start + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def together(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Join short batches until they hold about `most` bytes of text: what is done once per distinct
    word is then done less often."""
    held, size = [], 0
    for batch in batches:
        own = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + own > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def views(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The binary values of a column as arrays over Arrow's own memory."""
    found = []
    for chunk in column.chunks:
        width = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        _, ends, data = chunk.buffers()
        if len(chunk):
            at = np.frombuffer(ends, width)[chunk.offset : chunk.offset + len(chunk) + 1]
            raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
            found += [raw[a:b].view(kind) for a, b in zip(at[:-1], at[1:], strict=True)]
    return found


class Words:
    """Whitespace-separated words of an array of texts: distinct words, a code per word, words per text."""

    def __init__(self, text: pa.Array, lower: bool = True):
        text = pc.fill_null(text, "")
        parts = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        keep = full.to_numpy(zero_copy_only=False)
        if not keep.all():
            rows = np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(rows[keep], minlength=len(counts)).astype(np.int64)
            flat = flat.filter(full)
        coded = flat.dictionary_encode()
        self.distinct: pa.Array = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.counts = counts
        self.starts = np.cumsum(counts) - counts
        self.rows = np.repeat(np.arange(len(counts)), counts)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum values (one per word, or rows of them) over each text."""
        return segment_sum(values, self.starts, self.counts)


def segment_sum(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(starts), *values.shape[1:]), values.dtype)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs starts[i] .. starts[i] + lengths[i], one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each string's bytes."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(words))


class Grams:
    """Character n-grams of words with boundary marks, hashed into buckets, vectorised over code points."""

    def __init__(self, words: pa.Array, low: int, high: int, buckets: int):
        self.low, self.high, self.buckets = low, high, buckets
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        joined = "\x02" + "\x03\x02".join(words.to_numpy(zero_copy_only=False)) + "\x03" if len(words) else ""
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.lengths = lengths

    def part(self, a: int, b: int) -> Grams:
        """The words a .. b-1."""
        own = object.__new__(Grams)
        low = int(self.starts[a])
        own.low, own.high, own.buckets = self.low, self.high, self.buckets
        own.points, own.ends, own.starts, own.lengths = self.points[low : self.ends[b - 1]], self.ends[a:b] - low, self.starts[a:b] - low, self.lengths[a:b]
        return own

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n: the bucket of the n-gram starting at every position, and whether it fits its word."""
        left = np.repeat(self.ends, self.lengths) - np.arange(len(self.points))
        h = np.zeros(len(self.points), np.uint64)
        mask = np.uint64(self.buckets - 1)  # buckets are powers of two
        for n in range(1, self.high + 1):
            ahead = np.zeros_like(self.points)
            ahead[: max(0, len(self.points) - n + 1)] = self.points[n - 1 :]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += ahead
            h += np.uint64(1)
            if n >= self.low:
                yield (mix(h + np.uint64(n)) & mask).astype(np.int64), left >= n

    def sizes(self) -> np.ndarray:
        return sum(np.maximum(0, self.lengths - n + 1) for n in range(self.low, self.high + 1))

    def sums(self, tables: np.ndarray) -> np.ndarray:
        """Per word, the sum of tables[bucket] over its n-grams; some words at a time, which stay in cache."""
        out = np.zeros((len(self.lengths), *tables.shape[1:]), tables.dtype)
        padded = np.concatenate([tables, np.zeros_like(tables[:1])])  # the last row for what does not fit
        for a in range(0, len(out), WORDS_AT_ONCE):
            own = self.part(a, min(a + WORDS_AT_ONCE, len(out)))
            for ids, fits in own.levels():
                ids[~fits] = len(tables)
                out[a : a + WORDS_AT_ONCE] += np.add.reduceat(padded[ids], own.starts, axis=0)
        return out


#: Words whose n-grams are summed at once.
WORDS_AT_ONCE = 4096


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges (a, b) as (node, smallest node it reaches), without the roots."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
