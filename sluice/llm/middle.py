"""Operator 13: fill-in-middle transformation with memoised content-defined chunks.

A text is cut after two of its lines, which a keyed hash of the document's id draws; prefix, middle
and suffix change places between marks. To find the cuts, a rolling hash over the last 16 bytes cuts
the texts into chunks where its low bits vanish, so that passages which documents share give the same
chunks wherever they stand. A chunk's summary (lines, code points, marks, its first and last two
bytes) is computed once and kept under the chunk's content; equal hashes never stand for equal
content. Summaries add up: running sums of lines over a document's chunks locate the chunk of a cut,
running sums of code points its place, and the outer bytes of neighbours show marks across a border.

Null and empty texts stay plain, with no lines. Texts that contain a mark stay plain: the form could
not be undone. A null id hashes as no digits. Repeated rows get the same cuts; ties of the two cuts
leave the middle empty. Very long texts are a slice of their own. An empty table gives no rows. Other
columns are ignored, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewise import stream
from .common import give_back, slices, together

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED, RATE, SPM = 7, 100, 50
#: A chunk ends where the low bits of the rolling hash vanish (1 in 512 bytes) after a stretch of LEAST
#: bytes without such a place, and after GREATEST bytes at the latest.
MASK, LEAST, GREATEST = 511, 64, 4096
#: Bytes of chunks that a worker remembers; then it begins anew.
REMEMBERED = 24 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _gear() -> np.ndarray:
    """256 numbers with well mixed bits, from a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
    return (x ^ (x >> np.uint64(21))).astype(np.uint32)


GEAR = _gear()


def chunk_ends(raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Ends of the chunks, in order; every text ends one."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8):  # sums over 2, 4, 8 and 16 bytes
        further = h.copy()
        further[k:] += h[:-k] << np.uint32(k)
        h = further
    marks = np.flatnonzero(((h >> np.uint32(7)) & np.uint32(MASK)) == 0) + 1
    marks = marks[np.diff(marks, prepend=-LEAST) >= LEAST]
    ends = np.union1d(marks, rows[1:])
    ends = ends[ends > 0]
    # what is longer is cut by length
    begins = np.append(0, ends[:-1])
    pieces = np.maximum(1, -(-(ends - begins) // GREATEST))
    k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.minimum(np.repeat(begins, pieces) + (k + 1) * GREATEST, np.repeat(ends, pieces))


def summary(chunk: bytes) -> tuple[int, int, bool, bytes, bytes]:
    """Lines ended, code points begun, whether a mark is inside, first and last two bytes."""
    own = np.frombuffer(chunk, np.uint8)
    marked = b"<" in chunk and (PREFIX in chunk or SUFFIX in chunk or MIDDLE in chunk)
    return chunk.count(b"\n"), int(((own & 0xC0) != 0x80).sum()), marked, chunk[:2], chunk[-2:]


class Memo:
    """Summaries of chunks by content, bounded in bytes."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.size = most, 0
        self.known: dict[bytes, tuple] = {}
        self.asked = self.computed = 0

    def summaries(self, chunks: list[bytes]) -> list[tuple]:
        found = []
        for chunk in chunks:
            own = self.known.get(chunk)
            if own is None:
                own = summary(chunk)
                self.computed += 1
                if self.size > self.most:
                    self.known, self.size = {}, 0
                self.known[chunk] = own
                self.size += len(chunk) + 200
            found.append(own)
        self.asked += len(chunks)
        return found


class Chunks:
    """The chunks of a slice of texts with running sums of their summaries."""

    def __init__(self, text: pa.Array, memo: Memo):
        self.raw, self.rows = stream(text)
        self.ends = chunk_ends(self.raw, self.rows) if len(self.raw) else np.zeros(0, np.int64)
        self.begins = np.append(0, self.ends[:-1]) if len(self.ends) else self.ends
        at = pa.py_buffer(np.append(0, self.ends).astype(np.int64))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.ends), [None, at, pa.py_buffer(np.ascontiguousarray(self.raw))]).dictionary_encode()
        own = memo.summaries(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        lines, points, marked = (np.array([s[i] for s in own], np.int64)[codes] if own else np.zeros(0, np.int64) for i in range(3))
        self.lines, self.points = np.append(0, np.cumsum(lines)), np.append(0, np.cumsum(points))
        # the chunks of row r are first[r] .. first[r + 1] - 1
        self.first = np.searchsorted(self.ends, self.rows, side="right")
        inner = np.ones(len(self.ends) + 1, bool)
        inner[self.first] = False  # borders inside a text
        border = marked.astype(bool)
        opens = np.array([b"<" in s[4] for s in own], bool)[codes] if own else border
        for i in np.flatnonzero(opens[:-1] & inner[1 : len(opens)]) if len(opens) else []:
            both = own[codes[i]][4] + own[codes[i + 1]][3]
            border[i] |= PREFIX in both or SUFFIX in both or MIDDLE in both
        total = np.append(0, np.cumsum(border))
        self.marked = total[self.first[1:]] > total[self.first[:-1]]
        ended = self.lines[self.first[1:]] - self.lines[self.first[:-1]]
        size = np.diff(self.rows)
        last = self.raw[np.maximum(self.rows[1:] - 1, 0)] if len(self.raw) else np.zeros(len(size), np.uint8)
        self.n = ended + ((size > 0) & (last != 10))
        self.ended = ended

    def cut(self, row: int, k: int) -> tuple[int, int]:
        """Byte and code point, from the text's start, after its first k lines."""
        low, high = self.first[row], self.first[row + 1]
        if k > self.ended[row]:
            return int(self.rows[row + 1] - self.rows[row]), int(self.points[high] - self.points[low])
        if not k:
            return 0, 0
        wanted = self.lines[low] + k
        c = int(np.searchsorted(self.lines, wanted, side="left")) - 1  # the chunk with that line's end
        own = self.raw[self.begins[c] : self.ends[c]]
        to = int(np.flatnonzero(own == 10)[wanted - self.lines[c] - 1]) + 1
        points = int(self.points[c] - self.points[low]) + int(((own[:to] & 0xC0) != 0x80).sum())
        return int(self.begins[c] - self.rows[row]) + to, points


def draws(seed: int, doc_id: int | None) -> list[int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(batch: pa.RecordBatch, memo: Memo, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> pa.RecordBatch:
    chunks = Chunks(batch.column("text"), memo)
    whole = chunks.raw.tobytes()
    columns: list[list] = [[] for _ in range(5)]
    for row, doc_id in enumerate(batch.column("doc_id").to_pylist()):
        text, n = whole[chunks.rows[row] : chunks.rows[row + 1]], int(chunks.n[row])
        h1, h2, h3, h4 = draws(seed, doc_id)
        form, before, inside, output = "plain", None, None, text
        if text and not chunks.marked[row] and h3 % 100 < rate:
            (a, before), (b, to) = (chunks.cut(row, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
            form, inside = "spm" if h4 % 100 < spm else "psm", to - before
            start, middle, rest = text[:a], text[a:b], text[b:]
            output = b"".join([SUFFIX, rest, PREFIX, start, MIDDLE, middle] if form == "spm" else [PREFIX, start, SUFFIX, rest, MIDDLE, middle])
        for column, x in zip(columns, (n, form, before, inside, output), strict=True):
            column.append(x)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    arrays = [pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays[:4], arrays[4].cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, most: int = 2 << 20) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars and the output text of every row. rate: per
    cent of texts that change their form; spm: per cent of those whose suffix goes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in together(batches, most=most):
            for part in slices(batch, most=most):
                yield transform(part, memo, seed, rate, spm)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle had, from its output and form."""
    body = F.substring(output, 4, 2**31 - 1)

    def halves(text: Column, mark: bytes) -> tuple[Column, Column]:
        left = F.substring_index(text, mark.decode(), 1)
        return left, F.substring(text, F.char_length(left) + 4, F.char_length(text))

    start, rest = halves(body, SUFFIX)
    psm = F.concat(start, F.element_at(F.split(rest, MIDDLE.decode()), -1), F.substring_index(rest, MIDDLE.decode(), 1))
    last, rest = halves(body, PREFIX)
    spm = F.concat(F.substring_index(rest, MIDDLE.decode(), 1), F.element_at(F.split(rest, MIDDLE.decode()), -1), last)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame) -> DataFrame:
    """One row for each document, with hashes of the output and of the text rebuilt from it."""
    own = fill_in_middle(docs)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return own.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
