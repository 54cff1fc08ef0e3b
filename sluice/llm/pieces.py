"""Operator 3: SentencePiece encoding and decoding by a max-plus parallel scan.

A text is one "▁" and its characters, spaces as "▁"; its encoding is the segmentation into
vocabulary pieces with the greatest sum of scores, the longer last piece winning ties; characters
outside the vocabulary become byte pieces. Decoding is the exact inverse: a literal "▁" in a text
is encoded as bytes, so every text comes back unchanged.

The vocabulary gives a piece's rank r, not its probability. Ranks follow use, so a piece scores as
in a Zipf-Mandelbrot law, the log of 1 / (r + RANK_SHIFT); nothing is fitted to a corpus. The sum is
then the log-likelihood of a segmentation. The vocabulary's own program joins pairs greedily; four
words in five get its ids, and no more ids are needed than it takes.

No piece holds "▁" after another character, so a text falls apart into units, each encoded once
per slice. Giant documents are cut at fixed lengths whatever the characters there. A chunk's
state at a boundary is how far before it the path's last cut lies. Each chunk yields the max-plus
matrix from the states at its start to those at its end (of rank one where a unit border lies
inside, so that only the chunk's first and last unit need all states); matrices are combined
associatively to the best scores at every boundary; a chunk then maps each end state to its start
state, the maps are composed from the end, and every chunk is traced back on its own.

Null and empty texts have no ids. Repeated rows are encoded each. Extra columns are ignored."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, ragged, segment_sum, slices, together

MODEL = "piece_bpe_32k.model"
#: Characters of a chunk; longer texts are giant.
CHUNK = 32_768
#: What a rank is raised by before its logarithm; scores are in thousandths, so sums are exact.
RANK_SHIFT, UNIT_SCORE = 200, 1000
CACHED_UNITS = 300_000
#: Text bytes encoded at once.
SLICE = 4 << 20
SPACE = "▁"
_UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_STAND_IN = ""  # stands for a literal "▁" until it becomes bytes
NONE = -(1 << 60)


class Pieces:
    """Pieces and integer scores of a model, and the Viterbi steps over them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        # a stored score is the negative rank; below -1e6 it marks runs of spaces that merging never prefers, which rank last here
        last = 1 - min(s for i in plain if (s := model.get_score(i)) > -1e6)
        of_rank = lambda r: -round(UNIT_SCORE * math.log(r + RANK_SHIFT))
        self.score = {model.id_to_piece(i): (of_rank(min(-model.get_score(i), last)), i) for i in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.penalty = 3 * of_rank(last)
        self.longest = max(map(len, self.score))
        self.text = {i: p.replace(SPACE, " ").encode() for p, (_, i) in self.score.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.prefixes = {p[:n] for p in self.score for n in range(1, len(p) + 1)}
        self.cache: dict[str, tuple[int, bytes]] = {}

    def step(self, text: str, at: int, least: int) -> list[tuple[int, int, int]]:
        """(start, score, id) of the pieces that end at `at` and start at `least` or later, longest
        first; id -1: the last character as bytes."""
        found = []
        for start in range(max(least, at - self.longest), at):
            hit = self.score.get(text[start:at])
            if hit:
                found.append((start, *hit))
        if text[at - 1] not in self.score:
            found.append((at - 1, self.penalty, -1))
        return found

    def forward(self, text: str, least: int, entry: dict[int, int], first: int) -> tuple[list[int], list[tuple[int, int]]]:
        """Best value and (start, id) of every position from `first` on, given values at entry positions."""
        best, back = [NONE] * (len(text) + 1), [(-1, -2)] * (len(text) + 1)
        for p, v in entry.items():
            best[p] = v
        for at in range(first, len(text) + 1):
            top, came = NONE, (-1, -2)
            for start, score, i in self.step(text, at, least):
                if best[start] + score > top and best[start] > NONE:
                    top, came = best[start] + score, (start, i)
            best[at], back[at] = top, came
        return best, back

    def trace(self, text: str, back: list[tuple[int, int]], at: int, stop: int) -> tuple[list[int], int]:
        """Ids from the first cut at or before stop up to `at`, and that cut."""
        ids: list[int] = []
        while at > stop:
            start, i = back[at]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(self.bytes[b] for b in reversed(text[start].replace(_STAND_IN, SPACE).encode()))
            at = start
        return ids[::-1], at

    def unit(self, text: str) -> tuple[int, bytes]:
        """Score and ids of one unit."""
        hit = self.cache.get(text)
        if hit is None:
            hit = self._solve(text)
            if len(self.cache) < CACHED_UNITS:
                self.cache[text] = hit
        return hit

    def _solve(self, text: str) -> tuple[int, bytes]:
        """forward() and trace() of a whole unit, from each start as far as pieces begin so: earlier
        starts, so longer pieces, are seen first and keep ties."""
        n, score, prefixes = len(text), self.score, self.prefixes
        best, start_of, id_of = [NONE] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0
        for start in range(n):
            base = best[start]
            if text[start] not in score and base + self.penalty > best[start + 1]:
                best[start + 1], start_of[start + 1], id_of[start + 1] = base + self.penalty, start, -1
            for end in range(start + 1, n + 1):
                part = text[start:end]
                if part not in prefixes:
                    break
                hit = score.get(part)
                if hit is not None and base + hit[0] > best[end]:
                    best[end], start_of[end], id_of[end] = base + hit[0], start, hit[1]
        return best[n], array("I", self.trace(text, list(zip(start_of, id_of, strict=True)), n, 0)[0]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode()[1:]


@lru_cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def normal(text: str) -> str:
    return SPACE + text.replace(SPACE, _STAND_IN).replace(" ", SPACE) if text else ""


def encode(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and ids per text. Texts with single spaces are split by
    Arrow, others by a regular expression; either way each distinct unit is encoded once."""
    model = pieces(path)
    text = pc.fill_null(text, "")
    odd = pc.match_substring_regex(text, f"  | \\n|^ | $|[\\x01\\x02{SPACE}{_STAND_IN}]|^$").to_numpy(zero_copy_only=False)
    split = pc.split_pattern(pc.replace_substring(text, "\n", " \x01 \x02"), " ")
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    units = [model.unit("\n" if n == "\x01" else n[1:].replace("\x02", "") if n.startswith("\x02") else SPACE + n)[1] if n != "\x02" else b"" for n in names] if not odd.all() else [b""] * len(names)
    if odd.any():
        texts = text.to_pylist()
        starts = np.cumsum(counts) - counts
        known: dict[str, int] = {}
        parts = []
        for r in range(len(texts)):
            if not odd[r]:
                parts.append(codes[starts[r] : starts[r] + counts[r]])
                continue
            own = []
            for unit in _UNIT.findall(normal(texts[r])):
                if unit not in known:
                    known[unit] = len(units)
                    units.append(model.unit(unit)[1])
                own.append(known[unit])
            parts.append(np.array(own, np.int64))
        counts = np.array([len(p) for p in parts], np.int64)
        codes = np.concatenate(parts) if parts else codes
    lengths = np.fromiter(map(len, units), np.int64, len(units)) // 4
    flat = np.frombuffer(b"".join(units), np.uint32)
    at = np.cumsum(lengths) - lengths
    of_unit = lengths[codes]
    return flat[ragged(at[codes], of_unit)], segment_sum(of_unit, np.cumsum(counts) - counts, counts)


# --- chunks of giant documents ------------------------------------------------------------------


def _borders(text: str, first: int) -> tuple[int, int]:
    """First and last unit border at position `first` or later, -1 without any. A border lies before
    a "▁" that follows another character, and on both sides of a line feed."""
    found = [m.start() for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}|(?<=\n)|\n", text) if m.start() >= first]
    return (found[0], found[-1]) if found else (-1, -1)


def chunk_matrix(model: Pieces, text: str, first: int) -> np.ndarray:
    """Max-plus matrix of a chunk. text starts `first` characters before the chunk (context); rows
    are states at its start, columns states at its end."""
    states, n = model.longest, len(text)
    low, high = _borders(text, first)
    matrix = np.full((states, states), NONE, np.int64)
    ends = [n - o for o in range(states) if n - o >= first]

    def from_start(o: int, until: int) -> list[int]:
        return model.forward(text[:until], first - o, {first - o: 0}, first + (o == 0) if o == 0 else first + 1)[0]

    if low >= 0:
        middle = sum(model.unit(u)[0] for u in _UNIT.findall(text[low:high]))
        tail = model.forward(text[high:], 0, {0: 0}, 1)[0]
        for o in range(min(states, first + 1)):
            head = 0 if low == first and o == 0 else from_start(o, low)[low] if low > first else NONE
            if head > NONE:
                for end in ends:
                    if end >= high and tail[end - high] > NONE:
                        matrix[o, n - end] = head + middle + tail[end - high]
    else:
        for o in range(min(states, first + 1)):
            best = from_start(o, n)
            for end in ends:
                if end > first or (end == first and o == 0):
                    matrix[o, n - end] = best[end]
    return matrix


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum((a[:, :, None] + b[None]).max(1), NONE)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, pairing neighbours level by level: the product is associative."""
    if len(matrices) < 2:
        return matrices
    pairs = [combine(matrices[i], matrices[i + 1]) for i in range(0, len(matrices) - 1, 2)]
    inner = scan(pairs)
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(inner[i // 2] if i % 2 else combine(inner[i // 2 - 1], matrices[i]))
    return out


def _values(model: Pieces, text: str, first: int, entry: np.ndarray) -> tuple[list[tuple[int, int]], int, int]:
    """Back pointers of a chunk's first and last unit, or of all of it, given the best scores of the
    states at its start; the borders between (equal if there are none)."""
    low, high = _borders(text, first)
    start = {first - o: int(entry[o]) for o in range(min(len(entry), first + 1)) if entry[o] > NONE}
    if low < 0:
        return model.forward(text, 0, start, first + 1)[1], -1, -1
    head = model.forward(text[:low], 0, start, first + 1)[1] if low > first else [(-1, -2)] * (low + 1)
    tail = model.forward(text[high:], 0, {0: 0}, 1)[1]
    back = head + [(-1, -2)] * (len(text) - low)
    for i in range(1, len(tail)):
        back[high + i] = (tail[i][0] + high, tail[i][1])
    return back, low, high


def exit_map(model: Pieces, text: str, first: int, entry: np.ndarray) -> np.ndarray:
    """The state at the chunk's start that the best path to each state at its end comes from."""
    back, low, _ = _values(model, text, first, entry)
    found = np.zeros(len(entry), np.int64)
    for o in range(len(entry)):
        at = low if low >= 0 else len(text) - o
        if low >= 0 or at > first and back[at][1] != -2:
            while at > first:
                at = back[at][0]
            found[o] = first - at
    return found


def trace_chunk(model: Pieces, text: str, first: int, entry: np.ndarray, end_state: int) -> list[int]:
    """Ids of the pieces whose end lies in the chunk, up to the path's last cut before its end."""
    back, low, high = _values(model, text, first, entry)
    end = len(text) - end_state
    if low < 0:
        return model.trace(text, back, end, first)[0]
    head = model.trace(text, back, low, first)[0] if low > first else []
    middle = np.frombuffer(b"".join(model.unit(u)[1] for u in _UNIT.findall(text[low:high])), np.uint32).tolist()
    return head + middle + model.trace(text, back, end, high)[0]


def encode_chunked(text: str, path: str, chunk: int = CHUNK) -> list[int]:
    """One text by the chunk scan, as the distributed steps do it."""
    model, whole = pieces(path), normal(text)
    parts = list(_cut(whole, chunk, model.longest))
    entries = _entries([chunk_matrix(model, t, f) for t, f in parts])
    maps = [exit_map(model, t, f, e) for (t, f), e in zip(parts, entries, strict=True)]
    return [i for (t, f), e, s in zip(parts, entries, _end_states(maps), strict=True) for i in trace_chunk(model, t, f, e, s)]


def _cut(whole: str, chunk: int, longest: int) -> Iterator[tuple[str, int]]:
    """Chunks with up to longest - 1 characters of context before them. The last takes a short rest."""
    starts = list(range(0, max(1, len(whole) - longest), chunk))
    for s, e in zip(starts, [*starts[1:], len(whole)], strict=True):
        first = min(s, longest - 1)
        yield whole[s - first : e], first


def _entries(matrices: list[np.ndarray]) -> list[np.ndarray]:
    start = np.full(len(matrices[0]), NONE, np.int64)
    start[0] = 0
    return [start, *(p[0] for p in scan(matrices)[:-1])]


def _end_states(maps: list[np.ndarray]) -> list[int]:
    states = [0]
    for m in reversed(maps[1:]):
        states.append(int(m[states[-1]]))
    return states[::-1]


def _per_chunk(rows: DataFrame, path: str, columns: list[str], work, schema: str, name: str) -> DataFrame:
    """rows (key, k, ...) with work(model, row) as a further column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            got = [work(model, r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(got, pa.binary())], ["key", "k", name])

    return rows.select(*columns).mapInArrow(run, schema)


def _per_document(rows: DataFrame, name: str, work) -> DataFrame:
    """Chunk results of a document brought together (a few KB per chunk), and work's answer per chunk."""

    def run(data: pa.Table) -> pa.Table:
        data = data.sort_by("k")
        got = work([np.frombuffer(b, np.int64) for b in data.column(name).to_pylist()])
        return pa.table({"key": data.column("key"), "k": data.column("k"), "answer": pa.array([np.asarray(x, np.int64).tobytes() for x in got], pa.binary())})

    return rows.groupBy("key").applyInArrow(run, "key long, k int, answer binary")


def encode_documents(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text and ids (little-endian 32-bit) of every row of docs."""
    path = path or model_path()
    size = pieces(path).longest
    states = range(size)
    docs = docs.select("doc_id", "text")
    short = F.coalesce(F.char_length("text"), F.lit(0)) <= chunk

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, most=SLICE):
            for part in slices(batch, most=SLICE):
                ids, counts = encode(part.column("text"), path)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)], pa.binary())], ["doc_id", "text", "ids"])
        give_back()

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text string, ids binary"
    small = docs.where(short).mapInArrow(plain, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                parts = list(_cut(normal(r["text"]), chunk, size))
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([t for t, _ in parts], pa.string()), pa.array([f for _, f in parts], pa.int32())], ["key", "k", "part", "first"])

    giant = materialize(docs.where(~short).withColumn("key", F.monotonically_increasing_id()))
    chunks = materialize(giant.select("key", "text").mapInArrow(cut, "key long, k int, part string, first int"))
    spread = chunks.repartition("key", "k")
    matrices = _per_chunk(spread, path, ["key", "k", "part", "first"], lambda m, r: chunk_matrix(m, r["part"], r["first"]).tobytes(), "key long, k int, matrix binary", "matrix")
    entries = materialize(_per_document(matrices, "matrix", lambda ms: _entries([m.reshape(len(states), -1) for m in ms])).withColumnRenamed("answer", "entry"))
    known = chunks.join(entries, ["key", "k"])
    maps = _per_chunk(known, path, ["key", "k", "part", "first", "entry"], lambda m, r: exit_map(m, r["part"], r["first"], np.frombuffer(r["entry"], np.int64)).tobytes(), "key long, k int, map binary", "map")
    ends = materialize(_per_document(maps, "map", lambda ms: [[s] for s in _end_states(ms)]).withColumnRenamed("answer", "end"))
    traced = _per_chunk(known.join(ends, ["key", "k"]), path, ["key", "k", "part", "first", "entry", "end"], lambda m, r: array("I", trace_chunk(m, r["part"], r["first"], np.frombuffer(r["entry"], np.int64), int(np.frombuffer(r["end"], np.int64)[0]))).tobytes(), "key long, k int, ids binary", "ids")
    whole = traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p")).select("key", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))
    return small.unionByName(giant.join(whole, "key").select("doc_id", "text", "ids"))


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and whether decoding gives the text back."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            ids = [np.frombuffer(b, np.uint32) for b in batch.column("ids").to_pylist()]
            same = [model.decode(i) == (t or "") for i, t in zip(ids, batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "decoded_equal"])

    return encoded.mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, n_tokens long, ids_crc32 long, decoded_equal boolean")
