"""Operator 11: benchmark decontamination by a generalised suffix automaton.

The words of the benchmark's items form one suffix automaton, whose states are classes of word
sequences with the same places in the items. Training words are streamed through it: at every word
the state tells the longest sequence of words, ending there, that occurs in an item. A window is
`width` consecutive words of an item, or all words of an item that has fewer; it ends at a word
where the matching length reaches its own. Each state knows the window that its longer sequences
end in, and each window its items, so that lengths alone decide.

Words that the automaton knows as neighbours form runs; a sequence of items lies inside one run, so
runs shorter than the shortest window are passed over, and all runs of a slice advance in step.

The driver streams the items once. An automaton holds at most MOST words (about 80 bytes each in a
worker), longer items are cut with an overlap of width - 1 words, which keeps every window; further
words form further automata, GROUPS of them in one pass over the documents.

Null and empty texts have no words and no hits. Items without words have no window; items of equal
id count once, and an item without an id hits but is not named. Ties cannot occur; repeated rows
are marked each. An empty table gives no rows, an empty benchmark no hits. Very long texts are
streamed like others, as a slice of their own. Other columns pass through or are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewise import Runs, stream
from .common import materialize, ragged, text_udf

WIDTH = 10
#: Words of an automaton, automata of a pass.
MOST, GROUPS = 250_000, 4

#: Word bytes: digits, letters and everything beyond ASCII.
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x41:0x5B] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True

SPAN = "struct<word_from:bigint,word_to:bigint,byte_from:bigint,byte_to:bigint>"
LEAKS = f"struct<n_words:bigint,spans:array<{SPAN}>,items:array<string>>"


def words_of(text: pa.Array) -> Runs:
    return Runs(*stream(text), INSIDE)


class Automaton:
    """The suffix automaton of items, in arrays. items: (name or None, words as bytes)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int = WIDTH):
        self.width = width
        vocabulary: dict[bytes, int] = {}
        coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in words] for _, words in items]
        self.vocabulary = pa.array(list(vocabulary), pa.large_binary())
        self.words = max(1, len(vocabulary))
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        follow, link, length = self._grow(coded)
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        keys = np.array([s * self.words + w for s, own in enumerate(follow) for w in own], np.int64)
        to = np.array([t for own in follow for t in own.values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.first = np.zeros(self.words, np.int64)  # the state after one word
        for w, t in follow[0].items():
            self.first[w] = t
        self._windows(coded, [number.get(name, -1) for name, _ in items], follow)

    @staticmethod
    def _grow(coded: list[list[int]]) -> tuple[list[dict[int, int]], list[int], list[int]]:
        follow: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def state(deep: int, own: dict[int, int], up: int) -> int:
            follow.append(own)
            length.append(deep)
            link.append(up)
            return len(link) - 1

        def split(p: int, w: int) -> int:
            """The state of exactly the sequence of p and w, apart from longer ones."""
            q = follow[p][w]
            if length[q] == length[p] + 1:
                return q
            twin = state(length[p] + 1, dict(follow[q]), link[q])
            link[q] = twin
            while p >= 0 and follow[p].get(w) == q:
                follow[p][w] = twin
                p = link[p]
            return twin

        for words in coded:
            last = 0
            for w in words:
                if w in follow[last]:
                    last = split(last, w)
                    continue
                new, p = state(length[last] + 1, {}, 0), last
                while p >= 0 and w not in follow[p]:
                    follow[p][w] = new
                    p = link[p]
                if p >= 0:
                    link[new] = split(p, w)
                last = new
        return follow, link, length

    def _windows(self, coded: list[list[int]], numbers: list[int], follow: list[dict[int, int]]) -> None:
        """window[s]: the state of the last `width` words of s's sequences, -1 where they are shorter.
        Items of windows, and whole short items, as lists by state."""
        self.window = np.full(len(self.link), -1, np.int32)
        for s in np.argsort(self.length, kind="stable"):
            if self.length[s] >= self.width:
                up = self.link[s]
                self.window[s] = s if self.length[up] < self.width else self.window[up]
        held: set[tuple[int, int]] = set()
        short: set[tuple[int, int, int]] = set()
        for words, name in zip(coded, numbers, strict=True):
            s = 0
            for n, w in enumerate(words, 1):
                s = follow[s][w]
                if n >= self.width:
                    held.add((int(self.window[s]), name))
            if 0 < len(words) < self.width:
                short.add((s, len(words), name))
        self.held_from, self.held = self._lists([(s, i) for s, i in held if i >= 0])
        self.short_from, self.short = self._lists(list(short))
        # the nearest state up the links, itself included, that has short items
        self.shorts = np.full(len(self.link), -1, np.int32)
        has = np.diff(self.short_from) > 0
        for s in np.argsort(self.length, kind="stable") if has.any() else []:
            self.shorts[s] = s if has[s] else self.shorts[self.link[s]] if s else -1
        self.least = min([self.width] * bool(held) + [n for _, n, _ in short], default=0)

    def _lists(self, pairs: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.array(sorted(pairs), np.int64).reshape(len(pairs), -1) if pairs else np.zeros((0, 3), np.int64)
        return np.searchsorted(rows[:, 0], np.arange(len(self.link) + 1)), rows[:, 1:]

    def _has(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.to[at]

    def lengths(self, codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, state, matching length) at every word of the runs that can hold a window. codes:
        words by number, -1 for words that no item has; rows: the text of each."""
        known = codes >= 0
        joined = np.zeros(len(codes), bool)
        pair = np.flatnonzero(known[1:] & known[:-1] & (rows[1:] == rows[:-1])) + 1
        joined[pair] = self._has(self.first[codes[pair - 1]] * self.words + codes[pair])[0]
        starts = np.flatnonzero(known & ~joined)
        ends = np.append(np.flatnonzero(~joined), len(codes))
        ends = ends[np.searchsorted(ends, starts, side="right")]
        long = ends - starts >= self.least
        order = np.argsort(-(ends - starts)[long], kind="stable")
        starts, left = starts[long][order], (ends - starts)[long][order]
        place = np.zeros(int(left.sum()), np.int64)
        states, reached = place.copy(), place.copy()
        state, deep = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        out = 0
        for step in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -step, side="left"))  # the runs that are longer than step
            word = codes[starts[:n] + step]
            todo = np.arange(n)
            while len(todo):
                found, to = self._has(state[todo] * self.words + word[todo])
                on = todo[found]
                state[on], deep[on] = to[found], deep[on] + 1
                todo = todo[~found]
                state[todo] = self.link[state[todo]]
                deep[todo] = self.length[state[todo]]
            place[out : out + n], states[out : out + n], reached[out : out + n] = starts[:n] + step, state[:n], deep[:n]
            out += n
        return place, states, reached

    def leaks(self, text: pa.Array) -> pa.Array:
        """For each text: its number of words, the spans of words inside windows, the items."""
        runs, n = words_of(text), len(text)
        codes = pc.fill_null(pc.index_in(runs.words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if not self.least:
            place = state = deep = np.zeros(0, np.int64)
        else:
            place, state, deep = self.lengths(codes, runs.rows)
        full = deep >= self.width
        covered = np.zeros(len(codes) + 1, np.int64)
        np.add.at(covered, place[full] - self.width + 1, 1)
        np.add.at(covered, place[full] + 1, -1)
        own = np.unique(runs.rows[place[full]] * len(self.link) + self.window[state[full]])
        row, s = own // len(self.link), own % len(self.link)
        sizes = self.held_from[s + 1] - self.held_from[s]
        named = [np.stack([np.repeat(row, sizes), self.held[ragged(self.held_from[s], sizes), 0]])]
        at = self.shorts[state]
        while (at >= 0).any():
            place, deep, at = place[at >= 0], deep[at >= 0], at[at >= 0]
            sizes = self.short_from[at + 1] - self.short_from[at]
            size, name = self.short[ragged(self.short_from[at], sizes)].T
            end, fits = np.repeat(place, sizes), size <= np.repeat(deep, sizes)
            np.add.at(covered, end[fits] - size[fits] + 1, 1)
            np.add.at(covered, end[fits] + 1, -1)
            fits &= name >= 0
            named.append(np.stack([runs.rows[end[fits]], name[fits]]))
            at = self.shorts[self.link[at]]
        hit = np.cumsum(covered)[:-1] > 0
        edge = np.diff(runs.rows, prepend=-1) > 0
        begins = hit & (edge | ~np.append(False, hit[:-1])) if len(hit) else hit
        stops = hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False)) if len(hit) else hit
        a, b = np.flatnonzero(begins), np.flatnonzero(stops)
        counts = np.bincount(runs.rows, minlength=n)
        before = np.cumsum(counts) - counts  # words ahead of each text
        first = stream(text)[1]
        r = runs.rows[a]
        spans = pa.StructArray.from_arrays([pa.array(x) for x in (a - before[r], b + 1 - before[r], runs.starts[a] - first[r], runs.ends[b] - first[r])], ["word_from", "word_to", "byte_from", "byte_to"])
        row, name = np.unique(np.concatenate(named, 1), axis=1)
        items = pa.array(self.names, pa.string()).take(pa.array(name))
        lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(x, np.arange(n + 1)).astype(np.int32)), v) for x, v in ((r, spans), (row, items))]
        return pa.StructArray.from_arrays([pa.array(counts.astype(np.int64)), *lists], ["n_words", "spans", "items"])


def _items(benchmark: DataFrame, width: int, most: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in groups of at most `most` words, streamed from the executors."""
    held, size = [], 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = words_of(pa.array([text], pa.string())).words.to_pylist()
        step = max(1, most - width + 1)
        for at in range(0, max(1, len(words) - width + 1), step):
            part = words[at : at + step + width - 1]
            if held and size + len(part) > most:
                yield held
                held, size = [], 0
            if part:
                held.append((name, part))
                size += len(part)
    if held:
        yield held


def _merged(parts: list[Column]) -> Column:
    """The union of several lists of spans."""
    if len(parts) == 1:
        return parts[0]

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["word_from"].alias("word_from"), F.greatest(last["word_to"], span["word_to"]).alias("word_to"), last["byte_from"].alias("byte_from"), F.greatest(last["byte_to"], span["byte_to"]).alias("byte_to"))
        joins = (F.size(done) > 0) & (span["word_from"] <= F.try_element_at(done, F.lit(-1))["word_to"])
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(F.concat(*parts)), F.array().cast(f"array<{SPAN}>"), add)


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MOST, groups: int = GROUPS, name: str = "leak") -> DataFrame:
    """docs with a column `name` of n_words, spans (in words and bytes) and items."""
    spark, text = docs.sparkSession, F.col("text")

    def column(items: list) -> Column:
        shared = spark.sparkContext.broadcast(Automaton(items, width))
        return text_udf(lambda batch: shared.value.leaks(batch.column("text")), LEAKS)(text)

    def joined(found: list[Column]) -> Column:
        items = F.array_sort(F.array_distinct(F.concat(*(x["items"] for x in found))))
        return F.struct(found[0]["n_words"].alias("n_words"), _merged([x["spans"] for x in found]).alias("spans"), items.alias("items"))

    pending: list[Column] = []
    marked = docs
    for items in _items(benchmark, width, most):
        if len(pending) == groups:
            before = [F.col(name)] if name in marked.columns else []
            marked = materialize(marked.withColumn(name, joined(before + pending)))
            pending = []
        pending.append(column(items))
    before = [F.col(name)] if marked is not docs else []
    return marked.withColumn(name, joined(before + (pending or [] if before else pending or [column([])])))


def decontaminate(docs: DataFrame, benchmark: DataFrame, longest: int = WIDTH, coverage: float = 0.5, width: int = WIDTH) -> DataFrame:
    """docs without the spans of `longest` words or more that windows cover; documents of whose words
    the windows cover more than the share `coverage` go whole."""
    name = "leak"
    while name in docs.columns:
        name += "_"
    marked = leaks(docs, benchmark, width, name=name)
    spans = F.col(f"{name}.spans")
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["word_to"] - x["word_from"])
    cut = F.filter(spans, lambda x: x["word_to"] - x["word_from"] >= longest)
    kept = marked.where(hit <= coverage * F.col(f"{name}.n_words"))
    raw = F.col("text").cast("binary")
    # the bytes between one cut span and the next
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda x: x["byte_to"]))
    begins = F.concat(F.transform(cut, lambda x: x["byte_from"]), F.array(F.octet_length("text").cast("long")))
    parts = F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda x: F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")).cast("string"))
    text = F.when(F.size(cut) > 0, F.concat_ws("", parts)).otherwise(F.col("text"))
    return kept.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: words, words hit and the items that it holds."""
    own = leaks(docs.select("doc_id", "text"), benchmark).select("doc_id", "leak.*")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["word_to"] - x["word_from"])
    listed = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return own.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (hit > 0).alias("contaminated"))
