"""Operator 12: phrase collocation mining by stripes.

A stripe belongs to a prefix of words and counts the words that follow it: next word -> count, and
`rest` for occurrences that end a piece or go on with a word that no candidate can have. Tasks build
stripes of their slices of text, stripes of one prefix are added elementwise, and the sum yields all
that is wanted of the prefix: its extensions (entries of at least `least`), its own count (entries
and rest) and the count of its most frequent extension, which decides what it is subsumed by.

Words are counted first, as a phrase cannot be more frequent than its parts. Stripes of one-word
prefixes hold frequent words only, stripes of two-word prefixes frequent pairs only; which those are,
tasks read off a bitmap of hashes. Its size is fixed; a word or pair that shares a bit with a frequent
one is counted in vain and dropped by its exact count, so bitmaps steer cost and never results.
Prefixes with HOT occurrences or more have their stripes cut by the hash of the next word into PARTS,
so no task holds all that follows a common word; a second bitmap says which.

Null and empty texts have no words; a null language is `und`. Repeated rows count each. Equal scores
are ranked by count, then by phrase in byte order. A giant text is cut at the ends of pieces. An empty
table gives no rows. Other columns are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bytewise import Runs, stream
from .common import give_back, materialize, mix, slices, together

LEAST, SHARE, TOP = 10, 50, 2000
#: Text bytes whose stripes a task builds at once.
SLICE = 6 << 20
#: Bits of the bitmaps of frequent words and pairs.
WORD_BITS, PAIR_BITS = 1 << 25, 1 << 27
HOT, PARTS = 1 << 15, 32
#: Sets of rows that are ranked apart before the last ranking.
RANKED_APART = 16

#: Bytes that end a piece, and bytes of words: all but those, space and tab.
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
INSIDE = ~BREAK
INSIDE[list(b" \t")] = False

STRIPES = "lang string, prefix string, part int, rest long, nexts string, counts array<int>"
MERGED = "lang string, prefix string, total long, most long, nexts array<string>, counts array<long>, marks array<long>"
_P = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a block: id of each, whether the next word follows in its piece; language, word and
    hash of each id."""

    def __init__(self, raw: np.ndarray, rows: np.ndarray, lang: pa.DictionaryArray):
        runs = Runs(raw, rows, INSIDE)
        coded = runs.words.dictionary_encode()
        of_lang = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[runs.rows]
        width = max(1, len(coded.dictionary))
        own, ids = np.unique(of_lang * width + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        self.ids: np.ndarray = ids.astype(np.int64)
        self.lang = lang.dictionary.take(pa.array(own // width))
        self.word = coded.dictionary.take(pa.array(own % width))
        pieces = np.cumsum(BREAK[raw])[runs.starts]
        self.follows = np.zeros(len(ids), bool)
        self.follows[:-1] = (runs.rows[1:] == runs.rows[:-1]) & (pieces[1:] == pieces[:-1])

    def hashes(self) -> np.ndarray:
        return hashes(self.lang, self.word)


def hashes(lang: pa.Array, word: pa.Array) -> np.ndarray:
    """As Spark's xxhash64(lang, word): the hash of the language is the seed of the word's."""
    coded = lang.dictionary_encode()
    seeds = [xxhash.xxh64_intdigest(x, 42) for x in coded.dictionary.cast(pa.large_binary()).to_pylist()]
    words = word.cast(pa.large_binary()).to_pylist()
    return np.fromiter((xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(words, coded.indices.to_pylist(), strict=True)), np.uint64, len(words))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _P + b)


class Bits:
    """A bitmap of hashes, of fixed size, in as many bytes as an eighth of its bits."""

    def __init__(self, df: DataFrame, h: Column, bits: int):
        self.bits = bits
        at = F.pmod(h, F.lit(bits))
        block = 1 << 15  # of Spark's bitmaps
        rows = df.select(at.alias("h")).groupBy(F.floor(F.col("h") / block).alias("block")).agg(F.bitmap_construct_agg(F.col("h") % block).alias("bits"))
        self.bytes = np.zeros(bits // 8, np.uint8)
        for row in rows.toLocalIterator():
            own = np.frombuffer(row["bits"], np.uint8)
            self.bytes[row["block"] * (block // 8) :][: len(own)] = own

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(self.bits - 1)).astype(np.int64)
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Words]:
    """The words of about `most` bytes of text at a time; a giant text is cut where pieces end."""
    for batch in together(batches, most=most):
        for part in slices(batch, most=most):
            raw, rows = stream(part.column("text"))
            lang = pc.fill_null(part.column("lang"), "und").dictionary_encode()
            at = 0
            while len(lang) == 1 and len(raw) - at > 2 * most:
                span, found = most, np.zeros(0, np.int64)
                while not len(found) and at + span < len(raw):
                    found = np.flatnonzero(BREAK[raw[at + span : at + 2 * span]]) + at + span + 1
                    span *= 2
                to = int(found[0]) if len(found) else len(raw)
                yield Words(raw[at:to], np.array([0, to - at]), lang)
                at = to
            yield Words(raw[at:], rows if not at else np.array([0, len(raw) - at]), lang)


def _joined(words: pa.Array, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Per run of ids, their words with spaces between. starts: of the runs, and the end."""
    lists = pa.LargeListArray.from_arrays(pa.array(starts.astype(np.int64)), words.take(pa.array(ids)))
    return pc.binary_join(lists, pa.scalar(b" ", words.type)).cast(pa.large_string()).cast(pa.string())


def stripes(prefix: np.ndarray, follower: np.ndarray, hot: np.ndarray, words: Words, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of occurrences of prefixes with the word that follows (-1: none that counts), the stripes:
    prefix, part, rest, nexts, counts. hot: by prefix."""
    n, m = max(1, len(words.word)), len(hot)
    own = follower >= 0
    keys, counts = np.unique(prefix[own] * n + follower[own], return_counts=True)
    of, nexts = keys // n, keys % n
    part = np.where(hot[of], (h[nexts] % np.uint64(PARTS)).astype(np.int64), 0)
    order = np.argsort(of * PARTS + part, kind="stable")
    of, nexts, part, counts = of[order], nexts[order], part[order], counts[order]
    starts = np.flatnonzero(np.diff(of * PARTS + part, prepend=-1))
    rest = np.bincount(prefix, minlength=m)
    np.subtract.at(rest, of, counts)
    first = np.diff(of[starts], prepend=-1) > 0
    of_rows = np.where(first, rest[of[starts]], 0)
    alone = rest > 0
    alone[of] = False
    alone = np.flatnonzero(alone)
    prefixes, parts = np.append(of[starts], alone), np.append(part[starts], np.zeros(len(alone), np.int64))
    ends = np.concatenate([starts, np.full(len(alone) + 1, len(of))])
    texts = _joined(words.word, nexts, ends)
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(counts.astype(np.int32)))
    return prefixes, pa.array(parts.astype(np.int32)), pa.array(np.append(of_rows, rest[alone])), texts, lists


def word_stripes(words: Words, frequent: Bits, hot: Bits) -> pa.RecordBatch:
    """Stripes of the frequent words."""
    h = words.hashes()
    good = frequent.has(h)
    ids = words.ids
    ahead = np.append(ids[1:], 0) if len(ids) else ids
    own = good[ids]
    follower = np.where(words.follows & good[ahead], ahead, -1) if len(ids) else ids
    of, *rest = stripes(ids[own], follower[own], hot.has(h), words, h)
    return pa.RecordBatch.from_arrays([words.lang.take(pa.array(of)), words.word.take(pa.array(of)).cast(pa.large_string()).cast(pa.string()), *rest], ["lang", "prefix", "part", "rest", "nexts", "counts"])


def pair_stripes(words: Words, frequent: Bits, hot: Bits, pairs: Bits, hot_pairs: Bits) -> pa.RecordBatch:
    """Stripes of the frequent pairs of words; the next word ends a frequent pair too."""
    h, ids = words.hashes(), words.ids
    good = frequent.has(h)
    at = np.flatnonzero(words.follows)
    at = at[good[ids[at]] & good[ids[at + 1]]]
    mark = pair_hashes(h[ids[at]], h[ids[at + 1]])
    fine = pairs.has(mark)
    at, mark = at[fine], mark[fine]
    n = max(1, len(h))
    keys, first, own = np.unique(ids[at] * n + ids[at + 1], return_index=True, return_inverse=True)
    good_at = np.zeros(len(ids) + 1, bool)
    good_at[at] = True
    follower = np.where(good_at[at + 1], ids[np.minimum(at + 2, len(ids) - 1)] if len(ids) else at, -1)
    of, *rest = stripes(own.astype(np.int64), follower, hot_pairs.has(mark[first]), words, h)
    a, b = keys[of] // n, keys[of] % n
    both = np.stack([a, b], 1).ravel()
    prefix = _joined(words.word, both, np.arange(0, len(both) + 1, 2))
    return pa.RecordBatch.from_arrays([words.lang.take(pa.array(a)), prefix, *rest], ["lang", "prefix", "part", "rest", "nexts", "counts"])


def added(rows: pa.Table) -> pa.Table:
    """Stripes of one (lang, prefix, part) added elementwise; equal keys stand together."""
    keys = [rows.column(c).combine_chunks() for c in ("lang", "prefix", "part")]
    new = np.ones(len(rows), bool)
    new[1:] = np.logical_or.reduce([pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False) for k in keys]) if len(rows) > 1 else new[1:]
    run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    rest = np.add.reduceat(rows.column("rest").to_numpy(), starts)
    lists = rows.column("counts").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = pc.split_pattern(rows.column("nexts").filter(pa.array(sizes > 0)).combine_chunks(), " ").flatten().dictionary_encode()
    counts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = max(1, len(flat.dictionary))
    entry = np.repeat(run, sizes) * n + flat.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(entry, kind="stable")
    entry = entry[order]
    first = np.flatnonzero(np.diff(entry, prepend=-1))
    sums = np.add.reduceat(counts[order], first) if len(first) else counts
    of, nexts = entry[first] // n, entry[first] % n
    ends = np.searchsorted(of, np.arange(len(starts) + 1))
    words = flat.dictionary.cast(pa.large_binary())
    return pa.table({"lang": keys[0].take(pa.array(starts)), "prefix": keys[1].take(pa.array(starts)), "part": keys[2].take(pa.array(starts)), "rest": pa.array(rest), "nexts": _joined(words, nexts, ends), "counts": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sums))})


def _extensions(rows: pa.Table, least: int, marked: bool) -> pa.RecordBatch:
    """Of summed stripes: total, greatest count, and the entries of at least `least` with hashes of the pair."""
    lists = rows.column("counts").combine_chunks()
    counts, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), sizes)
    total, most = rows.column("rest").to_numpy().copy(), np.zeros(len(rows), np.int64)
    np.add.at(total, of, counts)
    np.maximum.at(most, of, counts)
    keep = counts >= least
    words = pc.split_pattern(rows.column("nexts").filter(pa.array(sizes > 0)).combine_chunks(), " ").flatten().filter(pa.array(keep))
    of = of[keep]
    if marked:
        lang, prefix = (rows.column(c).combine_chunks() for c in ("lang", "prefix"))
        marks = pair_hashes(hashes(lang, prefix)[of], hashes(lang.take(pa.array(of)), words)).view(np.int64)
    else:
        marks = np.zeros(len(of), np.int64)
    ends = pa.array(np.searchsorted(of, np.arange(len(rows) + 1)).astype(np.int32))
    out = [pa.ListArray.from_arrays(ends, x) for x in (words, pa.array(counts[keep]), pa.array(marks))]
    return pa.RecordBatch.from_arrays([rows.column("lang").combine_chunks(), rows.column("prefix").combine_chunks(), pa.array(total), pa.array(most), *out], ["lang", "prefix", "total", "most", "nexts", "counts", "marks"])


def merged(found: DataFrame, least: int, marked: bool = False) -> DataFrame:
    """The sum of all stripes by prefix and part, as totals and extensions: rows arrive in the order of
    their keys, a key's sum so far is all that a task keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            own = own.set_column(own.schema.get_field_index("counts"), "counts", own.column("counts").cast(pa.list_(pa.int64())))
            rows = added(pa.concat_tables([held, own.select(held.column_names).cast(held.schema)]) if held is not None else own)
            held = rows.slice(len(rows) - 1)
            if len(rows) > 1:
                yield _extensions(rows.slice(0, len(rows) - 1), least, marked)
        if held is not None:
            yield _extensions(held, least, marked)
        give_back()

    keys = ["lang", "prefix", "part"]
    return found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, MERGED)


def _over(docs: DataFrame, work: Callable[[Words], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in blocks(batches, SLICE):
            yield work(words)
        give_back()

    return docs.select("lang", "text").mapInArrow(run, schema)


def _word_counts(words: Words) -> pa.RecordBatch:
    counts = np.bincount(words.ids, minlength=len(words.word)).astype(np.int64)
    return pa.RecordBatch.from_arrays([words.lang, words.word.cast(pa.large_string()).cast(pa.string()), pa.array(counts)], ["lang", "word", "f"])


def _entries(rows: DataFrame) -> DataFrame:
    zipped = F.explode(F.arrays_zip("nexts", "counts", "marks")).alias("x")
    return rows.select("lang", "prefix", zipped).select("lang", "prefix", F.col("x.nexts").alias("next"), F.col("x.counts").alias("a"), F.col("x.marks").alias("mark"))


def phrases(docs: DataFrame, least: int = LEAST, share: int = SHARE, hot: int = HOT) -> DataFrame:
    """Every phrase of two or three words with its counts and score that no longer phrase subsumes:
    lang, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    words = materialize(_over(docs, _word_counts, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    h = F.xxhash64("lang", "word")
    frequent = spark.sparkContext.broadcast((Bits(words.where(F.col("f") >= least), h, WORD_BITS), Bits(words.where(F.col("f") >= hot), h, WORD_BITS)))
    ones = materialize(merged(_over(docs, lambda w: word_stripes(w, *frequent.value), STRIPES), least, True))
    pairs = _entries(ones)
    mark = F.col("mark")
    both = spark.sparkContext.broadcast((Bits(pairs, mark, PAIR_BITS), Bits(pairs.where(F.col("a") >= hot), mark, WORD_BITS)))
    twos = materialize(merged(_over(docs, lambda w: pair_stripes(w, *frequent.value, *both.value), STRIPES), least))
    # a prefix's own count and its most frequent extension; parts of hot prefixes add up
    of = lambda rows: rows.groupBy("lang", "prefix").agg(F.sum("total").alias("total"), F.max("most").alias("most"))
    one, two = of(ones), of(twos)

    def count(table: DataFrame, key: str, name: str) -> DataFrame:
        return table.select("lang", F.col("prefix").alias(key), F.col("total").alias(name))

    score = lambda a, l, r: F.expr(f"cast(cast({a} as decimal(16,0)) * {a} * 1000000 div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0))) as bigint)")  # noqa: E731,E741
    short = pairs.select("lang", "prefix", F.col("next").alias("last"), "a").withColumn("phrase", F.concat_ws(" ", "prefix", "last"))
    short = short.join(count(one, "prefix", "l"), ["lang", "prefix"]).join(count(one, "last", "r"), ["lang", "last"])
    triples = _entries(twos).select("lang", "prefix", F.col("next").alias("last"), "a").withColumn("phrase", F.concat_ws(" ", "prefix", "last"))
    triples = triples.withColumn("head", F.substring_index("prefix", " ", 1)).withColumn("tail", F.concat_ws(" ", F.substring_index("prefix", " ", -1), "last"))
    left = triples.groupBy("lang", F.col("tail").alias("phrase")).agg(F.max("a").alias("before"))
    right = two.select("lang", F.col("prefix").alias("phrase"), F.col("most").alias("after"))
    longest = F.greatest(F.coalesce("before", F.lit(0)), F.coalesce(F.when(F.col("after") >= least, F.col("after")), F.lit(0)))
    free = short.join(left, ["lang", "phrase"], "left").join(right, ["lang", "phrase"], "left").where(100 * longest < share * F.col("a"))
    free = free.select("lang", "phrase", "a", "l", "r", score("a", "l", "r").alias("score"))
    triples = triples.join(count(one, "head", "l1"), ["lang", "head"]).join(count(two, "tail", "r1"), ["lang", "tail"])
    triples = triples.join(count(two, "prefix", "l2"), ["lang", "prefix"]).join(count(one, "last", "r2"), ["lang", "last"])
    triples = triples.withColumn("s1", score("a", "l1", "r1")).withColumn("s2", score("a", "l2", "r2"))
    pick = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    triples = triples.select("lang", "phrase", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), F.least("s1", "s2").alias("score"))
    return free.unionByName(triples).join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def top_phrases(docs: DataFrame, top: int = TOP, **how) -> DataFrame:
    """Each language's first `top` phrases. Sets of rows are ranked apart first, so that the last
    ranking of a language gets a bounded number."""
    by = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    own = phrases(docs, **how).withColumn("set", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART)))
    some = own.withColumn("rank", F.row_number().over(W.partitionBy("lang", "set").orderBy(*by))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
