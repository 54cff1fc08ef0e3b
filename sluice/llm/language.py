"""Operator 9: language identification of mixed-language text.

Scripts narrow the candidates: a word's letters lie in script ranges, and only languages whose
training text uses that script compete for it. A word's score for a language is the smoothed log
probability of its character n-grams there, counted over all training documents. Viterbi over the
words of a text, with a penalty for each switch, labels spans; the language with the most letters
in its spans is the document's, its share of the letters the score.

Null texts and texts without a letter are `und` with score 0. Rows without a language are not
learnt from; without any labelled row every text is `und`. A language is any string, the empty
one included; the model takes 128 KB for each. Letters are characters of the class L; marks belong
to the n-grams of a word with letters and count for nothing else. Repeated rows are labelled alike;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Grams, Words, fold, give_back, slices, text_udf, together

LOW, HIGH, BUCKETS = 1, 4, 1 << 15
#: Cost of a switch of language between two words, in natural log units.
SWITCH = 6.0
#: Share of a language's letters from which it counts as written in a script.
SCRIPT_SHARE = 0.005
#: Text bytes handled at once.
SLICE = 1 << 20
HELD_OUT = (5, 0)
UNKNOWN = "und"

# First and last code point of script ranges, and the script's number.
SCRIPTS = [
    (0x0041, 0x024F, 1),  # Latin
    (0x0370, 0x03FF, 2),  # Greek
    (0x0400, 0x052F, 3),  # Cyrillic
    (0x0530, 0x058F, 4),  # Armenian
    (0x0590, 0x05FF, 5),  # Hebrew
    (0x0600, 0x077F, 6),  # Arabic
    (0x0900, 0x097F, 7),  # Devanagari
    (0x0980, 0x09FF, 8),  # Bengali
    (0x0B80, 0x0BFF, 9),  # Tamil
    (0x0E00, 0x0E7F, 10),  # Thai
    (0x10A0, 0x10FF, 11),  # Georgian
    (0x1100, 0x11FF, 12),  # Hangul letters
    (0x1E00, 0x1EFF, 1),  # Latin, additional
    (0x1F00, 0x1FFF, 2),  # Greek, extended
    (0x3040, 0x30FF, 13),  # Kana
    (0x3400, 0x9FFF, 14),  # Han
    (0xAC00, 0xD7AF, 12),  # Hangul syllables
]
N_SCRIPTS = 15


def letters_of(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words without what is neither letter nor mark, empty without a letter; and their letters' number."""
    kept = pc.replace_substring_regex(words, r"[^\pL\pM]+", "")
    marked = pc.match_substring_regex(kept, r"\pM")
    plain = pc.replace_substring_regex(kept, r"\pM+", "") if pc.any(marked).as_py() else kept
    lengths = pc.utf8_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.if_else(pa.array(lengths > 0), kept, ""), lengths


_LOWS, _HIGHS, _NUMBERS = (np.array(x) for x in zip(*SCRIPTS, strict=True))


def script_of(grams: Grams) -> np.ndarray:
    """Number of the script with the most characters of each word, 0 for others and for empty words;
    of equally many the smallest number."""
    points = grams.points.astype(np.int64)
    at = np.searchsorted(_LOWS, points, side="right") - 1
    numbers = np.where((at >= 0) & (points <= _HIGHS[at]), _NUMBERS[at], 0)
    per_word = np.bincount(np.repeat(np.arange(len(grams.lengths)), grams.lengths) * N_SCRIPTS + numbers, minlength=len(grams.lengths) * N_SCRIPTS).reshape(-1, N_SCRIPTS)
    return np.where(per_word[:, 1:].any(1), per_word[:, 1:].argmax(1) + 1, 0)


class Lettered:
    """Words of texts in lower case, with their letters, gram tables and scripts."""

    def __init__(self, text: pa.Array):
        self.words = Words(pc.utf8_lower(pc.fill_null(text, "")), lower=False)
        letters, self.lengths = letters_of(self.words.distinct)
        self.grams = Grams(letters, LOW, HIGH, BUCKETS)
        self.scripts = script_of(self.grams)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows: n-gram counts, and letters per script above BUCKETS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in together(batches, most=SLICE):
            for part in slices(batch, most=SLICE):
                own = Lettered(part.column("text"))
                coded = part.column("lang").dictionary_encode()
                lang_of_word = coded.indices.to_numpy(zero_copy_only=False)[own.words.rows]
                per_lang = []
                for code, lang in enumerate(coded.dictionary.to_pylist()):
                    uses = np.bincount(own.words.codes[lang_of_word == code], minlength=len(own.lengths)) * (own.lengths > 0)
                    per_lang.append((totals.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS)), uses))
                owner = np.repeat(np.arange(len(own.lengths), dtype=np.int32), own.grams.lengths)
                for ids, fits in own.grams.levels():
                    ids, of = ids[fits], owner[fits]
                    for total, uses in per_lang:
                        total[:BUCKETS] += np.bincount(ids, uses[of], BUCKETS)
                for total, uses in per_lang:
                    total[BUCKETS:] += np.bincount(own.scripts, uses * own.lengths, N_SCRIPTS)
        for lang, total in totals.items():
            there = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(total[there].astype(np.int64))], ["lang", "bucket", "n"])
        give_back()

    counted = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (BUCKETS, languages)
    allowed: np.ndarray  # (N_SCRIPTS, languages)


def fit(docs: DataFrame, modulus: int = HELD_OUT[0], remainder: int = HELD_OUT[1]) -> Model:
    """Learn from all rows outside the held-out fold. What comes to the driver is bounded by BUCKETS
    and the number of languages."""
    own = docs.where(fold(F.col("doc_id"), modulus) != remainder)
    names = sorted(r["lang"] for r in own.where("text is not null and lang is not null").select("lang").distinct().toLocalIterator())
    table = np.zeros((BUCKETS + N_SCRIPTS, len(names)))
    got = count_grams(own).toArrow()
    at = pc.index_in(got.column("lang"), pa.array(names, pa.string()))
    table[got.column("bucket").to_numpy(), at.to_numpy()] = got.column("n").to_numpy()
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    log_p = np.log((grams + 0.2) / (grams.sum(0) + 0.2 * BUCKETS)) if names else np.zeros((BUCKETS, 0))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0))
    allowed[~allowed.any(1)] = True
    return Model(names, log_p.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best state per word, for all texts at once: one step serves the n-th word of every text."""
    path = np.zeros(len(scores), np.int64)
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    active = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), side="left")
    stay = np.ones(scores.shape, bool)
    best_before = np.zeros(len(scores), np.int16)
    value = scores[starts[: active[0]]].copy() if len(active) else None
    for t in range(1, len(active)):
        m = active[t]
        value = value[:m]
        at = starts[:m] + t
        top = value.argmax(1)
        jump = value[np.arange(m), top] - penalty
        best_before[at] = top
        stay[at] = value >= jump[:, None]
        value = np.maximum(value, jump[:, None]) + scores[at]
        # a text's last value is kept by writing the path's end as it leaves
        ends = counts[:m] == t + 1
        path[at[ends]] = value[ends].argmax(1)
    if len(active):
        single = counts == 1
        path[starts[single]] = scores[starts[single]].argmax(1)
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        state = path[at]
        path[at - 1] = np.where(stay[at, state], state, best_before[at])
    return path


def label_words(own: Lettered, model: Model, penalty: float = SWITCH) -> np.ndarray:
    """The language number of every word."""
    score = own.grams.sums(model.log_p) / HIGH
    score = np.where(model.allowed[own.scripts], score, score - 50.0)
    score[own.lengths == 0] = 0
    return viterbi(score[own.words.codes], own.words.starts, own.words.counts, penalty)


def predictor(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """(lang, share) as a function of a text column: the language with the most letters and its share."""
    shared = spark.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.Array:
        model, own = shared.value, Lettered(part.column("text"))
        n = part.num_rows
        if model.languages:
            path = label_words(own, model)
            share = np.bincount(own.words.rows * len(model.languages) + path, own.lengths[own.words.codes], n * len(model.languages)).reshape(n, -1)
            total, top = share.sum(1), share.argmax(1)
            names = pa.array([*model.languages, UNKNOWN]).take(pa.array(np.where(total > 0, top, len(model.languages))))
            score = share.max(1) / np.maximum(1, total)
        else:
            names, score = pa.array([UNKNOWN] * n, pa.string()), np.zeros(n)
        return pa.StructArray.from_arrays([names, pa.array(score)], ["lang", "share"])

    return text_udf(work, "lang string, share double", SLICE)


def spans(text: str, model: Model, penalty: float = SWITCH) -> list[tuple[str, str]]:
    """The language spans of one text as (language, words)."""
    own = Lettered(pa.array([text]))
    path, words = label_words(own, model, penalty), own.words.distinct.to_pylist()
    found: list[tuple[str, str]] = []
    for code, state in zip(own.words.codes, path, strict=True):
        lang = model.languages[state]
        if found and found[-1][0] == lang:
            found[-1] = (lang, f"{found[-1][1]} {words[code]}")
        else:
            found.append((lang, words[code]))
    return found


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs."""
    found = docs.select("doc_id", predictor(docs.sparkSession, fit(docs))(F.col("text")).alias("found"))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.share").alias("score"))
