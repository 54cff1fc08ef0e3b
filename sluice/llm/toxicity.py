"""Operator 2: toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams, a text the mean of its words, and a
linear softmax reads the text's vector; vectors and softmax are trained jointly in numpy. Unseen
misspellings share n-grams with known words. Learning uses a bounded, hash-ordered sample of the
labelled rows of each class; the bias is then set back to the
classes' true shares. Every document is scored over its whole text.

Null and empty texts score as a text without words: by the bias alone. Repeated rows are scored
alike. Labels that are null or whose document is missing are not learnt from; without both
classes the score is the share of the one there is (0 without labels). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Grams, Words, fold, give_back, materialize, ragged, slices, text_udf, together, views

LOW, HIGH, BUCKETS, DIM = 4, 6, 1 << 16, 8
#: Blank words that each average counts besides the text's own, so that a few words alone say little.
PAD = 30
#: Labelled documents learnt from, at most: clean and toxic ones. Buckets fit 16 bits.
SAMPLE = (4000, 2000)
#: Text bytes learnt from, at most, per class; a byte of text gives up to 18 bytes at the driver.
SAMPLE_BYTES = (24 << 20, 12 << 20)
#: Steps of training; small samples are gone through more often.
STEPS, BATCH, RATE, GAIN, DECAY = 660, 64, 0.01, 30.0, 1e-4
THRESHOLD = 0.5
HELD_OUT = (5, 0)


def labelled_sample(labels: DataFrame, label: str, modulus: int, remainder: int, most: tuple[int, int]) -> DataFrame:
    """doc_id and label of at most most[y] learning rows of each class y, in hash order."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), modulus) != remainder))
    parts = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y]) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def bounded_texts(docs: DataFrame, chosen: DataFrame, most: tuple[int, int]) -> DataFrame:
    """text and y of the chosen documents, in each class y as many in hash order as stay within
    most[y] bytes of text together. Of a text that alone takes over a sixteenth of them a part stands
    for it, from a place that a hash draws; its 64th of characters has a sixteenth of the bytes at
    most. chosen is bounded in rows, so its join partner is small."""
    limit = F.when(F.col("y") == 0, most[0]).otherwise(most[1])
    part = (limit / 64).cast("int")
    start = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.length("text") - part, F.lit(1))).cast("int") + 1
    text = F.when(F.octet_length("text") > limit / 16, F.substring("text", start, part)).otherwise(F.col("text"))
    given = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select(text.alias("text"), "y", F.xxhash64("doc_id").alias("h"))
    drawn = materialize(given.withColumn("size", F.octet_length("text").cast("long")))
    upto = F.sum("size").over(W.partitionBy("y").orderBy("h", "size", F.xxhash64("text")).rowsBetween(W.unboundedPreceding, 0))
    last = drawn.select("y", "h", "size", upto.alias("upto")).groupBy("y").agg(F.max(F.when(F.col("upto") <= limit, F.col("h"))).alias("last"))
    return drawn.join(F.broadcast(last), "y").where("h <= last").select("text", "y")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its words and blanks, the buckets of its n-grams and each one's uses, a word counting one."""
    for batch in together(batches):
        for part in slices(batch):
            words = Words(part.column("text"))
            grams = Grams(words.distinct, LOW, HIGH, BUCKETS)
            sizes = grams.sizes()
            found = [(ids[fits], np.repeat(np.arange(len(sizes)), grams.lengths)[fits]) for ids, fits in grams.levels()]
            ids, owner = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            order = np.argsort(owner, kind="stable")
            ids, starts = ids[order], np.cumsum(sizes) - sizes
            rows = [[], [], [], []]
            for at, n, y in zip(words.starts, words.counts, part.column("y").to_pylist(), strict=True):
                codes = words.codes[at : at + n]
                weights = np.repeat(1.0 / np.maximum(1, sizes[codes]), sizes[codes])
                total = np.bincount(ids[ragged(starts[codes], sizes[codes])], weights, BUCKETS)
                there = np.nonzero(total)[0]
                for column, x in zip(rows, (y, n + PAD, there.astype(np.uint16).tobytes(), np.minimum(total[there], 60_000).astype(np.float16).tobytes()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["y", "words", "ids", "uses"])
    give_back()


def gradient(e: np.ndarray, w: np.ndarray, b: np.ndarray, flat: np.ndarray, owner: np.ndarray, share: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradient of a batch's mean cross-entropy for vectors, softmax weights and biases at once. flat,
    owner, share: the n-grams of the batch, whose text each belongs to, its part in the text's average."""
    doc = np.stack([np.bincount(owner, share * e[flat, k], len(y)) for k in range(e.shape[1])], 1).astype(e.dtype)
    logits = doc @ w + b
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = p @ w.T
    return [np.stack([np.bincount(flat, share * back[owner, k], len(e)) for k in range(e.shape[1])], 1).astype(e.dtype), doc.T @ p, p.sum(0)]


def train(y: np.ndarray, words: np.ndarray, ids: list[np.ndarray], uses: list[np.ndarray], seed: int = 3) -> tuple[np.ndarray, float]:
    """Joint training of n-gram vectors and softmax by Adam on shuffled batches. Returns what each
    bucket adds to the log odds of label 1, and the bias."""
    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    held = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, b)]
    step, epochs = 0, -(-STEPS * BATCH // len(y))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs)
        for s in range(0, len(order), BATCH):
            own = order[s : s + BATCH]
            sizes = np.array([len(ids[i]) for i in own])
            owner = np.repeat(np.arange(len(own)), sizes)
            flat, share = np.concatenate([ids[i] for i in own]), np.concatenate([uses[i] for i in own]).astype(np.float32) * (GAIN / words[own])[owner]
            grads = gradient(e, w, b, flat, owner, share, y[own])
            grads[0] += DECAY * e
            step += 1
            for x, g, (m, v) in zip((e, w, b), grads, held, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return (GAIN * e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = HELD_OUT[0], remainder: int = HELD_OUT[1], sample: tuple[int, int] = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn from labels.toxic of rows whose fold is not `remainder`."""
    chosen = labelled_sample(labels, "toxic", modulus, remainder, sample)
    shares = dict(labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), modulus) != remainder)).groupBy("toxic").count().collect())
    total = sum(shares.values())
    prior = (shares.get(1, 0) + 1e-3) / (total + 2e-3) if total else 1e-6
    got = bounded_texts(docs, chosen, SAMPLE_BYTES).mapInArrow(_features, "y int, words long, ids binary, uses binary").toArrow()
    y = got.column("y").to_numpy().astype(np.int64)
    if len(set(y)) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior)))
    table, bias = train(y, got.column("words").to_numpy(), views(got.column("ids"), np.uint16), views(got.column("uses"), np.float16))
    del got
    give_back()
    drawn = y.mean()
    return table, bias + float(np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn)))


def scorer(spark: SparkSession, model: tuple[np.ndarray, float]) -> Callable[[Column], Column]:
    """The probability of label 1 as a function of a text column."""
    shared = spark.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.Array:
        z, bias = shared.value
        words = Words(part.column("text"))
        grams = Grams(words.distinct, LOW, HIGH, BUCKETS)
        of_word = grams.sums(z).astype(np.float64) / np.maximum(1, grams.sizes())
        logit = words.per_text(of_word[words.codes]) / (words.counts + PAD) + bias
        return pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))

    return text_udf(work, "double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
