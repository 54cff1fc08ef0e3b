"""Operator 5: quality classification by positive-unlabelled learning.

Trusted positives are learning rows with labels.quality = 1; the unlabelled set is drawn from all
documents, whatever their labels. The model reads a text as the mean of vectors of its words'
hashed character n-grams and of the words themselves (case and punctuation kept), beside a few
statistics of repetition and length, through one hidden layer; vectors and layers are trained
jointly in numpy. It minimises the non-negative unbiased risk: the positives' risk weighted by the
class prior, plus the unlabelled risk as negatives less the positives' part of it, held at zero from
below by stepping against it whenever it turns negative.

The prior is estimated from scores alone: a first network learns to tell positives from unlabelled
rows on one half of each; on the other half, the share of unlabelled scores above a threshold over
the positives' share bounds the prior from above, and the threshold with the tightest bound, its
confidence margin included, gives the estimate. Labels other than 1 play no part.

Both sets are bounded samples in hash order, in rows and in bytes; every document is scored over its
whole text. Null and empty texts have no words: their vectors and statistics are 0. Repeated rows
are scored alike; trusted ids that repeat count once per row of documents. Without positives every
score is 0.5; an empty table gives no rows. Extra columns are ignored."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Grams, Words, fold, give_back, ragged, slices, text_udf, together, views, word_hashes
from .toxicity import bounded_texts

#: Trusted positives and unlabelled documents learnt from, at most, and their text bytes.
POSITIVES, UNLABELLED, BYTES = 6000, 12000, (48 << 20, 24 << 20)
LOW, HIGH, BUCKETS, DIM, GAIN = 1, 3, 1 << 14, 8, 20.0
HIDDEN, BATCH, RATE, STEP_BACK, DECAY = 24, 192, 0.01, 1.0, 1e-5
#: Steps of training, and of the first network; small samples are gone through more often.
STEPS, FIRST_STEPS = 504, 252
#: Weight of the margin and its confidence in the prior's bound.
GAMMA, DELTA = 0.01, 0.1
THRESHOLD = 0.7
HELD_OUT = (4, 2)
DISTANCES = (1, 2, 3, 4, 5, 8)
N_STATISTICS = len(DISTANCES) + 4


class Measured:
    """Texts' words with their buckets and the texts' statistics."""

    def __init__(self, text: pa.Array):
        words = self.words = Words(text, lower=False)
        self.grams = Grams(words.distinct, LOW, HIGH, BUCKETS)
        self.of_word = (word_hashes(words.distinct) % np.uint64(BUCKETS)).astype(np.int64)
        self.sizes = self.grams.sizes() + 1
        n = np.maximum(1, words.counts)
        again = []
        for d in DISTANCES:
            same = np.zeros(len(words.codes))
            same[d:] = (words.codes[d:] == words.codes[:-d]) & (words.rows[d:] == words.rows[:-d])
            again.append(words.per_text(same) / n)
        pairs = np.unique(words.rows * (len(words.distinct) + 1) + words.codes)
        distinct = np.bincount(pairs // (len(words.distinct) + 1), minlength=len(words.counts))
        lines = pc.count_substring(pc.fill_null(text, ""), "\n").to_numpy(zero_copy_only=False)
        self.statistics = np.column_stack([*again, distinct / n, np.log1p(words.counts) / 8, distinct / np.sqrt(n) / 20, lines / n]).astype(np.float32)

    def means(self, table: np.ndarray) -> np.ndarray:
        """Per text, the mean over its words of the mean of table over a word's buckets."""
        per_word = (self.grams.sums(table) + table[self.of_word]) / self.sizes[:, None]
        return self.words.per_text(per_word[self.words.codes]) / np.maximum(1, self.words.counts)[:, None]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: its buckets, each one's share of the text's mean, and the statistics."""
    for batch in together(batches):
        for part in slices(batch):
            own = Measured(part.column("text"))
            words, n_distinct = own.words, len(own.sizes)
            found = [(ids[fits], np.repeat(np.arange(n_distinct), own.grams.lengths)[fits]) for ids, fits in own.grams.levels()]
            ids, owner = (np.concatenate(x) for x in zip(*found, (own.of_word, np.arange(n_distinct)), strict=True))
            order = np.argsort(owner, kind="stable")
            ids, starts = ids[order], np.cumsum(own.sizes) - own.sizes
            rows = [[], []]
            for at, n in zip(words.starts, words.counts, strict=True):
                codes = words.codes[at : at + n]
                weights = np.repeat(1.0 / (max(1, n) * own.sizes[codes]), own.sizes[codes])
                total = np.bincount(ids[ragged(starts[codes], own.sizes[codes])], weights, BUCKETS)
                there = np.nonzero(total)[0]
                rows[0].append(there.astype(np.uint16).tobytes())
                rows[1].append(total[there].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("y"), *(pa.array(x, pa.binary()) for x in (*rows, [x.tobytes() for x in own.statistics]))], ["y", "ids", "weights", "statistics"])
    give_back()


class Sample:
    """Rows of buckets, shares and statistics."""

    def __init__(self, table: pa.Table):
        self.ids = views(table.column("ids"), np.uint16)
        self.shares = views(table.column("weights"), np.float32)
        self.statistics = np.frombuffer(b"".join(table.column("statistics").to_pylist()), np.float32).reshape(-1, N_STATISTICS)

    def __len__(self) -> int:
        return len(self.ids)

    def batch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, bucket and share of every entry of the rows."""
        sizes = [len(self.ids[r]) for r in rows]
        empty = [np.zeros(0, np.uint16)]
        return np.repeat(np.arange(len(rows)), sizes), np.concatenate([*(self.ids[r] for r in rows), *empty]), np.concatenate([*(self.shares[r] for r in rows), np.zeros(0, np.float32)])


def risk_gradient(s: np.ndarray, f: np.ndarray, m: int, prior: float | None) -> np.ndarray:
    """Gradient of the risk by the outputs f (s = sigmoid(f)), the first m rows positive, the others
    unlabelled. prior None: the plain risk of telling the two apart."""
    u = len(f) - m
    g = np.empty(len(f))
    if prior is None:
        g[:m], g[m:] = (s[:m] - 1) / (2 * m), s[m:] / (2 * u)
        return g
    as_negative = np.logaddexp(0, f)
    if as_negative[m:].mean() - prior * as_negative[:m].mean() >= 0:
        g[:m], g[m:] = prior * (s[:m] - 1) / m - prior * s[:m] / m, s[m:] / u
    else:
        g[:m], g[m:] = STEP_BACK * prior * s[:m] / m, -STEP_BACK * s[m:] / u
    return g


def train(p: Sample, u: Sample, of_p: np.ndarray, of_u: np.ndarray, prior: float | None, steps: int, seed: int = 5) -> dict[str, np.ndarray]:
    """Joint training by Adam on the given rows of positives and unlabelled texts."""
    rng = np.random.default_rng(seed)
    mean, spread = u.statistics[of_u].mean(0).astype(np.float64), u.statistics[of_u].std(0).astype(np.float64) + 1e-3
    w = {"e": rng.normal(0, 0.1, (BUCKETS, DIM)), "a": rng.normal(0, 0.3, (DIM + N_STATISTICS, HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    held = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step, batches = 0, max(1, -(-len(of_u) // BATCH))
    epochs = -(-steps // batches)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order_p, order_u = rng.permutation(of_p), rng.permutation(of_u)
        for k in range(batches):
            # as many positives as the batch has unlabelled rows to compare with, drawn in turn
            some_p, some_u = order_p[np.arange(k, k + len(order_p), batches) % len(order_p)], order_u[k::batches]
            m = len(some_p)
            owner, ids, share = (np.concatenate([x, y]) for x, y in zip(p.batch(some_p), u.batch(some_u), strict=True))
            owner[len(owner) - sum(len(u.ids[r]) for r in some_u) :] += m
            share = share * GAIN
            rows = m + len(some_u)
            doc = np.stack([np.bincount(owner, share * w["e"][ids, c], rows) for c in range(DIM)], 1)
            statistics = np.clip((np.concatenate([p.statistics[some_p], u.statistics[some_u]]) - mean) / spread, -8, 8)
            x = np.concatenate([doc, statistics], 1)
            h = np.tanh(x @ w["a"] + w["b"])
            f = h @ w["c"] + w["d"]
            g = risk_gradient(1 / (1 + np.exp(-np.clip(f, -30, 30))), f, m, prior)
            back = np.outer(g, w["c"]) * (1 - h * h)
            to_doc = (back @ w["a"].T)[:, :DIM]
            grad = {"e": np.stack([np.bincount(ids, share * to_doc[owner, c], BUCKETS) for c in range(DIM)], 1), "a": x.T @ back, "b": back.sum(0), "c": h.T @ g, "d": np.array([g.sum()])}
            step += 1
            for name, value in grad.items():
                first, second = held[name]
                value = value + DECAY * w[name]
                first += 0.1 * (value - first)
                second += 0.01 * (value * value - second)
                w[name] -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
    return w | {"mean": mean, "spread": spread}


def apply(model: dict[str, np.ndarray], means: np.ndarray, statistics: np.ndarray) -> np.ndarray:
    """Probability of good quality, given the texts' mean vectors and statistics."""
    x = np.concatenate([GAIN * means, np.clip((statistics - model["mean"]) / model["spread"], -8, 8)], 1)
    return 1 / (1 + np.exp(-np.clip(np.tanh(x @ model["a"] + model["b"]) @ model["c"] + model["d"], -30, 30)))


def _scores(model: dict[str, np.ndarray], sample: Sample, rows: np.ndarray) -> np.ndarray:
    owner, ids, share = sample.batch(rows)
    means = np.stack([np.bincount(owner, share * model["e"][ids, c], len(rows)) for c in range(DIM)], 1)
    return apply(model, means, sample.statistics[rows])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled scores: at the threshold whose bound is least, the
    unlabelled share above it over the positives' share above it."""
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    at = np.unique(positive)
    q_p = 1 - np.searchsorted(positive, at) / len(positive)
    q_u = 1 - np.searchsorted(unlabelled, at) / len(unlabelled)
    margin = sum(np.sqrt(np.log(4 / DELTA) / (2 * n)) for n in (len(positive), len(unlabelled)))
    best = np.argmin((q_u + (1 + GAMMA) * margin) / q_p)
    return float(min(0.98, max(0.02, q_u[best] / q_p[best])))


def fit(docs: DataFrame, labels: DataFrame, modulus: int = HELD_OUT[0], remainder: int = HELD_OUT[1]) -> tuple[dict[str, np.ndarray], float] | None:
    """The trained model and the estimated prior, None without positives or documents."""
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), modulus) != remainder))
    trusted = trusted.select("doc_id", F.lit(1).alias("y")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES)
    drawn = docs.where("doc_id is not null").select("doc_id", F.lit(0).alias("y")).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(UNLABELLED).distinct()
    got = bounded_texts(docs, trusted.unionByName(drawn), BYTES).mapInArrow(_features, "y int, ids binary, weights binary, statistics binary").toArrow()
    p, u = (Sample(got.filter(pc.equal(got.column("y"), y))) for y in (1, 0))
    if not len(p) or not len(u):
        return None
    if len(p) < 4 or len(u) < 4:
        prior = 0.5
    else:
        rng = np.random.default_rng(9)
        (p_a, p_b), (u_a, u_b) = (np.array_split(rng.permutation(len(x)), 2) for x in (p, u))
        first = train(p, u, p_a, u_a, None, FIRST_STEPS)
        prior = estimate_prior(_scores(first, p, p_b), _scores(first, u, u_b))
    return train(p, u, np.arange(len(p)), np.arange(len(u)), prior, STEPS), prior


def scorer(spark: SparkSession, fitted: tuple[dict[str, np.ndarray], float] | None) -> Callable[[Column], Column]:
    """The probability of good quality as a function of a text column."""
    kept = fitted and fitted[0] | {"e": fitted[0]["e"].astype(np.float32)}
    shared = spark.sparkContext.broadcast(kept)

    def work(part: pa.RecordBatch) -> pa.Array:
        if not shared.value:
            return pa.array(np.full(part.num_rows, 0.5))
        own = Measured(part.column("text"))
        return pa.array(apply(shared.value, own.means(shared.value["e"]).astype(np.float64), own.statistics))

    return text_udf(work, "double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    score = scorer(docs.sparkSession, fit(docs, labels))
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
