"""Operator 7: language-model scoring by a gated recurrent network with a class-factored output.

Tokens are lower-cased words and one end per text. The most frequent training words have vectors of
their own, as inputs and as outputs; they are dealt by spelling and frequency into classes of at
most CLASS_SIZE. Every other word belongs to a class by its spelling: the topic whose character
n-grams fit it best and the shape of its ending; the end is a class of its own. The network's state
gives P(class | words before) and, for a class of frequent words, P(word | class, words before),
both by softmax. A rarer word takes its smoothed share of its spelling class, counted over all
training documents; words never seen in training are one further word of each such class.

The cell is a gated recurrent unit with diagonal recurrent weights: the gate z and the candidate k
read the word before and the state, h' = h + z (k - h). It is trained by truncated backpropagation
through time in numpy over all training documents, in rounds that share them out: the first, short
one is learnt by one task, every further round by many tasks from the weights of the one before, and
their weights are averaged by tokens. The topics come from the n-grams of all training documents:
like documents are summed in the tasks, the sums are grouped by a mixture. Scoring carries the state
across windows, so a text of any length gets its complete log-likelihood.

Texts are tokenised once, into stored slices of word hashes and codes; counting, learning and
scoring read those. Counts of the most frequent words are broadcast up to a fixed number of
entries; the other words of a text are looked up by a join. Null texts count as empty: one end.
Repeated rows are scored each. Without training documents every count is 0 and the network keeps
its first weights. Extra columns are ignored."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Grams, Words, fold, give_back, materialize, ragged, segment_sum, slices, together, word_hashes

TOPICS, LOW, HIGH, BUCKETS = 8, 1, 3, 4096
SHAPES = 4
SPELLINGS = TOPICS * SHAPES
#: Words with vectors of their own, and words of a class at most.
OWN_WORDS, CLASS_SIZE = 2048, 48
HIDDEN, WINDOW = 24, 24
#: Tokens of a document after which learning (not scoring) starts anew, so that lanes are equally long.
SEGMENT = 768
#: Groups of like documents whose n-grams are summed, sums that are held before they are grouped in
#: turn, and the dimensions in which documents are compared.
GROUPS, HELD, PLANE = 16, 128, 16
#: Training tokens of the first round, how many times as many come up to the end of each next one, and
#: passes over all of them, at most, where they fill no more than one round.
FIRST, GROWTH, EPOCHS = 4_000_000, 32, 6
#: Learning rates of the first round, where it falls, and of those after it, and tokens per step aimed at.
FIRST_RATE, RATE, STEP_TOKENS = 0.01, 0.003, 20_480
#: Tokens that are scored in step: of neighbouring slices, so that one slice's long documents share
#: their steps with another's.
SCORED = 1_500_000
#: Words whose counts are broadcast, the most frequent first.
HEAD = 2_000_000
HELD_OUT = (5, 1)
#: Text bytes tokenised at once.
SLICE = 4 << 20


# --- spelling -----------------------------------------------------------------------------------


def shape_of(words: pa.Array) -> np.ndarray:
    """0: letters only, 1: ends in a full stop, 2: in a comma, 3: anything else."""
    letters, stop, comma = (pc.match_substring_regex(words, p).to_numpy(zero_copy_only=False) for p in (r"^\pL+$", r"\pL\.$", r"\pL,$"))
    return np.select([letters, stop, comma], [0, 1, 2], 3)


def spelling_of(words: pa.Array, topics: np.ndarray) -> np.ndarray:
    return Grams(words, LOW, HIGH, BUCKETS).sums(topics).argmax(1) * SHAPES + shape_of(words) if len(words) else np.zeros(0, np.int64)


def learn_topics(counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Mixture of multinomials over the documents' n-gram counts by expectation maximisation.
    Returns log probabilities (BUCKETS, TOPICS)."""
    rng = np.random.default_rng(seed)
    if not len(counts):
        return np.zeros((BUCKETS, TOPICS), np.float32)
    unit = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    centres = [int(rng.integers(len(unit)))]
    while len(centres) < TOPICS:  # far apart: each next centre is drawn by its distance
        far = np.maximum(0, 1 - (unit @ unit[centres].T).max(1)) ** 2 + 1e-12
        centres.append(int(rng.choice(len(unit), p=far / far.sum())))
    log_p = np.log(counts[centres] + 0.5) - np.log((counts[centres] + 0.5).sum(1, keepdims=True))
    weight = np.full(TOPICS, 1 / TOPICS)
    for _ in range(20):
        post = counts @ log_p.T + np.log(weight)
        post = np.exp(np.maximum(-500, post - post.max(1, keepdims=True)))
        post /= post.sum(1, keepdims=True)
        weight = (post.sum(0) + 1) / (len(post) + TOPICS)
        total = post.T @ counts + 0.5
        log_p = np.log(total / total.sum(1, keepdims=True))
    return log_p.T.astype(np.float32)


def _plane() -> np.ndarray:
    return np.random.default_rng(5).normal(0, 1, (BUCKETS, PLANE)).astype(np.float32)


def groups_of(points: np.ndarray, most: int = GROUPS, seed: int = 7) -> np.ndarray:
    """The group, of at most `most`, of each point: nearest centres, the first ones drawn far apart."""
    rng = np.random.default_rng(seed)
    far, centres = np.full(len(points), np.inf), []
    while len(centres) < most and far.max(initial=0) > 0:
        centres.append(points[int(rng.choice(len(points), p=far / far.sum())) if centres else int(rng.integers(len(points)))])
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(1, dtype=np.float64))
    if not centres:
        return np.zeros(len(points), np.int64)
    at = np.array(centres)
    for _ in range(8):
        own = ((at**2).sum(1) - 2 * points @ at.T).argmin(1)
        n = np.bincount(own, minlength=len(at))
        at = np.where(n[:, None] > 0, np.stack([np.bincount(own, x, len(at)) for x in points.T], 1) / np.maximum(1, n)[:, None], at).astype(points.dtype)
    return own


def _joined(held: list[np.ndarray]) -> np.ndarray:
    """Counts of like groups added up."""
    counts = np.concatenate(held)
    if len(counts) <= GROUPS:
        return counts
    own = groups_of((counts / np.maximum(1, counts.sum(1, keepdims=True))) @ _plane())
    return np.stack([counts[own == g].sum(0) for g in np.unique(own)])


def _sent(counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes() for x in counts], pa.binary())], ["counts"])


def gram_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a task's texts, every text counted once, in at most GROUPS sums of like texts."""
    plane, held = _plane(), []
    for batch in together(batches, most=SLICE):
        for part in slices(batch, most=SLICE):
            words = Words(part.column("text"))
            grams = Grams(words.distinct, LOW, HIGH, BUCKETS)
            texts = words.per_text(grams.sums(plane)[words.codes]) / np.maximum(1, words.per_text(grams.sizes()[words.codes]))[:, None].astype(np.float32)
            own = groups_of(texts)
            uses = np.bincount(own[words.rows] * len(words.distinct) + words.codes, minlength=GROUPS * len(words.distinct)).reshape(GROUPS, -1)
            total, levels = np.zeros((GROUPS, BUCKETS)), list(grams.levels())
            for g in range(GROUPS):
                used = np.nonzero(uses[g])[0]
                at, n = ragged(grams.starts[used], grams.lengths[used]), np.repeat(uses[g][used], grams.lengths[used])
                for ids, fits in levels:
                    there = fits[at]
                    total[g] += np.bincount(ids[at[there]], n[there], BUCKETS)
            held.append(total[total.sum(1) > 0])
            if sum(map(len, held)) > HELD:
                held = [_joined(held)]
    if held:
        yield _sent(_joined(held))
    give_back()


def gram_totals(texts: DataFrame) -> np.ndarray:
    """n-gram counts (groups, BUCKETS) of all texts: summed in the tasks, then over about as many tasks
    as the root of their number."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held += [np.frombuffer(x.as_buffer(), np.float64)[None] for x in batch.column("counts")]
            if len(held) > HELD:
                held = [x[None] for x in _joined(held)]
        if held:
            yield _sent(_joined(held))

    found = materialize(texts.select("text").mapInArrow(gram_groups, "counts binary"))
    ways = max(1, int((found.count() / GROUPS) ** 0.5))
    got = found.repartition(ways).mapInArrow(join, "counts binary").toArrow().column("counts")
    return np.frombuffer(b"".join(got.to_pylist()), np.float64).reshape(-1, BUCKETS)


# --- vocabulary ---------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Tokens: own words 0 .. words-1, grouped by class; then one per spelling; then the end. The end
    also stands before a document's first word."""

    hashes: np.ndarray  # of own words, sorted
    ids: np.ndarray  # their tokens
    class_of: np.ndarray  # class of every token
    bounds: np.ndarray  # first own word of each class of own words, and their number

    @property
    def words(self) -> int:
        return len(self.ids)

    @property
    def end(self) -> int:
        return self.words + SPELLINGS

    @property
    def classes(self) -> int:
        return int(self.class_of[-1]) + 1

    def tokens(self, hashes: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        out = self.words + spelling.astype(np.int64)
        if self.words and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), self.words - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.ids[at[hit]]
        return out


def vocabulary(hashes: np.ndarray, spelling: np.ndarray, n: np.ndarray, size: int = CLASS_SIZE) -> Vocabulary:
    """Own words in order of spelling, then frequency; each spelling is cut into classes of `size`."""
    order = np.lexsort((hashes, -n, spelling))
    hashes, spelling = hashes[order], spelling[order]
    new = np.ones(len(order), bool)
    new[1:] = spelling[1:] != spelling[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    starts = (np.arange(len(order)) - first) % size == 0
    bounds = np.append(np.nonzero(starts)[0], len(order))
    own = np.cumsum(starts) - 1
    rest = len(bounds) - 1 + np.arange(SPELLINGS + 1)
    by_hash = np.argsort(hashes)
    return Vocabulary(hashes[by_hash], by_hash, np.concatenate([own, rest]).astype(np.int64), bounds)


# --- the network --------------------------------------------------------------------------------


def start_weights(v: Vocabulary, counts: np.ndarray | None = None, seed: int = 13, kind: type = np.float32) -> dict[str, np.ndarray]:
    """Inputs of tokens (e) and of their classes (g), diagonal recurrent weights (s), softmax of
    classes (v, c) and of own words (u, d); biases start at the tokens' counts."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(kind)
    n = np.ones(v.end + 1) if counts is None else counts + 1.0
    w = {"e": draw(v.end + 1, 2 * HIDDEN, scale=0.1), "g": draw(v.classes, 2 * HIDDEN, scale=0.3), "s": draw(2, HIDDEN, scale=0.2), "v": draw(HIDDEN, v.classes, scale=0.2), "u": draw(v.words, HIDDEN, scale=0.1)}
    w["g"][:, :HIDDEN] -= 1
    return w | {"c": np.log(np.bincount(v.class_of, n) / n.sum()).astype(kind), "d": np.log(n[: v.words]).astype(kind)}


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(like[k].dtype)
        at += like[k].size
    return out


@dataclass
class Lanes:
    """Documents laid end to end in lanes, the fullest lane first, so that the lanes still running at a
    step are the first ones. Tokens lie step by step: those of step t from offsets[t] on."""

    tokens: np.ndarray
    before: np.ndarray  # the token before, the end at a document's start
    active: np.ndarray  # lanes still running at each step
    offsets: np.ndarray
    place: np.ndarray  # where every token lies, in input order


def lanes(sequence: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int, end: int) -> Lanes:
    """sequence: tokens of all documents; each document stays in one lane."""
    width = int(max(1, min(most, len(counts))))
    load, lane_of, at = np.zeros(width, np.int64), np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    heap = [(0, k) for k in range(width)]
    for d in np.argsort(-counts, kind="stable"):
        n, k = heapq.heappop(heap)
        lane_of[d], at[d] = k, n
        heapq.heappush(heap, (n + int(counts[d]), k))
        load[k] = n + counts[d]
    order = np.argsort(-load, kind="stable")
    rank = np.empty(width, np.int64)
    rank[order] = np.arange(width)
    active = np.searchsorted(-load[order], -np.arange(int(load.max(initial=0))), side="left")
    offsets = np.concatenate([[0], np.cumsum(active)])
    place = offsets[np.repeat(at - starts, counts) + np.arange(len(sequence))] + np.repeat(rank[lane_of], counts)
    tokens, before, last = np.empty_like(sequence), np.empty_like(sequence), np.empty_like(sequence)
    tokens[place] = sequence
    last[1:] = sequence[:-1]
    last[starts[counts > 0]] = end
    before[place] = last
    return Lanes(tokens, before, active, offsets, place)


def inputs(w: dict[str, np.ndarray], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """What each token, as the one before, gives to the gate (halved) and to the candidate."""
    x = w["e"] + w["g"][v.class_of]
    return x[:, :HIDDEN] * x.dtype.type(0.5), np.ascontiguousarray(x[:, HIDDEN:])


def _window(w: dict[str, np.ndarray], v: Vocabulary, own: Lanes, low: int, high: int, h: np.ndarray, keep: bool, given: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """States of steps low .. high-1 (zero state at document starts), the last state, and what the
    backward pass needs. The gate is written as 1/(1 + exp(-a)) = (1 + tanh(a/2))/2, so that one call
    serves gate and candidate."""
    base = own.offsets[low]
    before = own.before[base : own.offsets[high]]
    kind = w["e"].dtype
    x = np.empty((2, len(before), HIDDEN), kind)
    for half, source in zip(x, given or inputs(w, v), strict=True):
        np.take(source, before, axis=0, out=half, mode="clip")
    starts = before == v.end
    some = np.logical_or.reduceat(starts, own.offsets[low:high] - base) if len(before) else starts
    half = kind.type(0.5)
    s = np.repeat(w["s"][:, None] * np.array([[[0.5]], [[1]]], kind), own.active[low] if high > low else 0, axis=1)
    states, saved = np.empty((len(before), HIDDEN), kind), []
    for t in range(low, high):
        n = own.active[t]
        rows = slice(own.offsets[t] - base, own.offsets[t] - base + n)
        h = h[:n]
        if some[t - low]:
            h = h * ~starts[rows, None]
        a = s[:, :n] * h
        a += x[:, rows]
        np.tanh(a, out=a)
        z, k = a
        z += 1
        z *= half
        if keep:
            saved.append((h, z, k))
        step = k - h
        step *= z
        h = np.add(h, step, out=states[rows])
    return states, h.copy(), saved


#: Tokens whose softmax over the classes is worked out at once.
ROWS = 4096
#: Logits below this in size need no shift before their exponential.
SAFE = 60.0


def _softmax(logits: np.ndarray, hit: np.ndarray, safe: bool, weight: float) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of the column `hit` of each row; with a weight also a factor per row by which
    the logits, replaced here, are the gradient of -weight times their sum."""
    at = np.arange(len(logits))
    if not safe:
        logits -= logits.max(1, keepdims=True)
    found = logits[at, hit]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    if not weight:
        return found - np.log(total), None
    logits[at, hit] -= total
    return found - np.log(total), (weight / total).astype(logits.dtype)[:, None]


def outputs(w: dict[str, np.ndarray], v: Vocabulary, states: np.ndarray, goal: np.ndarray, weight: float = 0.0) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray | None]:
    """Natural log probability of each goal token (of a spelling: of its class); with a weight also the
    gradient of -weight times their sum, for the softmax weights and for the states."""
    cls = v.class_of[goal]
    # states lie between -1 and 1, so the weights bound the logits
    safe = float((np.abs(w["v"]).sum(0) + np.abs(w["c"])).max()) < SAFE
    safe_words = not v.words or float((np.abs(w["u"]).sum(1) + np.abs(w["d"])).max()) < SAFE
    # biases are weights of one more state that is always 1
    of_classes, of_words = np.vstack([w["v"], w["c"]]), np.column_stack([w["u"], w["d"]])
    one = np.ones((len(states), HIDDEN + 1), states.dtype)
    one[:, :HIDDEN] = states
    found = np.empty(len(goal), states.dtype)
    grad = (np.zeros_like(of_classes), np.zeros_like(of_words))
    back = np.empty_like(states) if weight else None
    for a in range(0, len(goal), ROWS):
        s = one[a : a + ROWS]
        p = s @ of_classes
        found[a : a + ROWS], factor = _softmax(p, cls[a : a + ROWS], safe, weight)
        if weight:
            grad[0][:] += (s * factor).T @ p
            back[a : a + ROWS] = p @ w["v"].T * factor
    order = np.argsort(cls.astype(np.uint16) if v.classes < 1 << 16 else cls, kind="stable")
    edges = np.searchsorted(cls[order], np.arange(len(v.bounds)))
    order = order[: edges[-1]]
    one, goal = one[order], goal[order]
    more, to_states = np.empty(len(order), states.dtype), np.empty((len(order), HIDDEN), states.dtype) if weight else None
    for a, b, low, high in zip(v.bounds[:-1], v.bounds[1:], edges[:-1], edges[1:], strict=True):
        if low == high:
            continue
        s = one[low:high]
        q = s @ of_words[a:b].T
        more[low:high], factor = _softmax(q, goal[low:high] - a, safe_words, weight)
        if weight:
            grad[1][a:b] = q.T @ (s * factor)
            to_states[low:high] = q @ w["u"][a:b] * factor
    found[order] += more
    if not weight:
        return found, {}, None
    back[order] += to_states
    return found, {"v": grad[0][:HIDDEN], "c": grad[0][HIDDEN], "u": grad[1][:, :HIDDEN], "d": grad[1][:, HIDDEN]}, back


def log_likelihood(w: dict[str, np.ndarray], v: Vocabulary, sequence: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int = 1024) -> np.ndarray:
    """Natural log probability of every token given those before it."""
    own = lanes(sequence, starts, counts, most, v.end)
    out = np.empty(len(sequence), w["v"].dtype)
    h = np.zeros((len(counts), HIDDEN), w["v"].dtype)
    held: list[np.ndarray] = []
    done, steps, given = 0, len(own.active), inputs(w, v)
    for low in range(0, steps, WINDOW):
        high = min(low + WINDOW, steps)
        states, h, _ = _window(w, v, own, low, high, h, False, given)
        held.append(states)
        upto = own.offsets[high]
        if upto - done >= STEP_TOKENS or high == steps:  # late windows have few lanes: read out together
            out[done:upto] = outputs(w, v, np.concatenate(held), own.tokens[done:upto])[0]
            held, done = [], upto
    return out[own.place]


def _sum_rows(ids: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    order = np.argsort(ids.astype(np.uint16) if size < 1 << 16 else ids, kind="stable")
    ids = ids[order]
    starts = np.nonzero(np.diff(ids, prepend=-1))[0]
    out[ids[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def gradient(w: dict[str, np.ndarray], v: Vocabulary, own: Lanes, low: int, high: int, h: np.ndarray, weight: float | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradient of the window's negative log-likelihood (times weight) by backpropagation through its
    steps, and the state after it."""
    states, last, saved = _window(w, v, own, low, high, h, True)
    base, upto = own.offsets[low], own.offsets[high]
    before = own.before[base:upto]
    _, grad, back = outputs(w, v, states, own.tokens[base:upto], weight or 1 / max(len(states), STEP_TOKENS // 4))
    to_x = np.empty((len(states), 2 * HIDDEN), states.dtype)
    grad["s"] = np.zeros_like(w["s"])
    s = np.repeat(w["s"][:, None], own.active[low], axis=1)
    ahead = np.zeros((own.active[low], HIDDEN), states.dtype)
    for t in range(high - 1, low - 1, -1):
        prev, z, k = saved[t - low]
        n = len(prev)
        rows = slice(own.offsets[t] - base, own.offsets[t] - base + n)
        dh = back[rows] + ahead[:n]
        dk = dh * z
        dh -= dk  # dh (1 - z)
        dz = dh * z
        dz *= k - prev
        dk *= 1 - k * k
        to_x[rows, :HIDDEN], to_x[rows, HIDDEN:] = dz, dk
        grad["s"][0] += np.einsum("ij,ij->j", dz, prev)
        grad["s"][1] += np.einsum("ij,ij->j", dk, prev)
        dz *= s[0, :n]
        dh += dz
        dk *= s[1, :n]
        np.add(dh, dk, out=ahead[:n])
        ahead[:n][before[rows] == v.end] = 0
    grad["e"] = _sum_rows(before, to_x, len(w["e"]))
    grad["g"] = _sum_rows(v.class_of, grad["e"], len(w["g"]))
    return grad, last


class Trainer:
    """Adam over windows; the state, but no gradient, passes from window to window."""

    def __init__(self, w: dict[str, np.ndarray], v: Vocabulary, rate: float):
        self.w, self.v, self.rate, self.step = {k: x.copy() for k, x in w.items()}, v, rate, 0
        self.held = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in w.items()}

    def train(self, sequence: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        parts = -(-counts // SEGMENT)
        cuts = np.repeat(starts, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * SEGMENT
        sizes = np.minimum(SEGMENT, np.repeat(starts + counts, parts) - cuts)
        own = lanes(sequence, cuts, sizes, max(16, STEP_TOKENS // WINDOW), self.v.end)
        h = np.zeros((len(sizes), HIDDEN), np.float32)
        for low in range(0, len(own.active), WINDOW):
            grad, h = gradient(self.w, self.v, own, low, min(low + WINDOW, len(own.active)), h)
            self.step += 1
            rate = np.float32(self.rate / (1 - 0.9**self.step))
            scale = np.float32(1 / (1 - 0.99**self.step))
            for k, g in grad.items():
                first, second = self.held[k]
                first += np.float32(0.1) * (g - first)
                second += np.float32(0.01) * (g * g - second)
                self.w[k] -= rate * first / (np.sqrt(second * scale) + np.float32(1e-7))


# --- Spark --------------------------------------------------------------------------------------

CODED = "doc_ids array<{id}>, train array<boolean>, counts array<int>, hashes binary, spelling binary, codes binary, place long, tokens long"


def coded_slices(docs: DataFrame, topics: np.ndarray, train: Column) -> DataFrame:
    """Stored slices of documents: their ids and numbers of words, the distinct words' hashes and
    spellings, and a code per word; a hash that places the slice among the others, and its training
    tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(topics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in together(batches, most=SLICE):
            for part in slices(batch, most=SLICE):
                words = Words(part.column("text"))
                one = lambda c: pa.ListArray.from_arrays([0, len(c)], c)
                raw = [word_hashes(words.distinct), spelling_of(words.distinct, shared.value).astype(np.uint8), words.codes.astype(np.uint32)]
                parts = [x.tobytes() for x in raw]
                tokens = (words.counts + 1)[part.column("train").to_numpy(zero_copy_only=False).astype(bool)].sum()
                placed = [pa.array([xxhash.xxh3_64_intdigest(b"".join(parts)) >> 1]), pa.array([int(tokens)])]
                yield pa.RecordBatch.from_arrays([one(part.column("doc_id")), one(part.column("train")), one(pa.array(words.counts.astype(np.int32))), *(pa.array([x], pa.binary()) for x in parts), *placed], ["doc_ids", "train", "counts", "hashes", "spelling", "codes", "place", "tokens"])
        give_back()

    return materialize(docs.select("doc_id", "text", train.alias("train")).mapInArrow(run, CODED.format(id=dict(docs.dtypes)["doc_id"])), "zstd")


class Slice:
    """One stored slice, all of its documents or those of a mask."""

    def __init__(self, row: pa.RecordBatch, i: int):
        at = lambda name: row.column(name)[i]
        self.doc_ids = at("doc_ids").values
        self.train = at("train").values.to_numpy(zero_copy_only=False).astype(bool)
        self.counts = at("counts").values.to_numpy().astype(np.int64)
        self.hashes = np.frombuffer(at("hashes").as_buffer(), np.uint64)
        self.spelling = np.frombuffer(at("spelling").as_buffer(), np.uint8)
        self.codes = np.frombuffer(at("codes").as_buffer(), np.uint32)

    def sequence(self, v: Vocabulary, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the documents one after another, each with its end; starts and lengths."""
        codes, counts = (self.codes, self.counts) if mask is None else (self.codes[np.repeat(mask, self.counts)], self.counts[mask])
        tokens = np.insert(v.tokens(self.hashes, self.spelling)[codes], np.cumsum(counts), v.end)
        return tokens, np.cumsum(counts + 1) - counts - 1, counts + 1


def _slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Slice(batch, i)


def _groups(found: Iterator[Slice], most: int = SCORED) -> Iterator[list[Slice]]:
    """Neighbouring slices of about `most` words together, at least one each."""
    held, size = [], 0
    for own in found:
        if held and size + len(own.codes) > most:
            yield held
            held, size = [], 0
        held.append(own)
        size += len(own.codes)
    if held:
        yield held


def count_words(coded: DataFrame) -> DataFrame:
    """(h, spelling, n) of all training words: summed in the task first, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(held: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(held).group_by(["h", "spelling"]).aggregate([("n", "sum")]).rename_columns(["h", "spelling", "n"])

        held, size = [], 0
        for own in _slices_of(batches):
            n = np.bincount(own.codes[np.repeat(own.train, own.counts)], minlength=len(own.hashes))
            used = n > 0
            held.append(pa.table({"h": own.hashes[used].view(np.int64), "spelling": own.spelling[used].astype(np.int32), "n": n[used]}))
            size += int(used.sum())
            if size > 1_000_000:
                held = [merged(held)]
                size = len(held[0])
                if size > 500_000:
                    yield from held.pop().to_batches()
                    size = 0
        if held:
            yield from merged(held).to_batches()
        give_back()

    return coded.mapInArrow(run, "h long, spelling int, n long").groupBy("h", "spelling").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: dict[str, np.ndarray]
    hashes: np.ndarray  # broadcast words, sorted
    counts: np.ndarray
    complete: bool  # whether all words are broadcast
    rare_tokens: np.ndarray  # per spelling: tokens and words without vectors of their own
    rare_words: np.ndarray
    tokens: int
    words: int
    ends: int


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sorted hashes and counts of at most `most` words, all words above some count; whether that is all."""
    least, total = 1, 0
    for r in counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).agg(F.count("*").alias("v")).orderBy(F.col("n").desc()).toLocalIterator():
        total += r["v"]
        if total > most:
            least = r["n"] + 1
            break
    known = counts.where(F.col("n") >= least if least <= 1 << 20 else F.lit(False)).select("h", "n").toArrow()
    hashes = known.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], known.column("n").to_numpy()[order], least <= 1


def fit(docs: DataFrame, train: Column, head: int = HEAD, own_words: int = OWN_WORDS) -> tuple[Model, DataFrame, DataFrame]:
    """The model with the first weights of its network, the coded documents and the counts of all
    training words."""
    learnt = docs.where(train)
    coded = coded_slices(docs, learn_topics(gram_totals(learnt)), train)
    counts = materialize(count_words(coded), "zstd")
    top = counts.orderBy(F.col("n").desc(), "h").limit(own_words).toArrow()
    n = top.column("n").to_numpy()
    spelling = top.column("spelling").to_numpy().astype(np.int64)
    v = vocabulary(top.column("h").to_numpy().view(np.uint64), spelling, n)
    ends = learnt.count()
    tokens, words = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    for r in counts.groupBy("spelling").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["spelling"]], words[r["spelling"]] = r["n"], r["v"]
    of_own = np.zeros(v.words, np.int64)
    of_own[v.ids[np.searchsorted(v.hashes, top.column("h").to_numpy().view(np.uint64))]] = n
    rare_tokens, rare_words = tokens - np.bincount(spelling, n, SPELLINGS), words - np.bincount(spelling, minlength=SPELLINGS)
    first = start_weights(v, np.concatenate([of_own, rare_tokens, [ends]]))
    hashes, known, complete = _frequent(counts, head)
    model = Model(v, first, hashes, known, complete, rare_tokens, rare_words, int(tokens.sum()) + ends, int(words.sum()) + (ends > 0), ends)
    return model, coded, counts


def rounds(tokens: np.ndarray, first: int = FIRST, growth: int = GROWTH) -> list[tuple[int, int]]:
    """Slices in order are cut into rounds (from, to), which share them out: the first of about `first`
    tokens, up to the end of each next one `growth` times as many; the last takes what is left."""
    total, ends, goal = np.cumsum(tokens), [0], first
    while len(total) and goal * 2 <= total[-1]:
        ends.append(int(np.searchsorted(total, goal)) + 1)
        goal *= growth
    cuts = sorted({x for x in ends if x < len(total)}) + [len(total)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def learn_round(coded: DataFrame, model: Model, w: dict[str, np.ndarray], rate: float, due: float = 0, epochs: int = 1) -> dict[str, np.ndarray]:
    """Every partition goes on from the same weights, and the results are averaged by tokens, in two
    levels of means; one row comes back. The rate falls to a twentieth by `due` tokens, if given."""
    first = coded.sparkSession.sparkContext.broadcast((model.vocabulary, w))

    def out(mean: np.ndarray, tokens: float) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([mean.astype(np.float32).tobytes()], pa.binary()), pa.array([float(tokens)])], ["mean", "tokens"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = first.value
        trainer, tokens, found = Trainer(w, v, rate), 0, _slices_of(batches)
        if epochs > 1:  # few slices, all of which fit a round
            held = list(found)
            found = (own for _ in range(epochs) for own in held)
        for own in found:
            if own.train.any():
                sequence, starts, counts = own.sequence(v, own.train)
                if due:
                    trainer.rate = rate * (1 - 0.95 * min(1, tokens / due))
                trainer.train(sequence, starts, counts)
                tokens += len(sequence)
        if tokens:
            yield out(flat(trainer.w), tokens)
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = 0.0, 0.0
        for batch in batches:
            for raw, n in zip(batch.column("mean"), batch.column("tokens").to_pylist(), strict=True):
                total, tokens = total + n * np.frombuffer(raw.as_buffer(), np.float32).astype(np.float64), tokens + n
        if tokens:
            yield out(total / tokens, tokens)

    schema = "mean binary, tokens double"
    learnt = materialize(coded.select("train", "counts", "hashes", "spelling", "codes", "doc_ids").mapInArrow(learn, schema))
    ways = max(1, int(learnt.count() ** 0.5))
    found = learnt.repartition(ways).mapInArrow(add, schema).coalesce(1).mapInArrow(add, schema).toArrow()
    if not found.num_rows:
        return w
    return unflat(np.frombuffer(found.column("mean")[0].as_py(), np.float32), w)


def learn_everywhere(coded: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """One pass over all training documents, in rounds of slices by their places. What comes to the
    driver of a slice is its place and its size."""
    known = coded.groupBy("place").agg(F.sum("tokens").alias("tokens")).orderBy("place").toArrow()
    place, tokens = (known.column(c).to_numpy() for c in ("place", "tokens"))
    w, shares = model.weights, rounds(tokens)
    for k, (low, high) in enumerate(shares):
        own, n = coded.where(F.col("place").between(int(place[low]), int(place[high - 1]))), int(tokens[low:high].sum())
        alone = len(shares) == 1
        epochs = int(min(EPOCHS, max(1, -(-2 * FIRST // max(1, n))))) if alone else 1
        if alone or k < len(shares) - 1:  # the last share stays where it lies
            own = own.repartition(max(1, n // FIRST))
        w = learn_round(own, model, w, *((FIRST_RATE, n * epochs, epochs) if k == 0 else (RATE,)))
    return w


def paths(w: dict[str, np.ndarray], v: Vocabulary, group: list[Slice]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice its documents' starts and lengths and the log10 probability of every token."""
    own = [x.sequence(v) for x in group]
    ends = np.cumsum([len(tokens) for tokens, _, _ in own])
    begins = np.concatenate([start + end - len(tokens) for (tokens, start, _), end in zip(own, ends, strict=True)])
    path = log_likelihood(w, v, np.concatenate([x[0] for x in own]), begins, np.concatenate([x[2] for x in own])).astype(np.float64) / np.log(10)
    return [(start, counts, part) for (_, start, counts), part in zip(own, np.split(path, ends[:-1]), strict=True)]


def score(coded: DataFrame, model: Model, weights: dict[str, np.ndarray], counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every coded document."""
    shared = coded.sparkSession.sparkContext.broadcast((model, weights))
    id_kind = dict(coded.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = shared.value
        v = m.vocabulary
        log_base = np.log10(m.tokens + 0.5 * (m.words + 1))
        log_rare = np.append(np.log10(m.rare_tokens + 0.5 * (m.rare_words + 1)), 0)
        scored = ((own, *x) for group in _groups(_slices_of(batches)) for own, x in zip(group, paths(w, v, group), strict=True))
        for own, begin, counts, path in scored:
            c = np.zeros(len(own.hashes))
            if len(m.hashes) and len(c):
                at = np.minimum(np.searchsorted(m.hashes, own.hashes), len(m.hashes) - 1)
                c = np.where(m.hashes[at] == own.hashes, m.counts[at], 0).astype(np.float64)
            share = np.log10(c + 0.5)
            rare = np.where(v.tokens(own.hashes, own.spelling) < v.words, 0.0, share - log_rare[own.spelling])
            starts = np.cumsum(own.counts) - own.counts
            per_text = lambda values: segment_sum(values[own.codes], starts, own.counts)
            base = per_text(share - log_base) + np.log10(m.ends + 0.5) - log_base
            known = per_text((c > 0).astype(np.int64)) + (m.ends > 0)
            total = np.add.reduceat(path, begin) + per_text(rare)
            # words that are not broadcast: each once for a text, with its uses there
            missing = np.zeros(len(own.codes), bool) if m.complete else (c == 0)[own.codes]
            pairs, uses = np.unique(np.repeat(np.arange(len(counts)), own.counts)[missing] * max(1, len(own.hashes)) + own.codes[missing], return_counts=True)
            ends = pa.array(np.searchsorted(pairs // max(1, len(own.hashes)), np.arange(len(counts) + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (own.hashes.view(np.int64)[pairs % max(1, len(own.hashes))], uses.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([own.doc_ids, pa.array(counts), pa.array(known), pa.array(base), pa.array(total), *rest], ["doc_id", "n_tokens", "n_known", "base_score", "score", "rest", "uses"])
        give_back()

    scored = coded.mapInArrow(run, f"doc_id {id_kind}, n_tokens long, n_known long, base_score double, score double, rest array<long>, uses array<int>")
    if not model.complete:
        scored = materialize(scored.withColumn("key", F.monotonically_increasing_id()), "zstd")
        open_words = scored.select("key", F.explode(F.arrays_zip(F.col("rest").alias("h"), F.col("uses").alias("k"))).alias("x")).select("key", "x.h", "x.k")
        found = open_words.join(counts.select("h", "n"), "h").groupBy("key").agg(F.sum("k").alias("more"), F.sum(F.col("k") * (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)))).alias("gain"))
        gain = F.coalesce("gain", F.lit(0.0))
        scored = scored.join(found, "key", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("more", F.lit(0)), "base_score": F.col("base_score") + gain, "score": F.col("score") + gain})
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scores(docs: DataFrame, head: int = HEAD, own_words: int = OWN_WORDS) -> DataFrame:
    """doc_id, held_out and the scores of every row of docs."""
    docs = docs.select("doc_id", "text")
    train = F.coalesce(fold(F.col("doc_id"), HELD_OUT[0]) != HELD_OUT[1], F.lit(True))
    model, coded, counts = fit(docs, train, head, own_words)
    out = score(coded, model, learn_everywhere(coded, model), counts)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1], F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
