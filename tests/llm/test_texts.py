"""Jaccard join, classifiers, language model and pipeline."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from sluice.llm import jaccard, language, lm, quality, toxicity


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(rows):
    sets, low = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 180 * len(sets[x] & sets[y]) >= 80 * (len(sets[x]) + len(sets[y])):
                a, b = top(x), top(y)
                low[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("how", [{}, {"crowded": 2, "tile": 3, "unit": 500}])
def test_jaccard_equals_brute_force(spark, documents, how):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    rng = np.random.default_rng(0)
    for base in (3, 9):  # families of near copies, some links only through others
        words = rows[base][1].split()[:120]
        for k in range(30):
            copy = list(words)
            for at in rng.integers(0, len(copy), 1 + k % 5):
                copy[at] = f"neu{k}"
            rows.append((1000 * base + k, " ".join(copy)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    assert got == brute_groups(rows)


def test_jaccard_of_odd_and_empty_tables(odd, nothing):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(odd).collect()]
    assert len(got) == 12 and {(i, c) for i, n, c in got if n == 0} == {(3, 3), (4, 4), (7, 7)}
    assert {c for i, _, c in got if i in (1, 2, 9)} == {1} and {c for i, _, c in got if i in (5, 6)} == {5}
    assert jaccard.jaccard_components(nothing).count() == 0
    assert sorted(r["doc_id"] or -1 for r in jaccard.one_per_group(odd).collect()) == [-1, 1, 3, 4, 5, 7, 8, 10]


def test_slices_of_very_few_words():
    assert [len(x) for x in jaccard.shingle_sets(pa.array(["a b", None, "c"]))] == [1, 0, 1]
    assert language.Lettered(pa.array(["a", ""])).lengths.tolist() == [1]


def test_marks_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "ein wort", "de"), (2, "\u0301\u0301 \u0300", None), (3, "12 .", None), (4, "e\u0301", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()} == {1: "de", 2: "und", 3: "und", 4: "de"}


def test_more_languages_than_any_fixed_number(spark):
    docs = spark.createDataFrame([(i, f"wort{i} text", f"l{i}") for i in range(900)], "doc_id long, text string, lang string")
    assert language.identify(docs).where("lang_pred = 'und'").count() == 0


def test_one_of_two_texts_under_one_id_is_not_lost(spark):
    rows = [(1, "one two three four five six", "a"), (1, "six five four three two one", "b"), (1, "one two three four five six", "c"), (2, "seven eight nine", "d")]
    kept = jaccard.one_per_group(spark.createDataFrame(rows, "doc_id long, text string, row string"))
    assert kept.columns == ["doc_id", "text", "row"] and sorted(r["text"] for r in kept.collect()) == sorted({t for _, t, _ in rows})


def test_columns_give_pairs_and_crowded_ones_stars(spark):
    rows = [np.repeat([5, 7], [3, 500]), np.r_[[4, 9, 2], np.arange(500)], np.full(503, 10)]
    few = pa.RecordBatch.from_arrays([pa.array(x[:3]) for x in rows], ["shingle", "doc", "n"])
    out = pa.Table.from_batches(jaccard._pairs(iter([few.slice(0, 1), few.slice(1)])))
    assert sorted(zip(*(out.column(c).to_pylist() for c in "ab"), strict=True)) == [(2, 4), (2, 9), (4, 9)]
    columns = spark.createDataFrame(list(zip(*(x.tolist() for x in rows), strict=True)), "shingle long, doc long, n long")
    stars = jaccard._stars(columns, spark.createDataFrame([(7,)], "shingle long")).distinct().collect()
    assert {tuple(r) for r in stars} == {(i, 0) for i in range(1, 500)}


def test_compatible_sizes_share_a_cell():
    cells = lambda n: {(0, math.floor(math.log(n) / math.log(jaccard.CELL))), (1, math.floor(math.log(n) / math.log(jaccard.CELL) + 0.5))}
    assert all(cells(n) & cells(m) for n in range(1, 400) for m in range(n, 5 * n // 4 + 1))


def test_toxicity_learns_subwords(spark):
    rng = np.random.default_rng(0)
    sound = lambda n: " ".join("".join(rng.choice(["la", "mo", "ri", "te", "su"], 3)) for _ in range(n))
    rows = [(i, sound(30) + (" grobnax" if i % 2 else "") + " " + sound(20), i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    held = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect() if r["held_out"]}
    assert set(held) == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == i % 2 for i, r in held.items()]) > 0.95
    bent = spark.createDataFrame([(1, sound(25) + " gr0bnax"), (2, sound(25))], "doc_id long, text string")
    score = toxicity.scorer(spark, model)
    a, b = (r["score"] for r in bent.select("doc_id", score("text").alias("score")).orderBy("doc_id").collect())
    assert a > b


def test_classifiers_on_odd_and_empty_tables(odd, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, None, None), (99, 1, 1)], none.schema)
    for labels in (none, some):
        for run in (toxicity.toxicity, quality.quality):
            rows = run(odd, labels).collect()
            assert len(rows) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
            assert run(nothing, labels).count() == 0


def test_quality_learns_from_positives_and_unlabelled(spark):
    rng = np.random.default_rng(1)
    good = lambda: ". ".join(" ".join("".join(rng.choice(["la", "mo", "ri"], 2)) for _ in range(8)).capitalize() for _ in range(6))
    bad = lambda: " ".join("".join(rng.choice(["LA", "MO"], 2)) + "!!" for _ in range(40))
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2 == 0 or q == 0], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    scores = [[r["score"] for i, r in got.items() if rows[i][2] == q] for q in (0, 1)]
    assert np.median(scores[1]) > np.median(scores[0]) + 0.2 and min(scores[1]) > max(scores[0])


def grams_of(word, low, high, buckets):
    """Buckets of a word's n-grams, one by one."""
    marked, m64 = [2, *map(ord, word), 3], (1 << 64) - 1

    def mixed(h):
        for _ in range(2):
            h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & m64
        return h ^ (h >> 32)

    for n in range(low, high + 1):
        for a in range(len(marked) - n + 1):
            h = 0
            for c in marked[a : a + n]:
                h = (h * 0x9E3779B97F4A7C15 + c + 1) & m64
            yield mixed((h + n) & m64) % buckets


def test_toxicity_scores_equal_a_plain_loop(spark):
    z, bias = np.random.default_rng(2).normal(size=toxicity.BUCKETS).astype(np.float32), -1.5
    texts = ["Some words, some MORE words", "", None, "a", "naïve café 日本語 " * 40]
    score = toxicity.scorer(spark, (z, bias))
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", score("text").alias("s")).orderBy("i").collect()
    for r, text in zip(got, texts, strict=True):
        words = words_of(text)
        means = [float(z[g].mean()) if len(g := list(grams_of(w, toxicity.LOW, toxicity.HIGH, toxicity.BUCKETS))) else 0.0 for w in words]
        assert math.isclose(r["s"], 1 / (1 + math.exp(-(sum(means) / (len(words) + toxicity.PAD) + bias))), rel_tol=1e-4)


def test_quality_scores_equal_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    model = {"e": rng.normal(size=(quality.BUCKETS, quality.DIM)), "a": rng.normal(size=(quality.DIM + quality.N_STATISTICS, quality.HIDDEN)), "b": rng.normal(size=quality.HIDDEN), "c": rng.normal(size=quality.HIDDEN), "d": rng.normal(size=1), "mean": np.full(quality.N_STATISTICS, 0.1), "spread": np.full(quality.N_STATISTICS, 0.5)}
    texts = ["Some words,\nsome MORE words words words", "", None, "x!!", "a b a b a b " * 30]
    score = quality.scorer(spark, (model, 0.5))
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", score("text").alias("s")).orderBy("i").collect()
    for r, text in zip(got, texts, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = max(1, len(words))
        buckets = lambda w: [*grams_of(w, quality.LOW, quality.HIGH, quality.BUCKETS), xxhash.xxh3_64_intdigest(w.encode()) % quality.BUCKETS]
        mean = sum((model["e"][buckets(w)].mean(0) for w in words), np.zeros(quality.DIM)) / n
        again = [sum(words[k] == words[k - d] for k in range(d, len(words))) / n for d in quality.DISTANCES]
        distinct = len(set(words))
        statistics = np.array([*again, distinct / n, math.log1p(len(words)) / 8, distinct / math.sqrt(n) / 20, (text or "").count("\n") / n])
        x = np.concatenate([quality.GAIN * mean, np.clip((statistics - 0.1) / 0.5, -8, 8)])
        f = float(np.tanh(x @ model["a"] + model["b"]) @ model["c"] + model["d"][0])
        assert math.isclose(r["s"], 1 / (1 + math.exp(-min(30, max(-30, f)))), rel_tol=1e-3, abs_tol=1e-6)


def test_toxicity_gradient_equals_finite_differences():
    rng = np.random.default_rng(5)
    shapes, y = ((20, 3), (3, 2), (2,)), rng.integers(0, 2, 6)
    flat, owner, share = rng.integers(0, 20, 40), np.sort(rng.integers(0, 6, 40)), rng.random(40)
    x = [rng.normal(size=s) for s in shapes]

    def loss(e, w, b):
        doc = np.zeros((6, 3))
        np.add.at(doc, owner, share[:, None] * e[flat])
        z = doc @ w + b
        return np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(6), y])

    for k, g in enumerate(toxicity.gradient(*x, flat, owner, share, y)):
        for at in np.ndindex(*shapes[k]):
            step = [v.copy() for v in x]
            step[k][at] += 1e-6
            up = loss(*step)
            step[k][at] -= 2e-6
            assert math.isclose((up - loss(*step)) / 2e-6, g[at], rel_tol=1e-4, abs_tol=1e-8)


def test_a_long_text_gives_a_part_to_the_sample(spark):
    docs = spark.createDataFrame([(1, "é" * 5000), (2, "short"), (3, None), (4, "x" * 200)], "doc_id long, text string")
    chosen = spark.createDataFrame([(i, 0) for i in range(1, 5)], "doc_id long, y int")
    got = sorted(len(r["text"]) for r in toxicity.bounded_texts(docs, chosen, (6400, 1)).collect())
    assert got == [5, 100, 200]
    assert toxicity.bounded_texts(docs, chosen, (300, 1)).count() >= 1


def test_risk_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    f, m = rng.normal(size=30), 10
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def risk(f, prior):
        loss, as_negative = np.logaddexp(0, -f), np.logaddexp(0, f)
        if prior is None:
            return (loss[:m].mean() + as_negative[m:].mean()) / 2
        negative = as_negative[m:].mean() - prior * as_negative[:m].mean()
        return prior * loss[:m].mean() + negative if negative >= 0 else -negative

    for prior in (None, 0.3, 3.0):  # the last makes the negative part negative
        g = quality.risk_gradient(sigmoid(f), f, m, prior)
        for k in range(30):
            step = np.eye(30)[k] * 1e-6
            assert math.isclose((risk(f + step, prior) - risk(f - step, prior)) / 2e-6, g[k], rel_tol=1e-4, abs_tol=1e-8)


def test_prior_from_scores():
    rng = np.random.default_rng(5)
    for prior in (0.2, 0.5, 0.85):
        positive, unlabelled = rng.normal(2, 1, 3000), np.concatenate([rng.normal(2, 1, int(6000 * prior)), rng.normal(-2, 1, 6000 - int(6000 * prior))])
        assert abs(quality.estimate_prior(positive, unlabelled) - prior) < 0.06


def test_language_scores_equal_a_plain_loop(spark):
    docs = spark.createDataFrame([(i, t, la) for i, (t, la) in enumerate([("the cat and dog", "en"), ("der hund und katze", "de"), ("это кот", "ru")] * 4)], "doc_id long, text string, lang string")
    model = language.fit(docs, 5, 99)
    counts = {la: np.zeros(language.BUCKETS) for la in ("de", "en", "ru")}
    for r in docs.collect():
        for w in r["text"].split():
            for g in grams_of(w, language.LOW, language.HIGH, language.BUCKETS):
                counts[r["lang"]][g] += 1
    want = np.stack([np.log((c + 0.2) / (c.sum() + 0.2 * language.BUCKETS)) for c in counts.values()], 1)
    assert model.languages == ["de", "en", "ru"] and np.allclose(model.log_p, want, atol=1e-4)
    own = language.Lettered(pa.array(["dog"]))
    assert np.allclose(own.grams.sums(model.log_p)[0], sum(want[g] for g in grams_of("dog", language.LOW, language.HIGH, language.BUCKETS)), atol=1e-3)


def best_path(scores, penalty):
    """Best sum of scores less penalties, by trying every path."""
    paths = [(s, [k]) for k, s in enumerate(scores[0])]
    for row in scores[1:]:
        paths = [(s + x - penalty * (p[-1] != k), [*p, k]) for s, p in paths for k, x in enumerate(row)]
    return max(s for s, _ in paths)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    counts = np.array([5, 1, 0, 6, 3])
    scores = rng.normal(size=(counts.sum(), 3))
    starts = np.cumsum(counts) - counts
    path = language.viterbi(scores, starts, counts, 0.7)
    for at, n in zip(starts, counts, strict=True):
        own = path[at : at + n]
        if n:
            value = scores[np.arange(at, at + n), own].sum() - 0.7 * (own[1:] != own[:-1]).sum()
            assert math.isclose(value, best_path(scores[at : at + n], 0.7))


def test_language_spans_and_scripts(spark):
    en, de = "the cat and the dog with this thing", "der hund und die katze nicht schön über"
    rows = [(i, (en, de, "это русский текст про кота")[i % 3] * (1 + i % 4), ("en", "de", "ru")[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert [lang for lang, _ in language.spans(f"{en} {de}", model)] == ["en", "de"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_language_of_odd_and_empty_tables(odd, nothing):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(odd).collect()]
    assert {i for i, p, _ in got if p == "und"} == {3, 4, 7} and all(0 <= s <= 1 for _, _, s in got)
    assert language.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", odd["lang"].substr(9, 0)).where("false").unionByName(odd.selectExpr("doc_id", "text", "cast(null as string) as lang", "score", "shingles", "length"))).collect()} == {"und"}


@pytest.mark.parametrize("head", [lm.HEAD, 200])
def test_base_scores_equal_brute_force(documents, head):
    docs = documents.limit(80)
    rows = [(r["doc_id"], words_of(r["text"]) + ["\0"]) for r in docs.collect()]
    c = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    total = sum(c.values())
    got = {r["doc_id"]: r for r in lm.lm_scores(docs, head=head).collect()}
    for i, t in rows:
        want = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in t)
        r = got[i]
        assert math.isclose(r["base_score"], want, rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), total)
    assert np.mean([r["score"] > r["base_score"] for r in got.values()]) > 0.9


def small_network(kind=np.float64):
    rng = np.random.default_rng(5)
    v = lm.vocabulary(np.arange(7, 47, dtype=np.uint64), rng.integers(0, 3, 40), rng.integers(1, 90, 40), size=6)
    sequence, counts = rng.integers(0, v.end, 300), np.array([100, 120, 80])
    sequence[np.cumsum(counts) - 1] = v.end
    return v, lm.start_weights(v, kind=kind), sequence, np.cumsum(counts) - counts, counts


def test_the_network_is_a_distribution():
    v, w, sequence, starts, counts = small_network()
    one = lambda seq: lm.log_likelihood(w, v, np.array(seq), np.array([0]), np.array([len(seq)]))
    assert math.isclose(sum(np.exp(one([3, 41, k])[-1]) for k in range(v.end + 1)), 1, rel_tol=1e-9)
    assert set(np.diff(v.bounds)) <= set(range(1, 7)) and len(v.bounds) - 1 + lm.SPELLINGS + 1 == v.classes
    joint = lm.log_likelihood(w, v, sequence, starts, counts)
    apart = np.concatenate([one(sequence[s : s + n]) for s, n in zip(starts, counts, strict=True)])
    assert np.allclose(joint, apart)  # lanes and windows change nothing


def test_scores_equal_a_plain_loop():
    v, w, sequence, starts, counts = small_network()
    want, h, before = [], np.zeros(lm.HIDDEN), v.end
    for token in sequence:
        h = h if before != v.end else np.zeros(lm.HIDDEN)
        x = w["e"][before] + w["g"][v.class_of[before]]
        z, k = 1 / (1 + np.exp(-(x[: lm.HIDDEN] + w["s"][0] * h))), np.tanh(x[lm.HIDDEN :] + w["s"][1] * h)
        h = h + z * (k - h)
        share = lambda row, all_rows: row - math.log(sum(math.exp(y) for y in all_rows))
        of_class = h @ w["v"] + w["c"]
        c = v.class_of[token]
        p = share(of_class[c], of_class)
        if token < v.words:
            own = [w["u"][i] @ h + w["d"][i] for i in range(v.bounds[c], v.bounds[c + 1])]
            p += share(own[token - v.bounds[c]], own)
        want.append(p)
        before = token
    assert np.allclose(lm.log_likelihood(w, v, sequence, starts, counts), want)


def test_the_gradient_equals_finite_differences():
    v, w, sequence, starts, counts = small_network()
    own = lm.lanes(sequence, starts, counts, 3, v.end)
    rng, h = np.random.default_rng(1), np.full((3, lm.HIDDEN), 0.1)
    grad, _ = lm.gradient(w, v, own, 30, 50, h, 1.0)

    def loss():
        states, _, _ = lm._window(w, v, own, 30, 50, h, False)
        return -lm.outputs(w, v, states, own.tokens[own.offsets[30] : own.offsets[50]])[0].sum()

    for name, x in w.items():
        places = np.argwhere(grad[name] != 0)
        for at in map(tuple, places[rng.permutation(len(places))[:6]]):
            x[at] += 1e-5
            up = loss()
            x[at] -= 2e-5
            assert math.isclose((up - loss()) / 2e-5, grad[name][at], rel_tol=1e-4, abs_tol=1e-7), (name, at)
            x[at] += 1e-5


def test_training_raises_the_likelihood():
    v, w, sequence, starts, counts = small_network(np.float32)
    trainer = lm.Trainer(w, v, 0.01)
    for _ in range(15):
        trainer.train(sequence, starts, counts)
    assert lm.log_likelihood(trainer.w, v, sequence, starts, counts).mean() > lm.log_likelihood(w, v, sequence, starts, counts).mean() + 0.1


def test_lm_of_odd_and_empty_tables(odd, nothing):
    rows = lm.lm_scores(odd).collect()
    assert len(rows) == 12 and {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 7)} == {1} and all(np.isfinite(r["score"]) for r in rows)
    assert lm.lm_scores(nothing).count() == 0


def test_pipeline_stages_keep_their_contract(spark, sf, documents, labels):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == documents.columns, name
        before, after = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, out))
        assert after <= before and len(after) > 0.5 * len(before)
        docs = spark.createDataFrame(out.toPandas(), documents.schema)
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    groups = brute_groups(list(rows))
    assert all(top == i for i, (n, top) in groups.items() if n)  # no near-duplicates are left
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()} == {i for i, _ in rows}


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf, odd, nothing, tmp_path):
    """Columns whose names clash pass through as they are; null, empty, long and repeated texts do not
    crash a stage; an empty table gives an empty one."""
    named = odd.withColumn("lang_pred", odd["lang"]).withColumn("found", odd["score"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, sf)
        assert out.columns == named.columns and out.schema == named.schema, name
        assert {r["score"] for r in out.collect()} == {0.5} and {r["found"] for r in out.collect()} == {0.5}
        assert stage(spark, nothing, sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).where("piece = 0").count() == 12
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, sf).count() == 0
    # a text without a letter goes, as do null and empty ones
    kept = corpus_pipeline.drop_unknown_language(spark, odd, sf)
    assert {3, 4, 7}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_pipeline_filters_by_its_models(spark, sf, documents, labels):
    """The first two stages against the operators' own scores, and clean documents stay."""
    score = toxicity.scorer(spark, toxicity.fit(documents, labels))
    want = {r["doc_id"] for r in documents.select("doc_id", score("text").alias("s")).where(f"s < {toxicity.THRESHOLD}").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, documents, sf).select("doc_id").collect()} == want
    found = language.identify(documents).where(f"score >= {corpus_pipeline.LEAST_SHARE}")
    assert {r["doc_id"] for r in corpus_pipeline.drop_unknown_language(spark, documents, sf).select("doc_id").collect()} == {r["doc_id"] for r in found.collect()}


def test_rows_of_one_id_join_their_groups(spark):
    a, b = "one two three four five six seven", "entirely other words stand in this text here"
    docs = spark.createDataFrame([(3, b), (4, a), (5, a), (5, b), (6, "a third text of a few words"), (6, None)], "doc_id long, text string")
    assert sorted({(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}) == [(3, 3), (4, 3), (5, 3), (6, 6)]
    rng = np.random.default_rng(6)
    base = [" ".join(rng.choice(list("abcdefghijklmnop"), 40)) for _ in range(9)]
    rows = [(int(rng.integers(25)), base[rng.integers(9)] + rng.choice(["", " x", " y z"])) for _ in range(60)]
    parent = {i: i for i, _ in rows}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    sets = [(i, {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)}) for i, t in rows]
    for i, x in sets:
        for j, y in sets:
            if 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, find(i)) for i in parent}


def test_topics_and_rounds_take_all_training_texts(spark):
    """No sample: the n-grams of every text are counted once, and every slice is in one round."""
    texts = [None, ""] + [f"{'wort' if i % 2 else 'parole'} w{i} x{i * i} ende." for i in range(1700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = lm.gram_totals(docs)
    words = [w for t in texts for w in (t or "").split()]
    grams = lm.Grams(pa.array(words), lm.LOW, lm.HIGH, lm.BUCKETS)
    want = sum(np.bincount(ids[fits], minlength=lm.BUCKETS) for ids, fits in grams.levels())
    assert np.array_equal(got.sum(0), want)
    assert lm.gram_totals(docs.where("doc_id < 2")).sum() == 0
    for n in (0, 1, 5, 90, 900):
        tokens = np.random.default_rng(n).integers(1, 100, n)
        shares = lm.rounds(tokens, 60, 4)
        assert [i for low, high in shares for i in range(low, high)] == list(range(n)) and len(shares) <= 6
