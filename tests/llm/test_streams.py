"""Decontamination, collocations and fill-in-middle: brute force, exact round trips, SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import collocations, decontamination, middle, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert rows(df.select(*names)) == sorted(cur.fetchall(), key=repr) and sorted(names) == sorted(df.columns)


# -- decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def hits(text, items, width):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        n = min(width, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == w[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(name)
    return len(own), hit, sorted(str(x) for x in found if x is not None)


ITEMS = [(1, "a b c d e f"), (2, "b c d"), (3, "x"), (4, None), (5, " , "), (6, "A b c, d e g"), (7, "é é é é é"), (None, "q r s t"), (10, "a b c d e f"), (2, "z z")]


@pytest.mark.parametrize(("most", "groups"), [(1000, 4), (7, 2), (6, 100)])
def test_leaks_against_brute_force(spark, most, groups):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice(["a", "b", "c", "d", "e", "f", "g", "x", "é", "q r s t", "B c D", "z"]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    texts += [(80, None), (81, ""), (82, " - "), (0, texts[0][1]), (83, "a b c d e f " * 500), (None, "x")]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in texts], "doc_id long, text string, items string, leak int")
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = decontamination.leaks(docs, benchmark, width=5, most=most, groups=groups, name="own").select("doc_id", "text", "own.*", "leak").collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, found = hits(r["text"], ITEMS, 5)
        assert (r["n_words"], {k for s in r["spans"] for k in range(s["word_from"], s["word_to"])}, sorted(r["items"])) == (n, hit, found)
        raw = (r["text"] or "").encode()
        for s in r["spans"]:
            assert words(raw[s["byte_from"] : s["byte_to"]].decode()) == words(r["text"])[s["word_from"] : s["word_to"]]
        assert sum(s["word_to"] - s["word_from"] for s in r["spans"]) == len(hit)


def test_matching_lengths_are_the_longest():
    rng = random.Random(2)
    items = [[rng.choice("abc").encode() for _ in range(rng.randrange(1, 14))] for _ in range(6)]
    own = decontamination.Automaton([(str(i), w) for i, w in enumerate(items)], 4)
    text = [rng.choice("abcd") for _ in range(400)]
    codes = pa.compute.fill_null(pa.compute.index_in(pa.array([t.encode() for t in text], pa.large_binary()), value_set=own.vocabulary), -1).to_numpy(zero_copy_only=False)
    own.least = 1
    place, _, deep = own.lengths(codes.astype(np.int64), np.arange(400) // 130)
    known = {tuple(w[a:b]) for w in items for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
    for p, d in zip(place, deep, strict=True):
        low = p // 130 * 130
        assert d == max(n for n in range(1, p - low + 2) if tuple(t.encode() for t in text[p - n + 1 : p + 1]) in known)


def test_leaking_spans_are_removed(spark, odd, nothing):
    docs = spark.createDataFrame([(1, "ü start: one two three four five, end. One two"), (2, "one two three four five six"), (3, None), (4, "clean ✓"), (5, "ONE two three four and ten words that are not in any test item")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    got = {r[0]: r[1] for r in decontamination.decontaminate(docs, items, longest=4, coverage=0.6, width=4).collect()}
    assert got == {1: "ü start: , end. One two", 3: None, 4: "clean ✓", 5: " and ten words that are not in any test item"}
    got = {r[0]: r[1] for r in decontamination.decontaminate(docs, items, longest=5, coverage=1.0, width=4).collect()}
    assert got[2] == " six" and got[5].startswith("ONE two")
    none = items.limit(0)
    assert rows(decontamination.digests(odd, none)) == rows(decontamination.digests(odd, items.where("item_id > 1")))
    assert decontamination.digests(nothing, items).count() == 0 and decontamination.decontaminate(odd, none).columns == odd.columns
    assert decontamination.digests(odd, none).count() == odd.count()


# -- collocations


def brute_phrases(docs, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cands = {p: c for p, c in own.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * c >= share * a and p in (q[:2], q[1:]) for q, c in cands.items()):
                continue
            score, k = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("slice_bytes", "hot", "parts"), [(6 << 20, 1 << 15, 4), (100, 5, 3)])
def test_phrases_against_brute_force(spark, monkeypatch, slice_bytes, hot, parts):
    rng = random.Random(9)
    bits = ["a", "B", "c", "é", "naïve", "Z\x00", "e", "of the", "of the sea", "漢 字", "\x85", "\xa0x"]
    docs = [(rng.choice(["en", "fr", None]), "".join(rng.choice(bits) + rng.choice([" ", " ", "\t ", ". ", "\r\n", ", "]) for _ in range(rng.randrange(80)))) for _ in range(120)]
    docs += [("en", None), (None, ""), ("de", "a b " * 50), ("de", "x " * 900), ("und", "a b c")] + docs[:2]
    monkeypatch.setattr(collocations, "PARTS", parts)
    monkeypatch.setattr(collocations, "SLICE", slice_bytes)
    table = spark.createDataFrame([(lang, t, "x", 1, 2) for lang, t in docs], "lang string, text string, phrase string, a int, n int").repartition(5)
    for top in (2000, 3):
        assert rows(collocations.top_phrases(table, top=top, hot=hot, least=4)) == brute_phrases(docs, 4, 50, top)
    assert rows(collocations.top_phrases(table, share=1, hot=hot)) == brute_phrases(docs, 10, 1, 2000)


def test_phrases_of_odd_and_empty_tables(odd, nothing):
    want = brute_phrases([(r["lang"], r["text"]) for r in odd.collect()], 10, 50, 2000)
    assert rows(collocations.top_phrases(odd)) == want and want[0][2] == "word word word"
    assert collocations.top_phrases(nothing).count() == 0


# -- fill-in-middle


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middle_against_brute_force(spark, documents, odd, nothing):
    rng = random.Random(3)
    bits = ["\n", "\n", "a line of text\n", "é漢😀", "<", "P>", "S", ">", "<M", "\r\n", "x" * 70, "shared words in many texts " * 20, "a" * 9000, "\x0b", "<S>" * 1]
    texts = [(i, "".join(rng.choice(bits[: rng.choice([4, 14, 15])]) for _ in range(rng.randrange(40)))) for i in range(300)]
    own = spark.createDataFrame([(i, t, "x", 1) for i, t in texts + [(None, "a\nb"), (7, None), (8, ""), (9, "line\n" * 30_000)]], "doc_id long, text string, form string, n int")
    for docs in (own, odd, documents.limit(80)):
        got = middle.fill_in_middle(docs, most=50_000)
        texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        want = Counter({(i, *brute_middle(i, t)): 0 for i, t in texts})
        for (i, t), k in texts.items():
            want[(i, *brute_middle(i, t))] += k
        assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got.collect()) == want
        back = Counter((r[0], r[1]) for r in got.select("doc_id", middle.restored(got["output"], got["form"])).collect())
        assert back == Counter({k: 0 for k in back}) + Counter((i, t or "") for i, t in texts.elements())
    assert middle.fill_in_middle(nothing).count() == 0


def test_shared_passages_are_summarised_once():
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh \n") for _ in range(60_000))
    memo = middle.Memo()
    for k in range(6):
        middle.Chunks(pa.array(["x" * k + passage, f"{k} other {passage}"]), memo)
    assert memo.asked > 10 * memo.computed / 2 and memo.computed < 60_000 / 100
    small = middle.Memo(1000)
    chunks = middle.Chunks(pa.array([passage] * 3), small)
    assert small.size < 20_000 and (chunks.n == passage.count("\n") + (passage[-1] != "\n")).all()
