"""Training order, SentencePiece and packing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import ordering, packing, pieces, subwords
from sluice.llm.common import materialize, shared_dir

PATH = subwords.vocabulary_path()


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_subwords_equal_the_library():
    texts = ["Hello, World!! don't it's", "a<|endoftext|>B <|STARTOFTEXT|>", "é É ﬁ ß Σας", "x.y z... '", "日本、語。", None, "", " \t\n", "A´B ́c 12.5% (abc)", "naïve! café?"]
    for some in (texts, [t for t in texts if not t or "<|" not in t]):
        ids, counts = subwords.encode(pa.array(some), PATH)
        want = reference_ids(some)
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000, 4097])
def test_permutation_and_its_inverse(size):
    p = ordering.permute(np.arange(size), size)
    assert sorted(p) == list(range(size)) and (ordering.permute(p, size, back=True) == np.arange(size)).all()


@pytest.mark.parametrize(("parts", "stride", "per_shard"), [(1, 64, 16), (7, 33, 5), (40, 4096, 3)])
def test_shards_hold_the_stream(spark, documents, parts, stride, per_shard):
    docs = materialize(documents.limit(60).repartition(parts, "doc_id"))
    path = shared_dir(spark)
    n = ordering.write_shards(docs, path, stride, per_shard)
    rows = ordering.read_slots(spark, path, n, 0, stride, per_shard, with_ids=True).toPandas().sort_values("sequence")
    stream = [i for x in reference_ids([r["text"] for r in docs.collect()]) for i in [*x, 0]]
    flat = np.concatenate(rows["ids"].to_list()).tolist()
    assert flat[: len(stream)] == stream and not any(flat[len(stream) :]) and len(flat) - len(stream) < stride
    assert rows["slot"].nunique() == n and ordering.read_slots(spark, path, n, 4, stride, per_shard).count() == max(0, n - 4)


def test_shards_of_odd_and_empty_tables(spark, odd, nothing):
    docs, path = materialize(odd.coalesce(1)), shared_dir(odd.sparkSession)
    n = ordering.write_shards(docs, path)
    rows = ordering.read_slots(odd.sparkSession, path, n, with_ids=True).toPandas().sort_values("sequence")
    stream = [i for x in reference_ids([r["text"] for r in docs.collect()]) for i in [*x, 0]]
    assert n == 3 and np.concatenate(rows["ids"].to_list()).tolist()[: len(stream)] == stream
    assert ordering.training_order(materialize(nothing)).count() == 0


def brute(text):
    model, whole = pieces.pieces(pieces.model_path()), pieces.normal(text)
    if not whole:
        return []
    _, back = model.forward(whole, 0, {0: 0}, 1)
    return model.trace(whole, back, len(whole), 0)[0]


def test_pieces_by_units_and_by_chunks():
    rng, bits = random.Random(4), ["a", "e", "the", "ing", " ", "  ", "\n", "é", "漢", "▁", "tion", "x", "\x01", "😀", "    "]
    path, model = pieces.model_path(), pieces.pieces(pieces.model_path())
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(150)] + ["".join(rng.choice("aeiontr") for _ in range(150)) for _ in range(20)]
    ids, counts = pieces.encode(pa.array(texts), path)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        want = brute(text)
        assert ids[at : at + n].tolist() == want
        at += n
        assert not text or model.decode(np.array(want, np.uint32)) == text
        for chunk in (16, 21):
            assert not text or pieces.encode_chunked(text, path, chunk) == want


def test_scores_mean_something(documents):
    """Against the vocabulary's own program: the same ids for most words, and no more of them."""
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), pieces.pieces(pieces.model_path())
    words = sorted({w for r in documents.limit(60).collect() for w in (r["text"] or "").split() if "▁" not in w})
    want = library.encode(words)
    own = [np.frombuffer(model.unit("▁" + w)[1], np.uint32).tolist() for w in words]
    assert np.mean([a == b for a, b in zip(own, want, strict=True)]) > 0.6
    assert sum(map(len, own)) <= 1.02 * sum(map(len, want))


def test_max_plus_scan_is_the_running_product():
    rng = np.random.default_rng(0)
    ms = [rng.integers(-50, 0, (4, 4)) for _ in range(9)]
    running = ms[0]
    for i, got in enumerate(pieces.scan(ms)):
        running = ms[0] if i == 0 else pieces.combine(running, ms[i])
        assert (got == running).all()


def test_documents_come_back(spark, documents, odd, nothing):
    for chunk in (200, 1 << 16):
        rows = pieces.digests(pieces.encode_documents(documents.limit(40), chunk=chunk)).collect()
        texts = {r["doc_id"]: r["text"] for r in documents.limit(40).collect()}
        assert all(r["decoded_equal"] for r in rows)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(brute(texts[r["doc_id"]]), np.uint32).tobytes()) for r in rows[:5])
    got = pieces.digests(pieces.encode_documents(odd, chunk=1000)).collect()
    assert len(got) == 12 and all(r["decoded_equal"] for r in got)
    assert pieces.digests(pieces.encode_documents(nothing)).count() == 0


def packed(df):
    return sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").toPandas().itertuples(index=False))


@pytest.mark.parametrize("capacity", [16, 100, 2048])
def test_packing_is_gapless_and_close_to_the_bound(documents, capacity):
    docs = documents.limit(120)
    rows = packing.best_fit_pack(docs, capacity).toPandas()
    for _, group in rows.groupby("sequence_id"):
        at = 0
        for offset, length in sorted(zip(group["offset"], group["length"], strict=True)):
            assert offset == at
            at += length
        assert at <= capacity
    want = {}
    for r, ids in zip(docs.collect(), reference_ids([x["text"] for x in docs.collect()]), strict=True):
        own = np.array([*ids, 0], "<u4")
        for k in range(0, len(own), capacity):
            want[r["doc_id"], k // capacity] = (k, len(own[k : k + capacity]), zlib.crc32(own[k : k + capacity].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows.itertuples()} == want
    assert rows["sequence_id"].nunique() <= np.ceil(rows["length"].sum() / capacity) * 1.05 + 2


def test_the_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    for histogram in (rng.integers(0, 50, 257), np.bincount([256] * 9 + [200] * 30, minlength=257), np.zeros(257, int)):
        histogram[0] = 0
        runs = packing.plan(histogram)
        used = np.zeros_like(histogram)
        room: dict[int, list] = {}
        for length, low, high, first, offset in runs:
            assert low == used[length]
            used[length] = high
            for k in range(high - low):
                room.setdefault(first + k, []).append((offset, length))
        assert (used == histogram).all()
        for own in room.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 256


def test_packing_of_odd_and_empty_tables(odd, nothing):
    rows = packing.best_fit_pack(odd).collect()
    assert sum(r["piece"] == 0 for r in rows) == 12 and {r["length"] for r in rows if r["doc_id"] in (3, 4, 7)} == {1}
    texts = [r["text"] for r in odd.select("doc_id", "text").collect()]
    want = [zlib.crc32(np.array(own[k : k + 2048], "<u4").tobytes()) for x in reference_ids(texts) for own in [[*x, 0]] for k in range(0, len(own), 2048)]
    assert sorted(r["ids_crc32"] for r in rows) == sorted(want)
    assert packing.best_fit_pack(nothing).count() == 0
