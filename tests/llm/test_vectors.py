"""Exact top-k and near-duplicate vectors against brute force."""

import numpy as np
import pytest

from sluice.llm import components, vectors
from sluice.llm.common import local_forest

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1.0) for i, v in rows], SCHEMA)


def brute_top(rows, k, every):
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for q, x in good:
        if q % every == 0:
            scored = sorted((-int(x @ y), i) for i, y in good if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "bins"), [(300, 8, 256), (90, 3, 4), (25, 5, 16)])
def test_top_k_is_exact(spark, n, dim, bins):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=dim).round(1).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(60)]  # ties beyond k
    rows += [(900, None), (901, [float("nan")] * dim), (902, [None] * dim), (903, [float("inf")] * dim), (904, [0.0] * dim)]
    got = sorted(tuple(r) for r in vectors.exact_top_k(frame(spark, rows), k=7, query_every=5, bins=bins).collect())
    assert got == brute_top(rows, 7, 5)


def test_top_k_of_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [0.0, 0.0])]
    assert sorted(tuple(r) for r in vectors.exact_top_k(frame(spark, rows), k=20, query_every=2).collect()) == brute_top(rows, 20, 2)
    assert vectors.exact_top_k(frame(spark, [])).count() == 0


def test_repeated_query_rows_each_get_their_list(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(40)] + [(20, [0.5, 0.5, 0.0, 1.0]), (7, [1.0, 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    got = sorted(tuple(r) for r in vectors.exact_top_k(frame(spark, rows), k=10, query_every=20).collect())
    want = []
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None]
    for q, x in [(i, v) for i, v in good if i % 20 == 0]:
        scored = sorted((-int(x @ y), i) for i, y in good if i != q)[:10]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert got == sorted(want) and sum(q == 20 for q, *_ in got) == 20


def test_components_beyond_64_bits_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [1e30, 0.0]), (3, [0.5, 0.5])]
    got = sorted(tuple(r) for r in vectors.exact_top_k(frame(spark, rows), k=5, query_every=10).collect())
    assert got == brute_top([r for r in rows if r[0] != 2], 5, 10)


def test_repeated_and_null_ids_share_or_lack_a_node(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a), (4, [0.0, 0.0, 1.0, 0.0])]
    got = [(r["vec_id"], r["component_id"], r["n_links"]) for r in vectors.near_duplicate_vectors(frame(spark, rows)).collect()]
    assert len(got) == 6 and {(i, c) for i, c, _ in got if i in (2, 3, 4)} == {(2, 1), (3, 1), (4, 4)} and (None, None, 0) in got


def brute_links(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    g = x @ x.T >= 0.9
    np.fill_diagonal(g, False)
    ids = np.array([i for i, _ in good])
    a, b = np.nonzero(g)
    low = dict(zip(*local_forest(ids[a], ids[b]), strict=True)) if len(a) else {}
    links = dict(zip(ids, g.sum(1), strict=True))
    return {i: (int(links.get(i, 0)), int(low.get(i, i))) for i, _ in rows}


def test_near_duplicates_reach_their_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 40)  # the hot group spans several tiles
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(400)]
    for base in (3, 5, 8):
        rows += [(len(rows) + k, (np.array(rows[base][1]) + rng.normal(scale=0.12, size=32)).tolist()) for k in range(70)]
    rows += [(1000 + k, rows[9][1]) for k in range(50)]
    rows += [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [None] * 32)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicate_vectors(frame(spark, rows)).collect()}
    want = brute_links(rows)
    assert set(got) == set(want)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert all(g[0] <= want[i][0] and g[2] == (g[1] == i) for i, g in got.items())
    assert sum(g[1] == want[i][1] for i, g in got.items()) >= 0.98 * len(want)
    assert all(got[i] == (0, i, True) for i in (2000, 2001, 2002, 2003))
    assert vectors.near_duplicate_vectors(frame(spark, [])).count() == 0


def test_given_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute_links(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicate_vectors(df).collect()} == want


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101), (101, 100), (7, 7), (None, 5), (205, 200)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 103: 100, 205: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_of_one_id_join_their_groups(spark):
    a, b = [1.0, 0.0, 0.0, 0.2], [0.0, 1.0, 0.3, 0.0]
    got = near(spark, [(3, b), (4, a), (5, a), (5, b), (6, [0.0, 0.0, 0.0, 1.0]), (7, [0.0] * 4)])
    assert sorted(set((r[0], r[2]) for r in got)) == [(3, 3), (4, 3), (5, 3), (6, 6), (7, 7)]
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(40)), (np.eye(8)[rng.integers(8)] + 0.02 * rng.normal(size=8)).tolist()) for _ in range(60)]
    parent = {i: i for i, _ in rows}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i, x in rows:
        for j, y in rows:
            if np.dot(x, y) >= 0.9 * np.linalg.norm(x) * np.linalg.norm(y):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    assert {(r[0], r[2]) for r in near(spark, rows)} == {(i, find(i)) for i in parent}


def near(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicate_vectors(df).collect()]
