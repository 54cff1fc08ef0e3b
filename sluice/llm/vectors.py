"""Operators 6 and 10: near-duplicate vectors and exact top-k inner products.

Vectors that are null, or that hold null or non-finite components, take no part in either; for
cosine, neither do zero vectors. Rows whose id is null take no part in a search, nor do rows with a
scaled component so large that an inner product could leave 64 bits. Only vectors of the same
dimension are compared. Empty tables give no rows; extra columns are ignored.

Search: each row whose id is a query id is a query of its own, so an id that occurs twice gets two
lists of ranks; candidates are all rows but those with the query's id, and repeated ones count as
often as they occur. Ties go to the smaller id.
Near-duplicates: each row gets its line; rows that repeat an id share one node of the graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import local_forest, materialize
from .components import components, same_id

#: Rows of a block of vectors.
BLOCK = 1024


def usable(embedding: Column) -> Column:
    return embedding.isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


# --- operator 10 -------------------------------------------------------------------------------

K = 20
SCALE = 64.0
QUERY_EVERY = 20
BINS = 2048
#: Candidate blocks whose k-th score bounds the global one from below before the first histogram.
SEED_BLOCKS = 2
#: Block pairs that one cell of the grid holds.
CELL = 64
STATE = "q long, n int, ids binary, x binary, state binary"


def _blocks(df: DataFrame, dim: int, scale: float) -> DataFrame:
    """Blocks of rows: ids and floor(scale * x) as packed integers, with the greatest magnitude."""
    most_fit = math.isqrt((2**63 - 1) // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.floor(scale * matrix(part.column("embedding")))
                fits = (np.abs(x) <= most_fit).all(1)
                x, ids = x[fits].astype(np.int64), part.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)[fits]
                if len(ids):
                    most = int(np.abs(x).max(initial=0))
                    norm = float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0)))
                    x = x.astype(np.int32) if most < 2**31 else x
                    yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()), pa.array([most], pa.int64()), pa.array([norm])], ["n", "ids", "x", "most", "norm"])

    own = df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & (F.size("embedding") == dim))
    return own.select("vec_id", "embedding").mapInArrow(run, "n int, ids binary, x binary, most long, norm double")


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while every partial sum stays below 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def exact_top_k(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, scale: float = SCALE, bins: int = BINS) -> DataFrame:
    """Distributed histogram selection. Every query's range starts between its k-th score among a few
    candidate blocks, which the global k-th cannot be below, and the greatest product its length
    allows. Scores are computed block against block, in a grid of query groups and candidate groups.
    Each pass adds up, over all cells, a histogram per query of the scores inside its range, finds
    the bin that holds the k-th greatest and narrows the range to it, until the range is one value.
    A last pass keeps what lies above that value and, of its ties, the smallest ids. A cell reports
    only its bins from the top down to its own k-th score: the global k-th score cannot lie below it."""
    parts = [_top_k(vectors, row["d"], k, query_every, scale, bins) for row in vectors.where(usable(F.col("embedding"))).select(F.size("embedding").alias("d")).distinct().where("d > 0").toLocalIterator()]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for part in parts:
        out = out.unionByName(part)
    return out


def _unpack(ids: bytes, x: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(x, np.int32 if len(x) == len(ids) * dim * 4 else np.int64).reshape(len(ids), dim)


def _grid(queries: DataFrame, candidates: DataFrame, cells: int, ratio: float) -> DataFrame:
    """Every query block beside every candidate block, a query block's partners one after another in
    each cell. Query blocks are copied to all candidate groups and candidate blocks to all query
    groups; the groups' numbers keep what is copied least."""
    of_q = max(1, min(cells, round(math.sqrt(cells * ratio))))
    of_c = -(-cells // of_q)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("c", spread(of_c)).withColumn("g", F.pmod(F.xxhash64("q"), F.lit(of_q)) * of_c + F.col("c")).drop("c")
    right = candidates.select(F.pmod(F.xxhash64("ids", "x"), F.lit(of_c)).alias("c"), F.col("ids").alias("cids"), F.col("x").alias("cx"), spread(of_q).alias("r")).select((F.col("r") * of_c + F.col("c")).alias("g"), "cids", "cx")
    return left.join(right.hint("merge"), "g").drop("g")


def _top_k(vectors: DataFrame, dim: int, k: int, query_every: int, scale: float, bins: int) -> DataFrame:
    spark = vectors.sparkSession
    candidates = materialize(_blocks(vectors, dim, scale))
    blocks = materialize(_blocks(vectors.where(F.col("vec_id") % query_every == 0), dim, scale).withColumn("q", F.monotonically_increasing_id()))
    size, n_queries = candidates.agg(F.max("norm").alias("norm"), F.count("*").alias("n")).first(), blocks.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = max(1, min(size["n"] * n_queries, max(2 * spark.sparkContext.defaultParallelism, size["n"] * n_queries // CELL)))
    seed = [_unpack(r["ids"], r["x"], dim) for r in candidates.orderBy(F.xxhash64("ids")).limit(SEED_BLOCKS).collect()]
    shared = spark.sparkContext.broadcast((seed, size["norm"]))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per query: the lowest value of its range, the range's length, and how many of its greatest
        scores are wanted."""
        seed, norm = shared.value
        for batch in batches:
            states = []
            for ids, x in zip(batch.column("ids").to_pylist(), batch.column("x").to_pylist(), strict=True):
                qi, qx = _unpack(ids, x, dim)
                top = np.ceil(np.sqrt((qx.astype(np.float64) ** 2).sum(1)) * norm * (1 + 1e-9)).astype(np.int64) + 1
                low, found = -top, []
                for ci, cx in seed:
                    score = _scores(qx, cx)
                    found.append(np.where(qi[:, None] == ci[None], -(2**63) + 1, score))
                all_found = np.concatenate(found, 1)
                if all_found.shape[1] >= k:
                    low = np.maximum(low, np.partition(all_found, -k, axis=1)[:, -k])
                states.append(np.stack([low, top - low + 1, np.full(len(qi), k)]).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q", "n", "ids", "x")), pa.array(states, pa.binary())], ["q", "n", "ids", "x", "state"])

    def cells_of(batches: Iterator[pa.RecordBatch], take, flush) -> Iterator[pa.RecordBatch]:
        """Runs of one query block: take() each of its candidate blocks, then flush()."""
        at, held = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["q"] != at:
                    if held is not None:
                        yield flush(at, held)
                    at, held = r["q"], None
                (qi, qx), (ci, cx) = _unpack(r["ids"], r["x"], dim), _unpack(r["cids"], r["cx"], dim)
                held = take(held, qi, ci, _scores(qx, cx), np.frombuffer(r["state"], np.int64).reshape(3, -1), qi[:, None] == ci[None])
        if held is not None:
            yield flush(at, held)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def take(held, qi, ci, score, state, own):
            low, span, need = state
            i, j = np.nonzero((score >= low[:, None]) & (score < (low + span)[:, None]) & ~own)
            at = (score[i, j] - low[i]) // -(-span[i] // bins)
            flat = np.bincount(i * bins + at, minlength=len(qi) * bins).reshape(len(qi), bins)
            return (flat if held is None else held[0] + flat), need

        def flush(q, held):
            flat, need = held
            above = np.cumsum(flat[:, ::-1], 1)[:, ::-1] - flat
            i, b = np.nonzero((flat > 0) & (above < need[:, None]))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), q)), pa.array(i.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(flat[i, b].astype(np.int64))], ["q", "i", "bin", "n"])

        return cells_of(batches, take, flush)

    def narrow(data: pa.Table) -> pa.Table:
        """A query block with its bins' counts: the range becomes the bin that holds the k-th score.
        A query with fewer candidates than it wants keeps its lowest value and takes them all."""
        row = data.filter(data.column("state").is_valid())
        low, span, need = np.frombuffer(row.column("state")[0].as_py(), np.int64).reshape(3, -1).copy()
        found = data.filter(data.column("bin").is_valid())
        i, b, n = (found.column(c).to_numpy().astype(np.int64) for c in ("i", "bin", "count"))
        order = np.lexsort((-b, i))
        i, b, n = i[order], b[order], n[order]
        total, first = np.cumsum(n), np.searchsorted(i, i)
        upto = total - (total[first] - n[first])
        hit = (upto >= need[i]) & (upto - n < need[i])
        of = i[hit]
        need[of] -= (upto - n)[hit]
        width = -(-span // bins)
        low[of] += b[hit] * width[of]
        span = np.where(np.isin(np.arange(len(span)), of), width, 1)
        return pa.table({c: row.column(c) for c in ("q", "n", "ids", "x")} | {"state": pa.array([np.stack([low, span, need]).tobytes()], pa.binary()), "span": pa.array([int(span.max())])})

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What lies above the k-th score, and as many of its ties as are wanted."""

        def take(held, qi, ci, score, state, own):
            low, _, need = state
            i, j = np.nonzero((score >= low[:, None]) & ~own)
            rows = np.stack([i, qi[i], ci[j], score[i, j], score[i, j] > low[i]])
            return cut(rows if held is None else np.concatenate([held[0], rows], 1), need), need

        def cut(rows: np.ndarray, need: np.ndarray) -> np.ndarray:
            i, _, ids, _, over = rows
            order = np.lexsort((ids, -over, i))
            rows = rows[:, order]
            i, over = rows[0], rows[4]
            place = np.arange(len(i)) - np.searchsorted(i, i) - np.bincount(i, over, need.size).astype(np.int64)[i]
            return rows[:, (over == 1) | (place < need[i])]

        def flush(q, held):
            i, qi, ids, score, _ = held[0]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), q)), pa.array(i), pa.array(qi), pa.array(ids), pa.array(score)], ["q", "i", "query_id", "vec_id", "score"])

        return cells_of(batches, take, flush)

    ratio = n_queries / size["n"]
    state = materialize(blocks.mapInArrow(begin, STATE))
    while True:
        counted = _grid(state, candidates, cells, ratio).mapInArrow(histogram, "q long, i int, bin int, n long").groupBy("q", "i", "bin").agg(F.sum("n").alias("count"))
        none = lambda names: [F.lit(None).cast(t).alias(c) for c, t in names]
        both = state.select("q", "n", "ids", "x", "state", *none([("i", "int"), ("bin", "int"), ("count", "long")])).unionByName(counted.select("q", *none([("n", "int"), ("ids", "binary"), ("x", "binary"), ("state", "binary")]), "i", "bin", "count"))
        narrowed = materialize(both.groupBy("q").applyInArrow(narrow, STATE + ", span long"))
        state = narrowed.drop("span")
        if narrowed.where("span > 1").isEmpty():
            break
    # bounded: fewer than k rows above and at most k ties per query and cell, k rows per query after the cut
    kept = _grid(state, candidates, cells, ratio).mapInArrow(exact, "q long, i long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("q", "i").orderBy(F.col("score").desc(), "vec_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# --- operator 6 --------------------------------------------------------------------------------

COSINE = 0.9
#: Distinct vectors on which the rotations are learnt; every vector is indexed.
SAMPLE = 20_000
#: Mean rows that a bucket is meant to hold; recall at the threshold that the tables are meant to reach.
BUCKET, RECALL = 384, 0.98
ROUNDS = 25
#: Bits of the code by whose Hamming distance the rows of a bucket are compared first.
CODE_BITS = 256
#: Rows of a bucket that are compared at once; larger buckets are cut into tiles that meet pairwise.
TILE = 1024


def learn_rotations(sample: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """Iterative quantisation, `count` times from different starts: principal axes, then a rotation
    that brings the vectors close to the corners of a cube. Returns (count, dim, dim)."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    _, axes = np.linalg.eigh(sample.T @ sample + 1e-9 * np.eye(dim))
    v = sample @ axes
    found = []
    for _ in range(count):
        r = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.sign(v @ r + 1e-12).T @ v)
            r = (u @ w).T
        found.append(axes @ r)
    return np.stack(found)


def table_shape(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """Bits per table and number of tables for n vectors, from the chance that a bit agrees."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = max(4, min(40, math.ceil(math.log2(max(2, n / BUCKET)))))
    return bits, max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - agree**bits)))


def radius(bits: int, cosine: float = COSINE) -> int:
    """Hamming distance within which all but a few in a million pairs of that cosine lie."""
    differ = math.acos(cosine) / math.pi
    return math.ceil(bits * differ + 5 * math.sqrt(bits * differ * (1 - differ)))


def _tiles(data: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    tile = data.column("tile").to_numpy()
    return np.nonzero(tile == data.column("ti")[0].as_py())[0], np.nonzero(tile == data.column("tj")[0].as_py())[0]


def _near_codes(data: pa.Table, far: int, dim: int, bits: int) -> pa.Table:
    """Rows of a bucket, or of two tiles of it, that have a partner within Hamming distance `far` with
    whom they share no earlier table that the code shows."""
    raw = np.frombuffer(b"".join(data.column("code").to_pylist()), np.uint8).reshape(data.num_rows, -1)
    words = raw.view(np.uint64)
    ids, t = data.column("rep").to_numpy(), data.column("t")[0].as_py()
    left, right = _tiles(data)
    per = dim // bits
    shown = np.unpackbits(raw, axis=1, bitorder="little")[:, : raw.shape[1] * 8 // dim * dim].reshape(len(raw), -1, dim)[:, :, : per * bits].reshape(len(raw), -1, bits)[:, :t]
    flagged = np.zeros(len(ids), bool)
    for s in range(0, len(left), 128):
        own = left[s : s + 128]
        distance = sum(np.bitwise_count(words[own, None, k] ^ words[None, right, k]).astype(np.int16) for k in range(words.shape[1]))
        i, j = np.nonzero(distance <= far)
        i, j = own[i], right[j]
        new = ids[i] != ids[j]
        i, j = i[new], j[new]
        for c in range(0, len(i), 20_000):
            a, b = i[c : c + 20_000], j[c : c + 20_000]
            first = ~(shown[a] == shown[b]).all(2).any(1)
            flagged[a[first]] = flagged[b[first]] = True
    return data.select(["t", "key", "ti", "tj", "tile", "rep"]).filter(pa.array(flagged))


def _group_links(data: pa.Table, cosine: float) -> pa.Table:
    """Exact links among the rows kept of a bucket, or of two tiles of it, that no earlier table has found."""
    x = matrix(data.column("unit").combine_chunks())
    keys = np.stack(data.column("keys").combine_chunks().to_numpy(zero_copy_only=False))
    ids = data.column("rep").to_numpy()
    copies = data.column("copies").to_numpy()
    t, diagonal = data.column("t")[0].as_py(), data.column("ti")[0].as_py() == data.column("tj")[0].as_py()
    left, right = _tiles(data)
    links = np.zeros(len(ids), np.int64)
    us, vs = [], []
    for s in range(0, len(left), 512):
        own = left[s : s + 512]
        i, j = np.nonzero(x[own] @ x[right].T >= cosine)
        i, j = own[i], right[j]
        fine = ids[i] < ids[j] if diagonal else ids[i] != ids[j]
        i, j = i[fine], j[fine]
        new = ~(keys[i, :t] == keys[j, :t]).any(1)
        i, j = i[new], j[new]
        links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
        if len(i):
            u, v = local_forest(ids[i], ids[j])
            us.append(u)
            vs.append(v)
    u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
    some = links > 0
    return pa.table({"id": pa.array(np.concatenate([ids[some], u])), "links": pa.array(np.concatenate([links[some], np.zeros(len(u), np.int64)])), "low": pa.array(np.concatenate([ids[some], v]))})


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """Multi-index Hamming tables over learnt binary codes, reranked by exact cosine.

    Equal vectors are one class first, which counts with its copies. Each table takes a run of
    bits of a learnt rotation. What a bucket shuffles is ids and codes: inside it, rows within a
    Hamming radius of each other are candidates, in the first table they share. Only candidates
    fetch their vectors and are compared exactly, a pair in its first common table, so links are
    counted once. Buckets above TILE rows are cut into tiles and every two tiles meet in a task of
    their own: no pair is emitted, only rows, counts and a spanning forest. Zero and unusable
    vectors get no links and are their own component. A null id never links; rows of one id with
    different vectors are one node of the graph."""
    spark = vectors.sparkSession
    e = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    all_rows = vectors.select("vec_id", "embedding")
    good = all_rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("norm", norm).where("norm > 0 and norm < double('infinity')")
    keyed = good.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding", F.lit(2)))
    classes = materialize(keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first("norm").alias("norm")))
    found = None
    for row in classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy("d").toLocalIterator():
        own = classes.where(F.size("embedding") == row["d"]).select("rep", "copies", F.transform("embedding", lambda x: x.cast("double") / F.col("norm")).alias("unit"))
        part = _links(own, row["d"], row["n"], cosine, sample)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found)
    own = same_id(keyed, "vec_id", ["k1", "k2"], classes)
    groups = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(own))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.select("k1", "k2", "rep", "copies").join(links, F.col("rep") == links["id"], "left").drop("id").join(groups, F.col("rep") == groups["id"], "left")
    of_class = of_class.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = keyed.select("vec_id", "k1", "k2").join(of_class, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = all_rows.where(~F.coalesce(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & (norm > 0) & (norm < float("inf")), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, dim: int, n: int, cosine: float, sample: int) -> DataFrame:
    spark = classes.sparkSession
    bits, tables = table_shape(n, cosine)
    bits = min(bits, dim)
    per = dim // bits
    width = -(-CODE_BITS // dim)  # rotations that the code shows
    drawn = classes.orderBy(F.xxhash64("rep")).limit(sample).select("unit").toArrow()
    rotations = spark.sparkContext.broadcast(learn_rotations(matrix(drawn.column("unit").combine_chunks()), max(width, -(-tables // per))).astype(np.float64))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column("unit"))
            signs = [x @ r > 0 for r in rotations.value]
            keys = np.concatenate([s[:, : per * bits].reshape(len(x), per, bits) @ weight for s in signs], 1)[:, :tables].astype(np.int64)
            shown = np.concatenate(signs[:width], 1)
            packed = np.packbits(np.pad(shown, ((0, 0), (0, -shown.shape[1] % 64))), axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([row.tobytes() for row in packed], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["rep", "copies", "unit", "code", "keys"])

    coded = materialize(classes.select("rep", "copies", "unit").mapInArrow(code, "rep long, copies long, unit array<double>, code binary, keys array<long>"))
    spread = coded.select("rep", "code", F.posexplode("keys").alias("t", "key"))
    large = spread.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1").withColumn("tiles", F.ceil(F.col("size") / TILE))
    rows = spread.join(large.select("t", "key", "tiles"), ["t", "key"])
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("t", "key", F.least("tile", "with").alias("ti"), F.greatest("tile", "with").alias("tj"), "tile", "rep", "code")
    bucket, far = ["t", "key", "ti", "tj"], radius(width * dim, cosine)
    near = materialize(rows.groupBy(*bucket).applyInArrow(lambda data: _near_codes(data, far, dim, bits), "t int, key long, ti long, tj long, tile long, rep long"))
    full = near.join(coded.select("rep", "copies", "unit", "keys"), "rep")
    return full.groupBy(*bucket).applyInArrow(lambda data: _group_links(data, cosine), "id long, links long, low long")
