"""Operator 4: n-gram Jaccard join of documents by blocked sparse products.

A document is a row of a sparse incidence matrix whose columns are 5-word shingles (64-bit hashes).
Two documents link when 100 * |A and B| >= 80 * |A or B|. The steps:

1. Documents with equal sets are one class, found by a 128-bit print of the sorted set.
2. Columns are ordered from rare to frequent (frequencies from a hash-drawn sample, which steers
   cost and never results). Linked sets must share a column among the first
   n - ceil(0.8 n) + 1 of each, the prefix. The rows of every prefix column are counted exactly.
   The product of the prefix matrix with its transpose is formed column by column: a column of few
   rows gives its pairs of compatible sizes. A crowded column is cut into cells of similar set
   sizes, two overlapping grids of cells, so that any two compatible sizes share a cell; each cell
   gives a star around its smallest id, by plain aggregation and joins.
3. Overlap counts of pairs are added up over columns. A pair that shares no crowded column has
   its whole prefix overlap there; pairs below the bound that sizes and overlap imply are dropped.
4. What is left, with the stars, joins documents to clusters. Inside a cluster whole rows meet in
   tiles of bounded size, only tiles of compatible set sizes; each tile pair is one incidence
   product that yields exact overlaps and gives back a spanning forest of the links, never all pairs.
5. Connected components of the links.

Null, empty and blank texts have no set (n_shingles 0) and link with nothing. Texts of 1 to 4
words have the whole sequence as their only shingle. Repeated rows (same id and text) are one
document; different texts under one id are one node of the graph, which has the links of both. A
null id is never part of a link. Ties: a group takes its smallest id. Extra columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, give_back, local_forest, materialize, mix, slices, small_enough, together, word_hashes
from .components import components, same_id

WORDS = 5
#: One document in so many is drawn for column frequencies; columns seen this often there count
#: as frequent; at most so many are remembered, the most frequent (they order columns only).
DRAWN, SEEN, FREQUENT = 8, 2, 1 << 20
#: Rows up to which a column gives all its pairs.
CROWDED = 64
#: Ratio of the greatest to the smallest set size in a cell of a crowded column: its root is above 1.25,
#: the ratio of the sizes of linked sets.
CELL = 1.6
#: Documents in a tile, set elements of small clusters handled by one task.
TILE, UNIT = 256, 400_000

_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(text: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(text)
    h = mix(word_hashes(words.distinct))[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    rolled = np.zeros(len(h), np.uint64)
    for k in range(size):
        ahead = np.zeros(len(h), np.uint64)
        ahead[: max(0, len(h) - k)] = h[k:]
        rolled = rolled * _P + ahead
    rolled = mix(rolled)
    found = []
    for at, n in zip(words.starts, words.counts, strict=True):
        if n >= size:
            found.append(np.unique(rolled[at : at + n - size + 1]).view(np.int64))
        elif n:
            value = np.array([n], np.uint64)  # an array: its overflow is silent
            for x in h[at : at + n]:
                value = value * _P + x
            found.append(mix(value).view(np.int64))
        else:
            found.append(np.zeros(0, np.int64))
    return found


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent columns, sorted, and their counts in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches):
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["shingle"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(DRAWN)) == 0).select("text")
    counts = materialize(drawn.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN))
    # by sixteenths of a doubling: few groups whatever the counts
    size = F.floor(16 * F.log2("n"))
    least, total = 0, 0
    for row in counts.groupBy(size.alias("size")).agg(F.count("*").alias("c")).orderBy(F.col("size").desc()).collect():
        if total + row["c"] > FREQUENT:
            # of equally frequent columns as many as fit, by hash
            share = (FREQUENT - total) / row["c"]
            least = row["size"]
            counts = counts.where((size > least) | ((size == least) & (F.pmod(F.xxhash64("shingle"), F.lit(1 << 20)) < int(share * (1 << 20)))))
            break
        total += row["c"]
    got = counts.toArrow()
    hashes, n = got.column("shingle").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _prefixes(docs: DataFrame, frequent) -> DataFrame:
    """doc_id, n, print of the set and its prefix from rare to frequent columns."""
    import xxhash

    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = shared.value
        for batch in together(batches):
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                rank = np.zeros(len(flat), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
                    rank = np.where(hashes[at] == flat, counts[at], 0)
                rows, at = [[], [], [], []], 0
                for own in sets:
                    n = len(own)
                    order = np.lexsort((own, rank[at : at + n]))[: prefix_length(n)] if n else []
                    at += n
                    mark = xxhash.xxh3_128_intdigest(own.tobytes())
                    for column, x in zip(rows, (n, (mark >> 64) - (1 << 63), (mark & (2**64 - 1)) - (1 << 63), own[order].tobytes() if n else b""), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.binary() if i == 3 else pa.int64()) for i, x in enumerate(rows))], ["doc_id", "n", "f1", "f2", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, prefix binary")


def _columns(classes: DataFrame) -> DataFrame:
    """(shingle, doc, n): the prefix incidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(b, np.int64) for b in batch.column("prefix").to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
            docs, n = (np.repeat(batch.column(c).to_numpy(), sizes) for c in ("doc_id", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(docs), pa.array(n)], ["shingle", "doc", "n"])

    return classes.select("doc_id", "n", "prefix").mapInArrow(run, "shingle long, doc long, n long")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (shingle, doc, n) sorted by shingle, none of them crowded: pairs of compatible sizes."""

    def finished(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.nonzero(np.diff(rows[0], prepend=rows[0, 0] - 1 if rows.shape[1] else 0))[0]
        sizes = np.diff(np.append(starts, rows.shape[1]))
        for g in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(g, 1)
            own = starts[sizes == g][:, None]
            left, right = rows[1:, (own + i).ravel()], rows[1:, (own + j).ravel()]
            fits = (5 * np.minimum(left[1], right[1]) >= 4 * np.maximum(left[1], right[1])) & (left[0] != right[0])
            left, right = left[:, fits], right[:, fits]
            flip = left[0] > right[0]
            (a, na), (b, nb) = np.where(flip, right, left), np.where(flip, left, right)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, na, nb)], ["a", "b", "na", "nb"])

    rest = np.zeros((3, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], 1)
        cut = np.searchsorted(rows[0], rows[0, -1]) if rows.shape[1] else 0
        yield from finished(rows[:, :cut])
        rest = rows[:, cut:]
    yield from finished(rest)


def _stars(columns: DataFrame, crowded: DataFrame) -> DataFrame:
    """(a, b) of every row of a crowded column with the smallest id of each of its two cells."""
    step = math.log(CELL)
    at = F.log(F.col("n").cast("double")) / step
    cells = F.explode(F.array(F.floor(at) * 2, F.floor(at + 0.5) * 2 + 1)).alias("cell")
    rows = columns.join(crowded, "shingle").select("shingle", "doc", cells)
    heads = rows.groupBy("shingle", "cell").agg(F.min("doc").alias("head"), F.count("*").alias("rows")).where("rows > 1").select("shingle", "cell", "head")
    return rows.join(heads, ["shingle", "cell"]).where("doc <> head").select(F.col("doc").alias("a"), F.col("head").alias("b"))


def tile_links(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between rows `left` and rows `right`: the incidence product
    over the columns that at least two rows share, in blocks of columns."""
    sizes = np.array([len(s) for s in sets], np.int64)
    columns, at, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = uses[at] > 1
    at, owner = at[shared], owner[shared]
    number = np.cumsum(uses > 1) - 1
    at, width = number[at], int((uses > 1).sum())
    overlap = np.zeros((len(left), len(right)), np.float32)
    step = max(256, (4 << 20) // max(1, len(sets)))
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for low in range(0, width, step):
        s, e = np.searchsorted(at, [low, low + step])
        block = np.zeros((len(sets), min(step, width - low)), np.float32)
        block[owner[s:e], at[s:e] - low] = 1
        overlap += block[left] @ block[right].T
    total = sizes[left][:, None] + sizes[right][None]
    i, j = np.nonzero((9 * overlap.astype(np.int64) >= 4 * total) & (ids[left][:, None] != ids[right][None]))
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return local_forest(ids[left][i], ids[right][j])


def _link_unit(data: pa.Table) -> pa.Table:
    """Links of one unit: several small clusters, or two tiles of a large one."""
    cluster, ids = data.column("cluster").to_numpy(), data.column("doc_id").to_numpy()
    own, a, b = data.column("tile").to_numpy(), data.column("ti")[0].as_py(), data.column("tj")[0].as_py()
    raw = data.column("shingles").to_pylist()
    order = np.argsort(cluster, kind="stable")
    cuts = np.nonzero(np.diff(cluster[order]))[0] + 1
    us, vs = [], []
    for rows in np.split(order, cuts):
        sets = [np.frombuffer(raw[r], np.int64) for r in rows]
        u, v = tile_links(ids[rows], sets, np.nonzero(own[rows] == a)[0], np.nonzero(own[rows] == b)[0])
        us.append(u)
        vs.append(v)
    return pa.table({"a": pa.array(np.concatenate(us)), "b": pa.array(np.concatenate(vs))})


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, ...), a row per document, with the document's whole shingle set."""
    names = [c for c in wanted.columns if c != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches):
            for part in slices(batch):
                sets = pa.array([s.tobytes() for s in shingle_sets(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(part.column(c) for c in names), sets], ["doc_id", *names, "shingles"])
        give_back()

    joined = docs.select("doc_id", "text").join(small_enough(wanted, 8 * len(wanted.columns)), "doc_id")
    schema = ", ".join(["doc_id long", *(f"{c} {t}" for c, t in wanted.dtypes if c != "doc_id"), "shingles binary"])
    return joined.select("doc_id", "text", *names).mapInArrow(run, schema)


def jaccard_components(docs: DataFrame, crowded: int = CROWDED, tile: int = TILE, unit: int = UNIT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs."""
    docs = docs.select("doc_id", "text")
    frequent = _frequent(docs)
    rows = materialize(_prefixes(docs, frequent))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    heads = rows.where("n > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    columns = _columns(heads)
    many = materialize(columns.groupBy("shingle").agg(F.count("*").alias("rows")).where(F.col("rows") > crowded).select("shingle"))
    many = small_enough(many, 8)
    few = columns.join(many, "shingle", "left_anti").repartition("shingle").sortWithinPartitions("shingle")
    pairs = few.mapInArrow(_pairs, "a long, b long, na long, nb long").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    least = lambda n: F.ceil(F.lit(4) * F.col(n) / 5) - 1
    bound = F.col("c") + F.greatest(least("na"), least("nb"))
    near = pairs.where(9 * bound >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")
    clusters = materialize(components(near.union(_stars(columns, many))))
    members = clusters.union(clusters.select(F.col("component").alias("id"), "component").distinct())
    sized = members.join(heads.groupBy(F.col("doc_id").alias("id")).agg(F.max("n").alias("n")), "id").select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"), "n")
    own = same_id(rows.where("n > 0 and doc_id is not null"), "doc_id", ["f1", "f2"], classes)
    groups = components(_cluster_links(docs, materialize(sized), tile, unit).unionByName(own))
    of_class = classes.join(groups, F.col("rep") == groups["id"], "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    return rows.join(of_class, ["f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """docs without the documents that a smaller id of their group stands for. Documents without
    words stay. Where ids repeat or are null, every row is a document of its own: rows are numbered,
    and of a group the first row stays."""
    unique = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null").isEmpty()
    if unique:
        return _without_copies(docs, "doc_id")
    node = "row"
    while node in docs.columns:
        node += "_"
    numbered = materialize(docs.withColumn(node, F.monotonically_increasing_id()))
    return _without_copies(numbered, node).drop(node)


def _without_copies(docs: DataFrame, key: str) -> DataFrame:
    found = jaccard_components(docs.select(F.col(key).alias("doc_id"), "text"))
    dropped = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)))
    return docs.join(small_enough(dropped, 16), key, "left_anti").select(*(docs[f"`{c}`"] for c in docs.columns))


def _cluster_links(docs: DataFrame, members: DataFrame, tile: int, unit: int) -> DataFrame:
    """Spanning forests of the links inside clusters. Small clusters share units; a large one is
    cut by set size, a factor of 1.3 apart, and then by hash, and neighbouring tiles meet. A
    document's set is computed once and copied to its tiles afterwards."""
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    counts = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("elements"))
    large = counts.where((F.col("docs") > tile) | (F.col("elements") > unit)).select("cluster")
    units = max(1, -(-total // unit))
    nothing = F.lit(None).cast("long")
    small = members.join(large, "cluster", "left_anti").select("doc_id", "cluster", F.pmod(F.xxhash64("cluster"), F.lit(units)).alias("unit"), nothing.alias("band"), nothing.alias("tile"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.3)))
    cut = members.join(large, "cluster", "left_semi").withColumn("band", band)
    bands = materialize(cut.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count("*") / F.lit(tile)), F.ceil(F.sum("n") / F.lit(unit))).alias("tiles")))
    own = cut.join(bands, ["cluster", "band"]).select("doc_id", "cluster", nothing.alias("unit"), "band", (F.col("band") * (1 << 32) + F.pmod(F.xxhash64("doc_id"), F.col("tiles"))).alias("tile"))
    sets = materialize(_sets_of(docs, materialize(small.unionByName(own))))
    zero = F.lit(0).cast("long")
    in_units = sets.where("unit is not null").select("doc_id", "cluster", F.lit(False).alias("big"), F.col("unit").alias("key"), zero.alias("tile"), zero.alias("ti"), zero.alias("tj"), "shingles")
    other = small_enough(bands.select("cluster", F.col("band").alias("with"), F.col("tiles").alias("of")), 24)
    meets = sets.where("unit is null").withColumn("with", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).join(other, ["cluster", "with"])
    meets = meets.withColumn("s", F.explode(F.sequence(zero, F.col("of") - 1))).withColumn("other", F.col("with") * (1 << 32) + F.col("s"))
    in_tiles = meets.select("doc_id", "cluster", F.lit(True).alias("big"), F.col("cluster").alias("key"), "tile", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "shingles")
    return in_units.unionByName(in_tiles).groupBy("big", "key", "ti", "tj").applyInArrow(_link_unit, "a long, b long")
