"""Connected components of an edge table by alternating large-star and small-star rounds.

Edges never leave the executors. Each round is written to the shared folder, so lineage stays
short; a hub's edges are divided by the join's skew handling and its minimum is a partial
aggregate. Rounds needed are logarithmic in the longest path in practice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import local_forest, materialize

#: Edges that a task contracts to a forest at once.
CHUNK = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def forest(held: list[np.ndarray]) -> pa.RecordBatch:
        a, b = local_forest(*np.concatenate(held, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        n += batch.num_rows
        if n >= CHUNK:
            yield forest(held)
            held, n = [], 0
    if n:
        yield forest(held)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node that some edge of (a, b) joins to a smaller one: component is
    the smallest id reachable. Nodes left out are their own component. Loops, repeated and reversed
    edges are fine; an edge with a null end is no edge."""
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = materialize(edges.mapInArrow(_contract, "a long, b long").distinct())
    print_of = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)).alias("h")).first()
    seen = print_of(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = materialize(small)
        if (new := print_of(now)) == seen:
            return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
        seen = new


def same_id(rows: DataFrame, key: str, prints: list[str], classes: DataFrame) -> DataFrame:
    """Edges (a, b) that join the classes (prints, rep) of rows with one id: such rows are one node."""
    repeated = rows.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").select(key)
    reps = rows.join(repeated, key, "left_semi").select(key, *prints).join(classes.select(*prints, "rep"), prints).select(key, "rep").distinct()
    return reps.join(reps.groupBy(key).agg(F.min("rep").alias("b")), key).select(F.col("rep").alias("a"), "b")
