"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

MOST_ROUNDS = 60


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: a star for each tree. Fewer rows, the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(x, root(x)) for x in list(parent)]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least.select("a", F.least("a", "m").alias("m")), "a")
    return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    hung = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return hung.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of `edges` (a, b), by alternating large and small stars.

    Each round is written to the shared folder, so lineage stays short; nothing but a sum comes to the driver. Self-loops
    and repeated edges are allowed; an empty edge list gives an empty result."""
    now = written(edges.select("a", "b").filter("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        was, now = now, written(_small_star(_large_star(now)), "stars")
        discard(was)
        # a forest of stars is a fixed point of both steps
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
