"""Graph traversal by frontier joins: breadth first, relation filters, shortest paths, and depth first for small graphs."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed


def expand_levels(sources: DataFrame, edges: DataFrame, min_hops: int, max_hops: int | None, with_path: bool = False) -> DataFrame:
    """source, target, depth (and path, relation, weight of the last edge): each node that is reachable from a source,
    once, at its least depth, never the source itself.

    `sources` has a column `source`, `edges` has src and dst. The state is one row for each source and reached node; each
    level is checkpointed, and the loop ends with an empty frontier or, if it is given, at max_hops. Ties between edges that reach a node at one depth go to
    the smallest path."""
    keep = [c for c in ("relation", "weight") if c in edges.columns] if with_path else []
    links = edges.select("src", "dst", *keep).filter("src <> dst")
    if not with_path:
        links = links.distinct()
    frontier = sources.select("source").distinct().select("source", F.col("source").alias("node"), *([F.array("source").alias("path")] if with_path else []))
    reached: DataFrame | None = None
    for depth in itertools.count(1) if max_hops is None else range(1, max_hops + 1):
        met = frontier.join(links, frontier["node"] == links["src"]).filter("dst <> source")
        if with_path:
            met = met.select("source", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), *keep)
            best = F.row_number().over(Window.partitionBy("source", "node").orderBy("path", *keep))
            met = met.withColumn("_n", best).filter("_n = 1").drop("_n")
        else:
            met = met.select("source", F.col("dst").alias("node")).distinct()
        if reached is not None:
            met = met.join(reached.select("source", "node"), ["source", "node"], "left_anti")
        level = met.withColumn("depth", F.lit(depth))
        if max_hops is None or depth < max_hops:
            level = checkpointed(level)
            if level.isEmpty():
                break
        reached = level if reached is None else reached.unionByName(level)
        frontier = level.drop("depth", *keep)
    if reached is None:
        reached = frontier.limit(0).withColumn("depth", F.lit(0))
        for c in keep:
            reached = reached.withColumn(c, F.lit(None).cast(dict(links.dtypes)[c]))
    return reached.filter(F.col("depth") >= min_hops).withColumnRenamed("node", "target")


def traverse(edges: DataFrame, start: int, max_depth: int, relations: Sequence[str] | None = None) -> DataFrame:
    """target_id, depth, path, relation, weight of the last edge, for each node reached from `start`."""
    if relations is not None:
        edges = edges.filter(F.col("relation").isin(list(relations)))
    sources = edges.sparkSession.createDataFrame([(start,)], "source long")
    found = expand_levels(sources, edges, 1, max_depth, with_path=True)
    return found.select(F.col("target").alias("target_id"), "depth", "path", "relation", "weight")


def bfs(edges: DataFrame, start: int, max_depth: int | None = None) -> DataFrame:
    """node, depth of each node reached, the start with depth 0 included."""
    sources = edges.sparkSession.createDataFrame([(start,)], "source long")
    found = expand_levels(sources, edges, 1, max_depth).select(F.col("target").alias("node"), "depth")
    return sources.select(F.col("source").alias("node"), F.lit(0).alias("depth")).unionByName(found)


def dfs(edges: DataFrame, start: int, max_depth: int | None = None, max_edges: int = 1_000_000) -> DataFrame:
    """node, depth, position in pre-order. Depth first is sequential by nature, so what can be reached from `start` comes to
    the driver: only those edges, found breadth first by joins, and more than max_edges of them are an error. A node counts
    as visited when it is pushed."""
    near = bfs(edges, start, None if max_depth is None else max(0, max_depth - 1)).select(F.col("node").alias("src"))
    rows = edges.select("src", "dst").join(near, "src", "left_semi").orderBy("src", "dst").limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"depth-first order is for parts of at most {max_edges} edges")
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r["src"], []).append(r["dst"])
    stack, seen, order = [(start, 0)], {start}, []
    while stack:
        node, depth = stack.pop()
        order.append((node, depth, len(order)))
        if max_depth is None or depth < max_depth:
            for n in reversed(out.get(node, ())):
                if n not in seen:
                    seen.add(n)
                    stack.append((n, depth + 1))
    return edges.sparkSession.createDataFrame(order, "node long, depth int, position int")


def shortest_paths(edges: DataFrame, start: int, max_rounds: int | None = None) -> DataFrame:
    """node, cost, path: least total weight from `start`, by repeated relaxation until nothing improves. Of paths of equal
    cost the smallest is kept. A negative weight is an error, and so is a graph that max_rounds do not settle."""
    links = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    if not links.filter("weight < 0").isEmpty():
        raise ValueError("shortest paths need weights that are not negative")
    best = edges.sparkSession.createDataFrame([(start, 0.0, [start])], "node long, cost double, path array<long>")
    frontier = best
    for done in itertools.count(1):
        offers = frontier.join(links, frontier["node"] == links["src"]).select(F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("cost"), F.array_append("path", F.col("dst")).alias("path"))
        # struct order: the least cost first, then the smallest path
        both = best.select("node", "cost", "path", F.lit(0).alias("fresh")).unionByName(offers.withColumn("fresh", F.lit(1)))
        chosen = checkpointed(both.groupBy("node").agg(F.min(F.struct("cost", "path", "fresh")).alias("b")).select("node", "b.cost", "b.path", "b.fresh"))
        best, frontier = chosen.drop("fresh"), chosen.filter("fresh = 1").drop("fresh")
        if frontier.isEmpty():
            return best
        if max_rounds is not None and done >= max_rounds:
            raise ValueError(f"paths still improve after {max_rounds} rounds")


def path_weight(path: DataFrame, edges: DataFrame) -> DataFrame:
    """Total weight of each row's `path` (array of nodes); a step without an edge makes it null."""
    steps = path.withColumn("_row", F.xxhash64("path")).select("_row", "path", F.posexplode(F.sequence(F.lit(1), F.size("path") - 1)).alias("_i", "_k"))
    pairs = steps.select("_row", "path", F.element_at("path", F.col("_k")).alias("src"), F.element_at("path", F.col("_k") + 1).alias("dst"))
    least = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    found = pairs.join(least, ["src", "dst"], "left").groupBy("path").agg(F.sum("weight").alias("w"), F.count("weight").alias("n"))
    return found.select("path", F.when(F.col("n") == F.size("path") - 1, F.col("w")).alias("total_weight"))
