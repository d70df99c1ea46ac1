"""Nearest-neighbour search: exact, filtered, thresholded and batched; k-means for what is built on it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance
from ..model import Distance

#: Queries that a batch of points is multiplied with at a time; bytes of query vectors that are broadcast for one scan.
QUERY_BLOCK, QUERY_BYTES = 1024, 64 << 20
#: Points that a block of queries is multiplied with at a time, and their bytes at most; numbers in which pairs are scored.
POINT_BLOCK, POINT_BYTES, PAIR_NUMBERS = 512, 4 << 20, 1 << 19


def knn(points: DataFrame, query: Sequence[float], k: int, metric: Distance | str = "cosine", *, where: Column | None = None, score_threshold: float | None = None, id_column: str = "id", vector_column: str = "vector", columns: Sequence[str] = ()) -> DataFrame:
    """id, score and `columns` of the k nearest points, ties by id. The filter applies before, the threshold (score <= t)
    after the k are chosen. Planned as one TakeOrderedAndProject: each task keeps k rows."""
    rows = points if where is None else points.filter(where)
    scored = rows.select(F.col(id_column).alias("id"), distance(vector_column, query, metric).alias("score"), *[c for c in columns if c not in ("id", "score")])
    best = scored.orderBy(F.asc("score"), F.asc("id")).limit(k)
    return best if score_threshold is None else best.filter(F.col("score") <= score_threshold)


def numpy_distances(points: np.ndarray, queries: np.ndarray, metric: Distance) -> np.ndarray:
    """points x queries distances by one matrix product."""
    product = points @ queries.T
    if metric is Distance.DOT:
        return -product
    p, q = (points * points).sum(1)[:, None], (queries * queries).sum(1)[None, :]
    if metric is Distance.EUCLID:
        return np.sqrt(np.maximum(p + q - 2 * product, 0))
    norms = np.sqrt(p * q)
    return np.where(norms > 0, 1 - product / np.where(norms > 0, norms, 1), 1.0)


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold `size` numbers, and which they are."""
    lengths = column.value_lengths().fill_null(0).to_numpy()
    good = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(good), size), good


class _Nearest:
    """The `most` nearest points of each query of a block, ties by id. A matrix product says which points may be among them;
    those are scored pair by pair, so that equal vectors have equal scores wherever they stand in a batch."""

    def __init__(self, vectors: np.ndarray, most: int, metric: Distance):
        self.vectors, self.most, self.metric = vectors, most, metric
        self.squares = np.concatenate([(v * v).sum(1) for v in np.array_split(vectors, 8)])
        self.edge = np.full(len(vectors), np.inf)  # score of the last of `most`
        self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query, id, score

    def scores(self, x: np.ndarray, squares: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of pairs of a point and a query."""
        out, step = np.empty(len(at)), max(1, PAIR_NUMBERS // x.shape[1])
        for i in range(0, len(at), step):
            a, b = at[i : i + step], q[i : i + step]
            pairs = x[a]
            if self.metric is Distance.EUCLID:
                pairs -= self.vectors[b]
                out[i : i + step] = np.sqrt((pairs * pairs).sum(1))
                continue
            pairs *= self.vectors[b]
            product = pairs.sum(1)
            if self.metric is Distance.COSINE:
                norms = np.sqrt(squares[a] * self.squares[b])
                out[i : i + step] = np.where(norms > 0, 1 - product / np.where(norms > 0, norms, 1), 1.0)
            else:
                out[i : i + step] = -product
        return out

    def near(self, x: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and places of points that may be among the nearest, by a product that is off by `slack` at most."""
        slack, own = (x.shape[1] + 8) * 2.0**-50, self.squares
        if self.metric is Distance.COSINE:
            # of norms too small or too large to be multiplied every pair is scored
            odd, strange = (~((s > 1e-140) & (s < 1e140)) for s in (squares, own))
            close = self.vectors @ (x / np.sqrt(np.where(odd, 1, squares))[:, None]).T
            close[:, odd] = np.inf
            norms = np.sqrt(np.where(strange, 1, own))
            slack, floor = slack * norms, np.where(strange, -np.inf, (1 - self.edge) * norms)
        elif self.metric is Distance.DOT:
            close = self.vectors @ x.T
            slack, floor = slack * np.sqrt(squares.max() * own), -self.edge
        else:
            close = self.vectors @ x.T
            close -= squares / 2
            slack, floor = slack * (squares.max() + own), (own - self.edge * self.edge) / 2
        may = ~(close < (floor - slack)[:, None])
        if len(x) > self.most and np.count_nonzero(may) > 2 * self.most * len(own):
            # the nearest of these points alone leave fewer to score
            finite = np.where(np.isfinite(close), close, -np.inf)
            least = np.partition(finite, len(x) - self.most, axis=1)[:, len(x) - self.most] - 2 * slack
            if self.metric is Distance.COSINE:
                least[strange] = -np.inf
            may &= ~(close < least[:, None])
        return np.nonzero(may)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        squares = (x * x).sum(1)
        q, at = self.near(x, squares)
        if not len(q):
            return
        touched = np.zeros(len(self.edge), bool)
        touched[q] = True
        old = touched[self.held[0]]
        q, i, s = (np.concatenate([a[old], b]) for a, b in zip(self.held, (q, ids[at], self.scores(x, squares, at, q))))
        order = np.lexsort((i, s, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, rank = (z[rank < self.most] for z in (order, q, rank))
        last = rank == self.most - 1
        self.edge[q[last]] = s[order][last]
        self.held = tuple(np.concatenate([a[~old], b]) for a, b in zip(self.held, (q, i[order], s[order])))


def knn_batch(points: DataFrame, queries: DataFrame, k: int, metric: Distance | str = "cosine", *, where: Column | None = None, id_column: str = "id", vector_column: str = "vector") -> DataFrame:
    """query_id, id, score, rank for each row of `queries` (query_id, vector [, limit, score_threshold]).

    Points are read once for QUERY_BYTES of query vectors, which are broadcast; a task multiplies POINT_BLOCK points with
    QUERY_BLOCK queries at a time, whatever the size of a batch, and passes on k rows for each query, so the shuffle carries
    k * queries rows a task, never points * queries. Query ids must differ."""
    metric, spark = Distance.parse(getattr(metric, "value", metric)), points.sparkSession
    rows = (points if where is None else points.filter(where)).select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    extra = [c for c in ("limit", "score_threshold") if c in queries.columns]
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), *extra)
    parts: list[DataFrame] = []

    def search(held: list) -> DataFrame:
        most = max([k, *[r["limit"] or k for r in held if "limit" in extra]])
        by_size: dict[int, list] = {}
        for r in held:
            by_size.setdefault(len(r["vector"] or ()), []).append(r)
        blocks = [(d, rs[i : i + QUERY_BLOCK]) for d, rs in by_size.items() if d for i in range(0, len(rs), QUERY_BLOCK)]
        shared = spark.sparkContext.broadcast([(d, np.array([r["query_id"] for r in rs]), np.array([r["vector"] for r in rs])) for d, rs in blocks])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [_Nearest(vectors, most, metric) for _, _, vectors in shared.value]
            sizes = {d for d, *_ in shared.value}
            step = max(1, min(POINT_BLOCK, POINT_BYTES // (8 * max(sizes, default=1))))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    piece = batch.slice(i, step)
                    found = {d: _matrix(piece.column("vector"), d) for d in sizes}
                    for (d, *_), near in zip(shared.value, best):
                        x, good = found[d]
                        if len(good):
                            near.add(piece.column("id").to_numpy()[good], x)
            for near, (_, names, _) in zip(best, shared.value):
                q, ids, scores = near.held
                yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores)], names=["query_id", "id", "score"])

        found = rows.mapInArrow(run, "query_id long, id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
        found = found.withColumn("rank", rank)
        if extra:
            limits = spark.createDataFrame([(r["query_id"], r["limit"] if "limit" in extra else None, float(r["score_threshold"]) if "score_threshold" in extra and r["score_threshold"] is not None else None) for r in held], "query_id long, most int, least double")
            found = found.join(F.broadcast(limits), "query_id").filter((F.col("rank") <= F.coalesce("most", F.lit(k))) & (F.col("least").isNull() | (F.col("score") <= F.col("least")))).drop("most", "least")
        else:
            found = found.filter(F.col("rank") <= k)
        return found

    held, size = [], 0
    for r in asked.toLocalIterator():
        held.append(r)
        size += 8 * len(r["vector"] or ())
        if size >= QUERY_BYTES:
            parts.append(search(held))
            held, size = [], 0
    if held:
        parts.append(search(held))
    if not parts:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    return reduce(DataFrame.unionByName, parts)


def kmeans(x: np.ndarray, k: int, rounds: int = 40, weigh=None) -> np.ndarray:
    """Centres of at most k clusters. Seeds are drawn far from each other (k-means++, fixed seed); a centre that loses all its
    vectors moves to the vector that is farthest from its own centre. weigh: distances of vectors to centres, squared
    Euclidean ones if not given."""
    rng, k = np.random.default_rng(17), min(k, len(x))
    squares = (x * x).sum(1)
    weigh = weigh or (lambda v, c: np.maximum((v * v).sum(1)[:, None] + (c * c).sum(1) - 2 * v @ c.T, 0))
    chosen, least = [int(rng.integers(len(x)))] if k else [], np.full(len(x), np.inf)
    while len(chosen) < k:
        c = x[chosen[-1]]
        least = np.minimum(least, np.maximum(squares + c @ c - 2 * x @ c, 0))
        least[chosen] = 0
        total = least.sum()
        rest = np.setdiff1d(np.arange(len(x)), chosen)
        chosen.append(int(rng.choice(len(x), p=least / total)) if total > 0 else int(rest[0]))
    centres = x[chosen].copy()
    own = None
    for _ in range(rounds):
        d = weigh(x, centres)
        now = d.argmin(1)
        if own is not None and (now == own).all():
            break
        own = now
        sizes = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        far = np.argsort(-d[np.arange(len(x)), own], kind="stable")
        for place, j in enumerate(np.flatnonzero(sizes == 0).tolist()):
            centres[j] = x[far[place]]
    return centres
