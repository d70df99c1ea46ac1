"""Scalar (one byte a component) and product quantization, with asymmetric distances and exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import distance, vector
from ..model import Distance
from .knn import _matrix, kmeans, knn

#: Fixed values of the codebooks: centroids at most, rounds, weight of the part along the vector.
MAX_CENTROIDS, ROUNDS, ANISOTROPIC_WEIGHT = 256, 25, 0.2
TRAIN_ROWS = 20_000


# -- one byte a component ----------------------------------------------------------------------------------------------
def sq8_quantize(v) -> Column:
    """struct(codes array<tinyint>, min, scale): scale = (max - min) / 255, code = round((x - min) / scale) - 128; a
    constant vector has scale 0 and codes -128."""
    v = vector(v)
    low, high = F.array_min(v), F.array_max(v)
    scale = (high - low) / 255.0
    codes = F.transform(v, lambda x: F.when(scale == 0, F.lit(-128)).otherwise(F.least(F.greatest(F.round((x - low) / F.when(scale == 0, F.lit(1.0)).otherwise(scale)), F.lit(0.0)), F.lit(255.0)).cast("int") - 128).cast("tinyint"))
    return F.struct(codes.alias("codes"), low.alias("min"), scale.alias("scale"))


def sq8_dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: (c.cast("double") + 128.0) * q["scale"] + q["min"])


def sq8_distance(q: Column, query, metric: Distance | str = "cosine") -> Column:
    """Distance of an exact query to a quantized vector."""
    return distance(sq8_dequantize(q), query, metric)


def sq8_knn(points: DataFrame, query: Sequence[float], k: int, metric: Distance | str = "cosine", id_column: str = "id", vector_column: str = "vector") -> DataFrame:
    coded = points.select(F.col(id_column).alias("id"), sq8_quantize(vector_column).alias("q"))
    return coded.select("id", sq8_distance(F.col("q"), query, metric).alias("score")).orderBy("score", "id").limit(k)


# -- product quantization ----------------------------------------------------------------------------------------------
def anisotropic(x: np.ndarray, centres: np.ndarray, weight: float = ANISOTROPIC_WEIGHT) -> np.ndarray:
    """(1 + w) * the part of the error along x, squared, + the part across it, squared."""
    error = x[:, None, :] - centres[None]
    norm = np.maximum((x * x).sum(1), 1e-12)
    along = np.einsum("nkd,nd->nk", error, x) ** 2 / norm[:, None]
    return (1 + weight) * along + np.maximum((error**2).sum(2) - along, 0)


def _anisotropic_blocks(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """As anisotropic(), a block of vectors at a time."""
    step = max(1, (1 << 22) // max(1, centres.size))
    return np.concatenate([anisotropic(x[i : i + step], centres) for i in range(0, len(x), step)])


class ProductQuantizer:
    """`parts` codebooks of at most 256 centroids, fitted on a bounded sample of TRAIN_ROWS vectors (smallest id hashes).
    In training a vector belongs to the centroid of the least anisotropic error; codes name the nearest one."""

    def __init__(self, books: list[np.ndarray], size: int):
        self.books, self.size = books, size

    @classmethod
    def train(cls, points: DataFrame, parts: int, centroids: int = MAX_CENTROIDS, id_column: str = "id", vector_column: str = "vector") -> ProductQuantizer:
        rows = points.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v")).filter(F.size("v") > 0).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).collect()
        if not rows:
            raise ValueError("no vectors to train on")
        return cls.fit(np.array([r["v"] for r in rows]), parts, centroids)

    @classmethod
    def fit(cls, x: np.ndarray, parts: int, centroids: int = MAX_CENTROIDS) -> ProductQuantizer:
        if x.shape[1] % parts or not 1 <= centroids <= MAX_CENTROIDS:
            raise ValueError("the vector size must be a multiple of parts, and centroids at most 256")
        return cls([kmeans(s, centroids, ROUNDS, _anisotropic_blocks) for s in np.split(x, parts, axis=1)], x.shape[1])

    @property
    def compression_ratio(self) -> float:
        return 4.0 * self.size / len(self.books)

    def encode_rows(self, x: np.ndarray) -> np.ndarray:
        return np.stack([((s**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * s @ b.T).argmin(1) for s, b in zip(np.split(x, len(self.books), axis=1), self.books)], axis=1)

    def decode_rows(self, codes: np.ndarray) -> np.ndarray:
        return np.hstack([b[codes[:, i]] for i, b in enumerate(self.books)])

    def tables(self, query: Sequence[float], metric: Distance | str = "euclid") -> np.ndarray:
        """parts x centroids: squared Euclidean distances, or negative inner products."""
        query = np.asarray(query, dtype=np.float64)
        pieces = np.split(query, len(self.books))
        wide = max(len(b) for b in self.books)
        out = np.full((len(self.books), wide), np.inf)
        for i, (q, b) in enumerate(zip(pieces, self.books)):
            out[i, : len(b)] = -(b @ q) if Distance.parse(getattr(metric, "value", metric)) is Distance.DOT else ((b - q) ** 2).sum(1)
        return out

    def encode(self, points: DataFrame, id_column: str = "id", vector_column: str = "vector") -> DataFrame:
        """id, codes array<smallint>; the codebooks (parts * 256 centroids) are broadcast."""
        shared = points.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, good = _matrix(batch.column("v"), shared.value.size)
                codes = shared.value.encode_rows(x) if len(good) else np.zeros((0, 1), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(good)), pa.array(codes.tolist(), pa.list_(pa.int16()))], names=["id", "codes"])

        return points.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).mapInArrow(run, "id long, codes array<smallint>")

    def adc(self, codes: Column, query: Sequence[float], metric: Distance | str = "euclid") -> Column:
        """Sum of the table entries of the codes."""
        tables = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in self.tables(query, metric)])
        return F.aggregate(F.transform(codes, lambda c, i: F.element_at(F.element_at(tables, i + 1), c.cast("int") + 1)), F.lit(0.0), lambda a, x: a + x)

    def search(self, coded: DataFrame, query: Sequence[float], k: int) -> DataFrame:
        """id, score: k nearest by table lookups (squared Euclidean)."""
        shared = coded.sparkSession.sparkContext.broadcast(self.tables(query))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = batch.column("codes").flatten().to_numpy().reshape(batch.num_rows, -1)
                score = shared.value[np.arange(codes.shape[1])[None], codes].sum(1)
                best = np.lexsort((batch.column("id").to_numpy(), score))[:k]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(best)), pa.array(score[best])], names=["id", "score"])

        return coded.select("id", "codes").mapInArrow(run, "id long, score double").orderBy("score", "id").limit(k)

    def search_with_rerank(self, coded: DataFrame, points: DataFrame, query: Sequence[float], k: int, factor: int = 10, metric: Distance | str = "euclid", id_column: str = "id", vector_column: str = "vector") -> DataFrame:
        """The k * factor best by table lookups, ranked anew by their exact distance."""
        few = self.search(coded, query, k * factor).select("id")
        rows = points.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).join(F.broadcast(few), "id")
        return knn(rows, query, k, metric)
