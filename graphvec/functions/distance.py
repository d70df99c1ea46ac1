"""Distances as column expressions, in double precision. Lower is nearer for all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Distance


def vector(v: Column | str | Sequence[float]) -> Column:
    """A column of doubles; a sequence becomes a literal array."""
    if isinstance(v, str):
        v = F.col(v)
    if not isinstance(v, Column):
        v = F.array(*[F.lit(float(x)) for x in v])
    return v.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot_product(a, b) -> Column:
    return _sum(F.zip_with(vector(a), vector(b), lambda x, y: x * y))


def cosine(a, b) -> Column:
    """1 - dot / sqrt(|a|^2 * |b|^2); 1 if either vector is zero."""
    norms = F.sqrt(dot_product(a, a) * dot_product(b, b))
    return F.when(norms > 0, 1.0 - dot_product(a, b) / norms).otherwise(F.lit(1.0))


def cosine_unit(a, b) -> Column:
    """Cosine distance of vectors known to have length 1."""
    return 1.0 - dot_product(a, b)


def euclid(a, b) -> Column:
    return F.sqrt(_sum(F.zip_with(vector(a), vector(b), lambda x, y: (x - y) * (x - y))))


def dot(a, b) -> Column:
    return -dot_product(a, b)


def distance(a, b, metric: Distance | str = Distance.COSINE) -> Column:
    return {Distance.COSINE: cosine, Distance.EUCLID: euclid, Distance.DOT: dot}[Distance.parse(metric)](a, b)
