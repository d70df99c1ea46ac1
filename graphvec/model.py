"""Collections: configuration, validation and the schemas of points and edges."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import types as T

#: Limits of the API.
MAX_DIM, MAX_M, MAX_M0, MAX_EF_CONSTRUCTION, MAX_EF, MAX_COLLECTIONS = 65_536, 256, 512, 100_000, 10_000, 1_000
MAX_POINTS_PER_UPSERT, MAX_BATCH_QUERIES, MAX_SCROLL, MAX_TRAVERSE_DEPTH, MAX_TRAVERSE_RELATIONS = 10_000, 100, 10_000, 32, 100
NAME = re.compile(r"[A-Za-z0-9_-]{1,255}")


class Distance(str, Enum):
    COSINE = "cosine"
    EUCLID = "euclid"
    DOT = "dot"

    @classmethod
    def parse(cls, name: str) -> Distance:
        """Names and their aliases, in any case."""
        aliases = {"cosine": cls.COSINE, "euclid": cls.EUCLID, "euclidean": cls.EUCLID, "l2": cls.EUCLID, "dot": cls.DOT, "dotproduct": cls.DOT}
        try:
            return aliases[name.lower()]
        except KeyError:
            raise ValueError(f"unknown distance {name!r}") from None


class Durability(str, Enum):
    EPHEMERAL = "ephemeral"
    DURABLE = "durable"


@dataclass(frozen=True)
class IndexConfig:
    """Parameters of the approximate index: those of a navigable graph, kept for compatibility, from which the inverted
    lists take theirs (ef: vectors looked at per query)."""

    m: int = 16
    m0: int = 32
    ml: float | None = None
    ef: int = 100
    ef_construction: int = 200

    def __post_init__(self):
        if self.ml is None:
            object.__setattr__(self, "ml", 1 / math.log(max(2, self.m)))
        if not (2 <= self.m <= MAX_M and self.m <= self.m0 <= MAX_M0 and self.ml > 0 and 1 <= self.ef <= MAX_EF and 1 <= self.ef_construction <= MAX_EF_CONSTRUCTION):
            raise ValueError(f"invalid index configuration {self}")


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    size: int
    distance: Distance = Distance.COSINE
    index: IndexConfig = field(default_factory=IndexConfig)
    durability: Durability = Durability.EPHEMERAL
    relations: tuple[str, ...] = ()

    def __post_init__(self):
        if not NAME.fullmatch(self.name):
            raise ValueError(f"invalid collection name {self.name!r}")
        if not 1 <= self.size <= MAX_DIM:
            raise ValueError(f"vector size {self.size} is not between 1 and {MAX_DIM}")
        if isinstance(self.distance, str):
            object.__setattr__(self, "distance", Distance.parse(str(getattr(self.distance, "value", self.distance))))

    def with_relation(self, relation: str) -> CollectionConfig:
        return self if relation in self.relations else replace(self, relations=(*self.relations, relation))

    def to_dict(self) -> dict:
        i = self.index
        return {"name": self.name, "size": self.size, "distance": self.distance.value, "durability": Durability(self.durability).value, "relations": list(self.relations), "index": {"m": i.m, "m0": i.m0, "ml": i.ml, "ef": i.ef, "ef_construction": i.ef_construction}}

    @classmethod
    def from_dict(cls, d: dict) -> CollectionConfig:
        return cls(d["name"], d["size"], Distance(d["distance"]), IndexConfig(**d["index"]), Durability(d["durability"]), tuple(d["relations"]))


POINTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
])
EDGES = T.StructType([
    T.StructField("src", T.LongType(), False),
    T.StructField("dst", T.LongType(), False),
    T.StructField("relation", T.StringType(), False),
    T.StructField("weight", T.FloatType()),
])
