"""Collections on disk: Parquet for points and edges, JSON for the configuration; and a catalog of named collections."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ..collection import Collection
from ..model import EDGES, MAX_COLLECTIONS, POINTS, CollectionConfig


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export_collection(collection: Collection, path: str, mode: str = "errorifexists") -> None:
    """points, edges and config under `path`, on any file system that Spark writes to."""
    collection.points.write.mode(mode).parquet(f"{path}/points")
    collection.edges.write.mode(mode).parquet(f"{path}/edges")
    _write_text(collection.spark, f"{path}/config", json.dumps(collection.config.to_dict()))


def load_collection(spark: SparkSession, path: str) -> Collection:
    config = CollectionConfig.from_dict(json.loads("".join(r["value"] for r in spark.read.text(f"{path}/config").collect())))
    return Collection(config, spark.read.schema(POINTS).parquet(f"{path}/points"), spark.read.schema(EDGES).parquet(f"{path}/edges"))


def import_collection(incoming: Collection, mode: str, existing: Collection | None = None) -> tuple[Collection, int, int]:
    """The collection that results, points imported and points skipped. create: there must be none; replace: the incoming
    one; merge: only points whose id isn't there yet, and edges that aren't."""
    total = incoming.point_count()
    if mode == "create":
        if existing is not None:
            raise FileExistsError(f"collection {existing.config.name} exists")
        return incoming, total, 0
    if mode == "replace" or existing is None:
        return incoming, total, 0
    if mode != "merge":
        raise ValueError(f"unknown mode {mode!r}")
    if existing.config.size != incoming.config.size:
        raise ValueError("the vector sizes differ")
    fresh = incoming.points.join(existing.points.select("id"), "id", "left_anti").select(existing.points.columns)
    imported = fresh.count()
    edges = incoming.edges.join(existing.edges, ["src", "dst", "relation"], "left_anti").select(existing.edges.columns)
    return Collection(existing.config, existing.points.unionByName(fresh), existing.edges.unionByName(edges)), imported, total - imported


class Catalog:
    """Named collections of one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.collections = spark, {}

    def create(self, config: CollectionConfig) -> Collection:
        if config.name in self.collections:
            raise FileExistsError(f"collection {config.name} exists")
        if len(self.collections) >= MAX_COLLECTIONS:
            raise ValueError(f"more than {MAX_COLLECTIONS} collections")
        self.collections[config.name] = Collection.empty(self.spark, config)
        return self.collections[config.name]

    def put(self, collection: Collection) -> Collection:
        self.collections[collection.config.name] = collection
        return collection

    def get(self, name: str) -> Collection:
        return self.collections[name]

    def list(self) -> list[str]:
        return sorted(self.collections)

    def delete(self, name: str) -> bool:
        return self.collections.pop(name, None) is not None

    def info(self, name: str) -> dict:
        c = self.get(name)
        return {**c.config.to_dict(), "points": c.point_count(), "payload_schema": {}}


def hot_over_cold(cold: DataFrame, hot: DataFrame, key: str = "id") -> DataFrame:
    """Rows of `hot`, and those of `cold` that it doesn't overwrite."""
    return cold.join(hot.select(key), key, "left_anti").select(cold.columns).unionByName(hot.select(cold.columns))
