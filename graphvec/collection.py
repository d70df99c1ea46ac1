"""Collections of points and edges, updated functionally: each mutation gives a new collection and what it changed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import EdgeTable, NodeTable, PropertyGraph
from .model import (
    EDGES, MAX_BATCH_QUERIES, MAX_EF, MAX_POINTS_PER_UPSERT, MAX_SCROLL, MAX_TRAVERSE_DEPTH, MAX_TRAVERSE_RELATIONS, POINTS, CollectionConfig,
)
from .operators import knn as K
from .operators.index import InvertedLists
from .operators.traversal import traverse
from .runtime import BROADCAST_ROWS


@dataclass(frozen=True)
class Upserted:
    collection: Collection
    inserted: int
    updated: int


@dataclass(frozen=True)
class Page:
    points: DataFrame
    next_offset: int | None


@dataclass(frozen=True)
class Collection:
    """points (id, vector, labels, payload: JSON text by field) and edges (src, dst, relation, weight)."""

    config: CollectionConfig
    points: DataFrame
    edges: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, config: CollectionConfig) -> Collection:
        return cls(config, spark.createDataFrame([], POINTS), spark.createDataFrame([], EDGES))

    @property
    def spark(self) -> SparkSession:
        return self.points.sparkSession

    # -- reading -----------------------------------------------------------------------------------------------------------
    def get_points(self, ids: Sequence[int], missing: bool = False, with_payload: bool = True, with_vector: bool = True) -> DataFrame:
        """pos, id and the point's columns, in the order asked for; ids that don't exist are left out, or null if `missing`."""
        asked = self.spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "pos int, id long")
        rows = self._shown(with_payload, with_vector)
        found = F.broadcast(asked) if len(ids) <= BROADCAST_ROWS else asked
        # the list is the small side: points are scanned once and never shuffled for it
        return found.join(rows, "id", "left").orderBy("pos") if missing else rows.join(found, "id").select("pos", *rows.columns).orderBy("pos")

    def get_point(self, id: int) -> DataFrame:
        return self.points.filter(F.col("id") == id)

    def point_exists(self, id: int) -> bool:
        return not self.get_point(id).isEmpty()

    def point_ids(self, label: str | None = None) -> DataFrame:
        rows = self.points if label is None else self.points.filter(F.array_contains("labels", label))
        return rows.select("id")

    def point_count(self) -> int:
        return self.points.count()

    def _shown(self, with_payload: bool, with_vector: bool) -> DataFrame:
        return self.points.drop(*([] if with_payload else ["payload"]), *([] if with_vector else ["vector"]))

    def scroll(self, limit: int = 10, offset: int | None = None, with_payload: bool = True, with_vector: bool = False) -> Page:
        """The `limit` next points by id after `offset`, and the last id if more follow."""
        if not 1 <= limit <= MAX_SCROLL:
            raise ValueError(f"limit must be between 1 and {MAX_SCROLL}")
        rows = self._shown(with_payload, with_vector)
        rows = rows if offset is None else rows.filter(F.col("id") > offset)
        ids = [r["id"] for r in rows.select("id").orderBy("id").limit(limit + 1).collect()]
        return Page(rows.orderBy("id").limit(limit), ids[limit - 1] if len(ids) > limit else None)

    def get_edges(self, id: int) -> DataFrame:
        return self.edges.filter(F.col("src") == id)

    def neighbours(self, id: int, relation: str | None = None, direction: str = "out") -> DataFrame:
        """neighbour, relation, weight, direction of the edges of a point."""
        edges = self.edges if relation is None else self.edges.filter(F.col("relation") == relation)
        out = edges.filter(F.col("src") == id).select(F.col("dst").alias("neighbour"), "relation", "weight", F.lit("out").alias("direction"))
        into = edges.filter(F.col("dst") == id).select(F.col("src").alias("neighbour"), "relation", "weight", F.lit("in").alias("direction"))
        try:
            return {"out": out, "in": into, "both": out.unionByName(into)}[direction]
        except KeyError:
            raise ValueError(f"unknown direction {direction!r}") from None

    # -- searching ---------------------------------------------------------------------------------------------------------
    @staticmethod
    def _filter(where: Column | Mapping | None) -> Column | None:
        """A column, or {"must": {field: value}, "must_not": {field: value}} on payload fields."""
        if where is None or isinstance(where, Column):
            return where
        import json

        out = F.lit(True)
        for field, value in (where.get("must") or {}).items():
            out &= F.coalesce(F.try_element_at("payload", F.lit(field)) == json.dumps(value), F.lit(False))
        for field, value in (where.get("must_not") or {}).items():
            out &= ~F.coalesce(F.try_element_at("payload", F.lit(field)) == json.dumps(value), F.lit(False))
        return out

    def search(self, vector: Sequence[float], limit: int = 10, *, ef: int | None = None, with_payload: bool = False, with_vector: bool = False, score_threshold: float | None = None, where: Column | Mapping | None = None) -> DataFrame:
        """id, score, and payload or vector if asked for. Exact; `ef` is checked and otherwise ignored."""
        self._check(vector, ef)
        shown = [c for c, wanted in (("payload", with_payload), ("vector", with_vector)) if wanted]
        return K.knn(self.points.filter(F.size("vector") > 0), vector, limit, self.config.distance.value, where=self._filter(where), score_threshold=score_threshold, columns=shown)

    def query(self, query: Sequence[float] | Mapping, limit: int = 10, **options) -> DataFrame:
        """As search, for a vector or {"nearest": a vector, or the id of a point, which is not among the results}."""
        target = query["nearest"] if isinstance(query, Mapping) else query
        if not isinstance(target, int):
            return self.search(target, limit, **options)
        row = self.get_point(target).select("vector").first()
        if row is None or row["vector"] is None:
            raise KeyError(f"point {target} does not exist or has no vector")
        other = F.col("id") != target
        where = self._filter(options.pop("where", None))
        return self.search([float(x) for x in row["vector"]], limit, where=other if where is None else other & where, **options)

    def search_batch(self, queries: Iterable[Mapping], limit: int = 10) -> DataFrame:
        """query_id (its place), id, score, rank for each of {"vector", "limit", "score_threshold"}."""
        rows = [(i, [float(x) for x in q["vector"]], q.get("limit"), q.get("score_threshold")) for i, q in enumerate(queries)]
        if len(rows) > MAX_BATCH_QUERIES:
            raise ValueError(f"more than {MAX_BATCH_QUERIES} queries")
        for r in rows:
            self._check(r[1], None)
        asked = self.spark.createDataFrame(rows, "query_id long, vector array<double>, limit int, score_threshold double")
        return K.knn_batch(self.points, asked, limit, self.config.distance.value)

    def index(self, lists: int = 64, parts: int | None = None) -> InvertedLists:
        return InvertedLists.build(self.points, lists, self.config.distance.value, parts=parts)

    def _check(self, vector: Sequence[float], ef: int | None) -> None:
        if len(vector) != self.config.size:
            raise ValueError(f"the vector has {len(vector)} components, not {self.config.size}")
        if ef is not None and not 1 <= ef <= MAX_EF:
            raise ValueError(f"ef must be between 1 and {MAX_EF}")

    def traverse(self, start: int, max_depth: int, relations: Sequence[str] | None = None) -> DataFrame:
        """target_id, depth, path, relation, weight; targets that don't exist as points are kept."""
        if not 1 <= max_depth <= MAX_TRAVERSE_DEPTH or len(relations or ()) > MAX_TRAVERSE_RELATIONS:
            raise ValueError("depth or number of relations out of range")
        return traverse(self.edges, start, max_depth, relations)

    def graph(self, properties: Mapping[str, str] | None = None, label: str = "Point") -> PropertyGraph:
        """The collection as a property graph; `properties` gives the types of payload fields ({"age": "long"})."""
        text = lambda f: F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at("payload", F.lit(f)), F.lit("}")), "$.v")
        props = [text(f).try_cast(kind).alias(f) for f, kind in (properties or {}).items()]
        rows = self.points.select("id", "vector", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), *props)
        return PropertyGraph(self.spark).with_node(NodeTable(label, rows, "id", "labels")).with_edge(EdgeTable(label, "", label, self.edges))

    # -- writing -----------------------------------------------------------------------------------------------------------
    def upsert(self, points: DataFrame, drop_edges: bool = False) -> Upserted:
        """Points replace those of the same id; of several with one id the last by the column `seq` stays or, without one, the
        greatest as JSON text, whatever the partitions. Edges are kept unless drop_edges."""
        wrong = points.filter(F.size("vector") != self.config.size).limit(1).count()
        if wrong:
            raise ValueError(f"a vector has not {self.config.size} components")
        new = latest(points if "seq" in points.columns else points.withColumn("seq", F.to_json(F.struct("*"))), "id", "seq")
        new = new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in POINTS])
        updated = new.join(self.points.select("id"), "id", "left_semi").count()
        total = new.count()
        edges = self.edges.join(new.select(F.col("id").alias("src")), "src", "left_anti").select(self.edges.columns) if drop_edges else self.edges
        return Upserted(replace(self, points=self.points.join(new.select("id"), "id", "left_anti").select(new.columns).unionByName(new), edges=edges), total - updated, updated)

    def upsert_rows(self, rows: Sequence[Mapping]) -> Upserted:
        """At most MAX_POINTS_PER_UPSERT points given as dicts (id, vector, labels, payload of JSON values)."""
        import json

        if len(rows) > MAX_POINTS_PER_UPSERT:
            raise ValueError(f"more than {MAX_POINTS_PER_UPSERT} points")
        data = [(int(r["id"]), [float(x) for x in r["vector"]], list(r.get("labels") or []), {k: json.dumps(v) for k, v in (r.get("payload") or {}).items()}, i) for i, r in enumerate(rows)]
        for _, v, *_ in data:
            self._check(v, None)
        return self.upsert(self.spark.createDataFrame(data, "id long, vector array<float>, labels array<string>, payload map<string,string>, seq int"))

    def delete_points(self, ids: Sequence[int] | DataFrame) -> tuple[Collection, int]:
        """Points go, edges to them stay dangling. Returns how many points were there."""
        gone = ids.select("id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        n = self.points.join(gone.distinct(), "id", "left_semi").count()
        return replace(self, points=self.points.join(gone, "id", "left_anti").select(self.points.columns)), n

    def add_edges(self, edges: DataFrame) -> Collection:
        """Edges whose ends exist and that aren't there yet are added; of equal (src, dst, relation) the first by the column
        `seq` or, without one, the heaviest wins."""
        new = edges.select("src", "dst", "relation", *(["weight"] if "weight" in edges.columns else []), *(["seq"] if "seq" in edges.columns else []))
        if "weight" not in new.columns:
            new = new.withColumn("weight", F.lit(1.0))
        new = latest(new if "seq" in new.columns else new.withColumn("seq", -F.col("weight")), ["src", "dst", "relation"], "seq", first=True)
        ids = self.points.select("id")
        new = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(self.edges, ["src", "dst", "relation"], "left_anti")
        return replace(self, edges=self.edges.unionByName(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EDGES])))

    def add_edge(self, src: int, dst: int, relation: str, weight: float = 1.0) -> Collection:
        if not (self.point_exists(src) and self.point_exists(dst)):
            raise KeyError(f"point {src} or {dst} does not exist")
        out = self.add_edges(self.spark.createDataFrame([(src, dst, relation, float(weight))], EDGES))
        return replace(out, config=self.config.with_relation(relation))

    def remove_edge(self, src: int, dst: int, relation: str | None = None) -> Collection:
        """The edge of a relation, or all edges from src to dst."""
        hit = (F.col("src") == src) & (F.col("dst") == dst)
        return replace(self, edges=self.edges.filter(~(hit if relation is None else hit & (F.col("relation") == relation))))


def latest(df: DataFrame, keys: str | list[str], by: str, first: bool = False) -> DataFrame:
    """For each key the row with the greatest (or least) `by`, as one aggregate that combines before the shuffle."""
    keys = [keys] if isinstance(keys, str) else keys
    rest = [c for c in df.columns if c not in keys and c != by]
    whole = F.struct(*rest) if rest else F.lit(0)
    best = (F.min_by if first else F.max_by)(whole, F.col(by)).alias("_best")
    out = df.groupBy(*keys).agg(best, (F.min if first else F.max)(by).alias(by))
    return out.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest], by).select(df.columns)


def numbered(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """Page numbers and the like: row numbers within the whole table. For small tables only."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(order)))
