"""Inverted lists: an approximate index that is built, written, loaded, searched, added to and deleted from.

Points are dealt over lists by the nearest of a few centres; a search reads the lists nearest to the query. With product
codes, it ranks those by table lookups first and the best by their exact distance then.

On disk an index is a folder: `lists` (id, vector, codes, op; a partition for each list, so a search reads the files of the
lists it probes), `gone` (id, op) and `meta`. Each change is an operation with a number and only adds files: rows of an id with
a smaller number than its last entry in `gone` are dead. An operation writes its rows before it writes `gone`, so one that is
cut short and repeated does no harm: of several live rows of an id the last counts. compact() writes the living rows alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import distance
from ..model import Distance
from ..runtime import BROADCAST_ROWS
from .knn import _matrix, kmeans, knn, numpy_distances
from .quantization import ProductQuantizer

#: Training vectors for each list.
TRAIN_PER_LIST = 64
ROWS = "id long, vector array<double>, codes array<smallint>, list int"


class InvertedLists:
    """centres: of the lists; rows: id, vector, codes (null without a quantizer), list and op of all rows, dead ones included;
    gone: id, op. `path` is set if the index lies on disk."""

    def __init__(self, centres: np.ndarray, metric: Distance, quantizer: ProductQuantizer | None, rows: DataFrame, gone: DataFrame, op: int = 0, path: str | None = None):
        self.centres, self.metric, self.quantizer, self.rows, self.gone, self.op, self.path = centres, metric, quantizer, rows, gone, op, path

    # -- building ----------------------------------------------------------------------------------------------------------
    @classmethod
    def build(cls, points: DataFrame, lists: int, metric: Distance | str = "cosine", id_column: str = "id", vector_column: str = "vector", parts: int | None = None) -> InvertedLists:
        """Centres, and with `parts` the codebooks, are fitted on a bounded sample of lists * TRAIN_PER_LIST vectors (smallest id
        hashes); every point is indexed."""
        metric = Distance.parse(getattr(metric, "value", metric))
        points = points.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")).filter(F.size("vector") > 0)
        sample = points.orderBy(F.xxhash64("id"), "id").limit(lists * TRAIN_PER_LIST)
        found = sample.collect()
        x = np.array([r["vector"] for r in found]) if found else np.zeros((1, 1))
        centres = kmeans(_unit(x) if metric is Distance.COSINE else x, lists)
        quantizer = ProductQuantizer.fit(x, parts) if parts and found else None
        out = cls(centres, metric, quantizer, points, points.sparkSession.createDataFrame([], "id long, op long"))
        out.rows = out._dealt(points, 0)
        return out

    def _dealt(self, points: DataFrame, op: int) -> DataFrame:
        """Rows of `points` (id, vector): the list and the codes of each."""
        centres, unit, quantizer = self.centres, self.metric is Distance.COSINE, self.quantizer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, good = _matrix(batch.column("vector"), centres.shape[1])
                kept = batch.take(pa.array(good))
                near = numpy_distances(_unit(x) if unit else x, centres, Distance.EUCLID).argmin(1) if len(good) else np.zeros(0, dtype=np.int64)
                codes = [None] * len(good) if quantizer is None or not len(good) else quantizer.encode_rows(x).tolist()
                yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("vector"), pa.array(codes, pa.list_(pa.int16())), pa.array(near.astype(np.int32))], names=["id", "vector", "codes", "list"])

        plain = points.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
        return plain.mapInArrow(run, ROWS).withColumn("op", F.lit(op).cast("long"))

    # -- on disk -----------------------------------------------------------------------------------------------------------
    def write(self, path: str) -> InvertedLists:
        """The living rows in a new folder, and the index that reads them there."""
        spark = self.rows.sparkSession
        # each list's rows together: a few files for a list, however many tasks there were
        self._alive(self.rows).withColumn("op", F.lit(0).cast("long")).repartition("list").write.partitionBy("list").parquet(f"{path}/lists")
        spark.createDataFrame([], "id long, op long").write.parquet(f"{path}/gone")
        books = [b.tolist() for b in self.quantizer.books] if self.quantizer else None
        meta = json.dumps({"centres": self.centres.tolist(), "metric": self.metric.value, "books": books, "size": int(self.centres.shape[1])})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")
        return self.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedLists:
        meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/meta").collect()))
        quantizer = ProductQuantizer([np.array(b) for b in meta["books"]], meta["size"]) if meta["books"] else None
        rows = spark.read.schema("id long, vector array<double>, codes array<smallint>, op long, list int").parquet(f"{path}/lists")
        gone = spark.read.schema("id long, op long").parquet(f"{path}/gone")
        op = max(gone.agg(F.coalesce(F.max("op"), F.lit(0))).first()[0], rows.agg(F.coalesce(F.max("op"), F.lit(0))).first()[0])
        return cls(np.array(meta["centres"]), Distance.parse(meta["metric"]), quantizer, rows, gone, op, path)

    def compact(self, path: str) -> InvertedLists:
        """The index in another folder, without dead rows."""
        return self.write(path)

    # -- changing ----------------------------------------------------------------------------------------------------------
    def insert(self, points: DataFrame) -> InvertedLists:
        """The index with `points` (id, vector), which replace those of the same id; of several with one id the greatest vector."""
        op, points = self.op + 1, points.groupBy(F.col("id").cast("long").alias("id")).agg(F.max("vector").alias("vector"))
        return self._changed(self._dealt(points, op), points.select("id"), op)

    def delete(self, ids: DataFrame | Sequence[int]) -> InvertedLists:
        """The index without these ids; ids that it doesn't hold are ignored."""
        if not isinstance(ids, DataFrame):
            ids = self.rows.sparkSession.createDataFrame([(int(i),) for i in ids], "id long")
        return self._changed(None, ids.select(F.col("id").cast("long").alias("id")).distinct(), self.op + 1)

    def _changed(self, rows: DataFrame | None, ids: DataFrame, op: int) -> InvertedLists:
        ids = ids.withColumn("op", F.lit(op).cast("long"))
        if self.path:
            if rows is not None:
                rows.write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")
            ids.write.mode("append").parquet(f"{self.path}/gone")
            return self.load(self.rows.sparkSession, self.path)
        both = self.rows if rows is None else self.rows.unionByName(rows)
        return InvertedLists(self.centres, self.metric, self.quantizer, both, self.gone.unionByName(ids), op)

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Those of `rows` that no later operation has replaced or deleted, one for each id."""
        if not self.op:
            return rows
        last = self.gone.groupBy("id").agg(F.max("op").alias("_gone"))
        few = F.broadcast(last) if self.gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else last
        kept = rows.join(few, "id", "left").filter(F.col("_gone").isNull() | (F.col("op") >= F.col("_gone"))).drop("_gone")
        changed = kept.filter("op > 0")
        return kept.filter("op = 0").unionByName(changed.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), F.col("op")).alias("r")).select("id", "r.*").select(rows.columns))

    # -- searching ---------------------------------------------------------------------------------------------------------
    def probed(self, query: Sequence[float], probes: int) -> DataFrame:
        """Living rows of the lists nearest to the query; on disk, other lists' files aren't read."""
        q = np.asarray(query, dtype=np.float64)[None]
        near = numpy_distances(self.centres, _unit(q) if self.metric is Distance.COSINE else q, Distance.EUCLID)[:, 0].argsort(kind="stable")[:probes].tolist()
        return self._alive(self.rows.filter(F.col("list").isin(near)))

    def search(self, query: Sequence[float], k: int, probes: int = 8, score_threshold: float | None = None, where: Column | None = None) -> DataFrame:
        """id, score of the k nearest in the probed lists."""
        return knn(self.probed(query, probes).select("id", "vector"), query, k, self.metric, where=where, score_threshold=score_threshold)

    def search_coded(self, query: Sequence[float], k: int, probes: int = 8, factor: int = 10) -> DataFrame:
        """As search, but the k * factor best by table lookups only are ranked by their exact distance."""
        if self.quantizer is None:
            raise ValueError("the index has no product codes: build it with parts")
        rows = self.probed(query, probes)
        kind = Distance.DOT if self.metric is Distance.DOT else Distance.EUCLID
        q = np.asarray(query, dtype=np.float64)
        best = rows.select("id", "vector", self.quantizer.adc(F.col("codes"), q, kind).alias("by_codes")).orderBy("by_codes", "id").limit(k * factor)
        return best.select("id", distance("vector", query, self.metric).alias("score")).orderBy("score", "id").limit(k)

    # -- looking in --------------------------------------------------------------------------------------------------------
    def sizes(self) -> DataFrame:
        """list, n: living points of each list."""
        return self._alive(self.rows).groupBy("list").agg(F.count("*").alias("n"))

    def ids(self) -> DataFrame:
        return self._alive(self.rows).select("id")

    def memory_bytes(self) -> int:
        """Bytes of the living vectors and codes, and of what each search holds: centres and codebooks."""
        row = F.lit(8) + 8 * F.size("vector") + F.coalesce(F.size("codes"), F.lit(0))
        held = self.centres.nbytes + sum(b.nbytes for b in (self.quantizer.books if self.quantizer else ()))
        return int(self._alive(self.rows).agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]) + held


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
