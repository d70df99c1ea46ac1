"""The mutation log: rows (lsn, op, ids, point, edge, aborted_lsn), replayed as one aggregate, or applied batch by batch from
a stream. Operations: upsert, delete, add_edge, remove_edge, abort (of an earlier lsn), checkpoint."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..collection import Collection, latest
from ..model import EDGES, POINTS, CollectionConfig

#: Entries after which the collection is written anew.
SNAPSHOT_ENTRIES = 10_000
LOG = T.StructType([
    T.StructField("lsn", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("point", T.StructType([T.StructField(f.name, f.dataType) for f in POINTS])),
    T.StructField("edge", T.StructType([T.StructField(f.name, f.dataType) for f in EDGES])),
    T.StructField("aborted_lsn", T.LongType()),
])


def surviving(log: DataFrame) -> DataFrame:
    """Entries that no abort names."""
    aborted = log.filter("op = 'abort'").select(F.col("aborted_lsn").alias("lsn"))
    return log.filter("op not in ('abort', 'checkpoint')").join(aborted, "lsn", "left_anti")


def last_writes(log: DataFrame) -> DataFrame:
    """For each point id its last upsert or delete: id, op, lsn, point."""
    upserts = log.filter("op = 'upsert'").select(F.col("point.id").alias("id"), "op", "lsn", "point")
    deletes = log.filter("op = 'delete'").select(F.explode("ids").alias("id"), "op", "lsn", F.lit(None).cast(LOG["point"].dataType).alias("point"))
    return latest(upserts.unionByName(deletes), "id", "lsn")


def apply_log(collection: Collection, log: DataFrame) -> Collection:
    """The collection after the log: what each entry would do in the order of lsn, worked out by the last write of each key."""
    log = surviving(log)
    writes = last_writes(log)
    upserted = writes.filter("op = 'upsert'").select("point.*")
    points = collection.points.join(writes.select("id"), "id", "left_anti").select(upserted.columns).unionByName(upserted)
    touched = log.filter("op in ('add_edge', 'remove_edge')").select("lsn", "op", "edge.*")
    # the last removal of an edge (of its relation, or of all), then the first addition behind it wins
    old = collection.edges.select(*EDGES.names, F.lit(-1).cast("long").alias("lsn"))
    added = old.unionByName(touched.filter("op = 'add_edge'").select(*EDGES.names, "lsn"))
    gone = touched.filter("op = 'remove_edge'")
    by_kind = gone.filter("relation is not null").groupBy("src", "dst", "relation").agg(F.max("lsn").alias("gone"))
    all_kinds = gone.filter("relation is null").groupBy("src", "dst").agg(F.max("lsn").alias("gone_all"))
    alive = added.join(by_kind, ["src", "dst", "relation"], "left").join(all_kinds, ["src", "dst"], "left").filter(F.col("lsn") > F.greatest(F.coalesce("gone", F.lit(-2)), F.coalesce("gone_all", F.lit(-2))))
    edges = latest(alive.select(*EDGES.names, "lsn"), ["src", "dst", "relation"], "lsn", first=True).select(*EDGES.names)
    return replace(collection, points=points, edges=edges)


def replay(spark: SparkSession, config: CollectionConfig, log: DataFrame) -> Collection:
    """The collection that a log alone gives."""
    return apply_log(Collection.empty(spark, config), log)


class LogSink:
    """A stored collection kept by a log. Under `path` each batch of entries is a folder of its own, log/b<number>, and now and
    then a snapshot v<number> holds the collection after that batch: what a batch costs depends on its entries alone, and the
    collection is rewritten once in `snapshot_entries` entries. A batch or snapshot counts when it was written whole, and is
    written again when it is repeated, so a restart does no harm. lsn must rise from batch to batch; an abort must come
    before the snapshot that holds the entry it names."""

    def __init__(self, spark: SparkSession, config: CollectionConfig, path: str, snapshot_entries: int = SNAPSHOT_ENTRIES):
        self.spark, self.config, self.path, self.snapshot_entries = spark, config, path, snapshot_entries

    def _numbers(self, folder: str, letter: str, mark: str) -> list[int]:
        """Numbers of the folders that hold `mark`, which is written last."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        where = path(folder)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n[1:]) for n in names if n.startswith(letter) and n[1:].isdigit() and fs.exists(path(f"{folder}/{n}/{mark}")))

    def versions(self) -> list[int]:
        """Snapshots that were written whole: config comes last."""
        return self._numbers(self.path, "v", "config/_SUCCESS")

    def batches(self) -> list[int]:
        return self._numbers(f"{self.path}/log", "b", "_SUCCESS")

    def entries(self, numbers: list[int]) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/log/b{n}" for n in numbers]) if numbers else self.spark.createDataFrame([], LOG)

    def _since(self, before: int | None) -> tuple[int | None, list[int]]:
        """The newest snapshot, and the batches behind it."""
        found = [v for v in self.versions() if before is None or v < before]
        last = found[-1] if found else None
        return last, [b for b in self.batches() if (last is None or b > last) and (before is None or b < before)]

    def current(self, before: int | None = None) -> Collection:
        """The collection after all batches, or those before a number."""
        from ..sources.store import load_collection

        last, numbers = self._since(before)
        base = Collection.empty(self.spark, self.config) if last is None else load_collection(self.spark, f"{self.path}/v{last}")
        return apply_log(base, self.entries(numbers)) if numbers else base

    def append(self, batch: DataFrame, number: int) -> None:
        """Write a batch of entries to the log: from here on it lasts."""
        batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOG]).write.mode("overwrite").parquet(f"{self.path}/log/b{number}")

    def snapshot(self) -> int | None:
        """Write the collection as it is now; returns its number. The log stays, for whoever reads an older state."""
        from ..sources.store import export_collection

        last, numbers = self._since(None)
        if not numbers:
            return last
        export_collection(self.current(), f"{self.path}/v{numbers[-1]}", mode="overwrite")
        return numbers[-1]

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """A batch of a stream: logged, and followed by a snapshot when enough entries have come together."""
        self.append(batch, batch_id)
        if self.entries(self._since(None)[1]).count() >= self.snapshot_entries:
            self.snapshot()

    def start(self, log: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return log.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class DurableCollection:
    """Mutations that are logged before they are applied. One that turns out to be wrong after it was logged gets an abort
    entry for each of its entries, so a replay leaves it out, and raises. One writer at a time."""

    def __init__(self, sink: LogSink):
        self.sink, self.spark = sink, sink.spark

    @property
    def collection(self) -> Collection:
        return self.sink.current()

    def _log(self, op: str, rows: DataFrame, column: str, check=None) -> Collection:
        """rows: a column `column` of LOG for each entry."""
        numbers = self.sink.batches()
        number = numbers[-1] + 1 if numbers else 0
        least = self.sink.entries(numbers).agg(F.max("lsn")).first()[0]
        filled = [rows[f.name] if f.name == column else F.lit(None).cast(f.dataType).alias(f.name) for f in LOG if f.name not in ("lsn", "op")]
        lsn = F.monotonically_increasing_id() + (0 if least is None else least + 1)
        self.sink.append(rows.select(lsn.alias("lsn"), F.lit(op).alias("op"), *filled), number)
        try:
            if check:
                check(self.sink.entries([number]))
        except ValueError:
            wrong = self.sink.entries([number])
            last = wrong.agg(F.max("lsn")).first()[0]
            aborts = wrong.select((F.monotonically_increasing_id() + last + 1).alias("lsn"), F.lit("abort").alias("op"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in LOG if f.name in ("ids", "point", "edge")], F.col("lsn").alias("aborted_lsn"))
            self.sink.append(aborts, number + 1)
            raise
        if self.sink.entries(self.sink._since(None)[1]).count() >= self.sink.snapshot_entries:
            self.sink.snapshot()
        return self.collection

    def upsert(self, points: DataFrame) -> Collection:
        """Points (as POINTS; missing columns are null). A vector of another size aborts the whole batch."""

        def check(entries: DataFrame) -> None:
            if not entries.filter(F.size("point.vector") != self.sink.config.size).isEmpty():
                raise ValueError(f"a vector has not {self.sink.config.size} components")

        fields = [(F.col(f.name) if f.name in points.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in POINTS]
        return self._log("upsert", points.select(F.struct(*fields).alias("point")), "point", check)

    def delete(self, ids: DataFrame) -> Collection:
        return self._log("delete", ids.select(F.array(F.col("id").cast("long")).alias("ids")), "ids")

    def add_edges(self, edges: DataFrame) -> Collection:
        return self._log("add_edge", self._edges(edges), "edge")

    def remove_edges(self, edges: DataFrame) -> Collection:
        """Edges by src, dst and relation; with a null relation all from src to dst."""
        return self._log("remove_edge", self._edges(edges), "edge")

    def _edges(self, edges: DataFrame) -> DataFrame:
        fields = [(F.col(f.name) if f.name in edges.columns else F.lit(1.0 if f.name == "weight" else None)).cast(f.dataType).alias(f.name) for f in EDGES]
        return edges.select(F.struct(*fields).alias("edge"))

    def checkpoint(self) -> int | None:
        return self.sink.snapshot()
