"""Shared plumbing of the training-data operators: bounded Arrow slices, scratch tables, document folds."""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpoint_dir

#: Bytes of text that one worker turns into Python objects at a time.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch on its way to a worker: JVM buffers and the worker's copy stay small beside a task's share.
BATCH_BYTES = 8 << 20
#: Rows and bytes up to which a table is broadcast, after both were counted.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Set the session's limit of Arrow batches to BATCH_BYTES. Operators call this; only batch sizes depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """Only the columns that an operator reads; a null text becomes the empty text."""
    small_batches(df.sparkSession)
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *[F.col(c) for c in extra],
    )


def fold(column: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: the shared folder's owner clears it
        pass


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if its counted rows are `rows` at most and take BROADCAST_BYTES at most as JSON; beyond that
    Spark shuffles the join."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= BROADCAST_BYTES else df


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written once to the shared folder and read back: lineage ends here, and a lost executor costs nothing.

    The files go when the Python process ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/graphvec-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.graphvec_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table that `written` made, once nothing reads it any more."""
    _remove(df.sparkSession, df.graphvec_path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about `limit` bytes of `column`; one longer text goes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)
    give_back()


def give_back() -> None:
    """Memory that this worker has freed goes back to the system, for workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run, *shared):
    """`run`, a map over batches, and at its task's end the worker's copies of broadcast values go, and the memory that they and
    the task took: a worker lives on, idle at times, while other stages need the memory. The next task reads them again."""

    def map_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for value in shared:
            value.__dict__.pop("_value", None)
        give_back()

    return map_


def tokens_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lowered. On bytes, lower() and split() know ASCII only, which is the rule."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def row_base() -> int:
    """First row number of this task: tasks don't share numbers."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 40


def mapped(shared) -> np.ndarray:
    """The bytes of a broadcast `bytearray`. A worker maps the file that its executor keeps for all workers, so that none has a
    copy of its own; where there is no such file, or it does not hold the bytes in one piece, they are read as usual."""
    path = shared.__dict__.get("_path") if "_value" not in shared.__dict__ else None
    try:
        with open(path, "rb") as f:
            head = f.read(64)
        at = head.find(b"\x96") + 9  # pickle's mark of a bytearray: its length in eight bytes follows, then the bytes themselves
        size = int.from_bytes(head[at - 8 : at], "little")
        if at > 8 and size > len(head) and 0 <= os.path.getsize(path) - at - size < 16:
            return np.memmap(path, np.uint8, "r", at, (size,))
    except (OSError, TypeError):
        pass
    return np.frombuffer(shared.value, np.uint8)


def broadcast_value(spark: SparkSession, value):
    """For values of a size that a parameter bounds."""
    return spark.sparkContext.broadcast(value)
