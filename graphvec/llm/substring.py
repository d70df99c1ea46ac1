"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of each text: each byte's random value, shifted by its distance, over the last 16 bytes. A
chunk ends where the hash is the least of those of the NEAR bytes on either side, so the ends depend on nearby bytes only and
an insertion moves none beyond its surroundings; chunks have about 2 * NEAR + 1 bytes, and long gaps without an end are far
rarer than with a fixed mask. Where bytes repeat, equal least values follow each other; of those less than CLOSE apart the
next at CLOSE or more is taken, which gives equal chunks wherever such a stretch is entered. A chunk has MOST bytes at most.

Chunks are written once and matched by a 128-bit digest. A chunk that occurs in two documents or more is repeated; its first
place (smallest doc_id, then row and offset) is the one to keep. Adjacent repeated chunks form a stretch; stretches of
LEAST_RUN characters and more are reported, so that common short lines are left alone. A stretch is reported in runs, cut where
first places (kept) and other places meet: whoever removes all runs that aren't kept still has each chunk at its first place.

Digests are pre-aggregated before the shuffle. Those that hold a HOT_SHARE-th of all chunks or more, HOT_SHARE at most, are
broadcast, whatever their rows; all others are joined by a shuffle in which no key has a larger share. No group is gathered in
one task.

Defined results: null and empty texts have no chunks; rows without a doc_id are left out; a repeat within one document alone
isn't reported; rows with the same doc_id count as one document, but each row has its own runs; offsets are code points, ends
exclusive; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, row_base, slices, written

NEAR, CLOSE, MOST = 20, 8, 256
LEAST_RUN = 80
HOT_SHARE = 10_000
GAP = b"\x00" * 32
GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256).astype(np.uint16)
GEAR[0] = 0


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over k < 16 of gear[data[i - k]] << k, by doubling the window four times."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint16(width)
    return h


def least_near(h: np.ndarray) -> np.ndarray:
    """The least value of the NEAR on either side and of itself, by doubling the span."""
    span = 2 * NEAR + 1
    padded = np.full(len(h) + 2 * NEAR, 0xFFFF, dtype=np.uint16)
    padded[NEAR : NEAR + len(h)] = h
    width = 1
    while 2 * width <= span:
        padded = np.minimum(padded[:-width], padded[width:])
        width *= 2
    return np.minimum(padded[: len(h)], padded[span - width : span - width + len(h)])


def cut(data: np.ndarray) -> np.ndarray:
    """The bytes after which a chunk ends, but for the ends of texts and forced ends."""
    h = gear_hash(data)
    within = data != 0  # what lies between texts draws no end to it
    within[:-1] &= (data[1:] & 0xC0) != 0x80  # between characters only
    h[~within] = 0xFFFF
    places = np.flatnonzero((h == least_near(h)) & within)
    close = np.diff(places) < CLOSE
    if not close.any():
        return places
    kept = np.ones(len(places), dtype=bool)
    last = -1
    for i in (np.flatnonzero(close) + 1).tolist():
        if last < 0 or kept[i - 1] and i - 1 != last:
            last = i - 1
        kept[i] = places[i] - places[last] >= CLOSE
        last = i if kept[i] else last
    return places[kept]


def chunks(texts: list[str]) -> tuple[np.ndarray, ...]:
    """For each chunk: its text's place, two halves of its digest, start and end in code points."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    joined = GAP + GAP.join(parts) + GAP
    starts = len(GAP) + np.concatenate([[0], np.cumsum(sizes[:-1] + len(GAP))]).astype(np.int64)
    data = np.frombuffer(joined, dtype=np.uint8)
    inner = cut(data) + 1
    owner = np.searchsorted(starts, inner, side="right") - 1
    inside = (owner >= 0) & (inner > starts[owner]) & (inner < starts[owner] + sizes[owner])
    real = sizes > 0
    edge = np.unique(np.concatenate([inner[inside], starts[real], (starts + sizes)[real]]))
    lo, hi = edge[:-1], edge[1:]
    # what lies between two texts is no chunk
    own = np.searchsorted(starts[real], lo, side="right") - 1
    kept = hi <= (starts + sizes)[real][own] if len(own) else np.zeros(0, dtype=bool)
    lo, hi, own = lo[kept], hi[kept], np.flatnonzero(real)[own[kept]] if len(own) else own
    pieces = np.maximum(1, -(-(hi - lo) // MOST))
    if (pieces > 1).any():
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo, hi, own = np.repeat(lo, pieces) + nth * MOST, np.repeat(hi, pieces), np.repeat(own, pieces)
        hi = np.minimum(lo + MOST, hi)
    digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]), dtype="<i8").reshape(-1, 2)
    characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = characters[starts[own]] if len(own) else own
    return own, digest[:, 0], digest[:, 1], characters[lo] - base, characters[hi] - base


def chunk_table(docs: DataFrame) -> DataFrame:
    """doc_id, row, h1, h2, start, end: a row for each chunk; `row` tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = row_base()
        for batch in slices(batches):
            own, h1, h2, start, end = chunks(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own, pa.int64())), pa.array(row + own, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "row", "h1", "h2", "start", "end"])
            row += batch.num_rows

    return documents(docs).filter(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, row long, h1 long, h2 long, start int, end int")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, n_chunks, first_doc_id, kept: a row for each run of repeated chunks. kept: the run holds the
    first places of its chunks, so it stays when the others go. first_doc_id: the smallest doc_id that has one of its chunks."""
    found = written(chunk_table(docs), "chunks")
    seen = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter(F.col("first.doc_id") < F.col("last"))
    again = written(seen.select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start"), "n"), "again")
    least = -(-found.count() // HOT_SHARE)
    hot, cold = again.filter(F.col("n") >= least).drop("n"), again.filter(F.col("n") < least).drop("n")
    both = found.join(F.broadcast(hot), ["h1", "h2"], "left")
    columns = ["doc_id", "row", "start", "end", "first_doc", "first_row", "first_start"]
    rest = both.filter("first_row is null").drop("first_doc", "first_row", "first_start").join(cold, ["h1", "h2"])
    rows = both.filter("first_row is not null").select(columns).unionByName(rest.select(columns))
    rows = rows.select("doc_id", "row", "start", "end", "first_doc", ((F.col("row") == F.col("first_row")) & (F.col("start") == F.col("first_start"))).alias("is_first"))
    order = Window.partitionBy("row").orderBy("start")
    opens = F.col("start") != F.lag("end", 1, -1).over(order)
    turns = opens | (F.col("is_first") != F.lag("is_first", 1, False).over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("opens", opens.cast("int")).withColumn("turns", turns.cast("int")).withColumn("stretch", F.sum("opens").over(so_far)).withColumn("run", F.sum("turns").over(so_far))
    runs = marked.groupBy("row", "stretch", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.min("first_doc").alias("first_doc_id"), F.first("is_first").alias("kept"))
    whole = Window.partitionBy("row", "stretch")
    long = runs.withColumn("length", F.max("end").over(whole) - F.min("start").over(whole)).filter(F.col("length") >= LEAST_RUN)
    return long.select("doc_id", "start", "end", "n_chunks", "first_doc_id", "kept")
