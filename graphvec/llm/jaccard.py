"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct n-word shingles (64-bit hashes). Equal sets are one class, so copies are never paired.
Shingles are ordered from rare to frequent by a count sketch over the whole corpus (ties by hash), which has about a counter
for every shingle (sized by the counted bytes of text; LEAST_BITS to MOST_BITS), and only the
prefix of a set in that order is posted. Two sets that reach the similarity share a posted shingle.

Round one pairs each posted set with the most typical set under the same shingle, the one whose shingles are the most
frequent on the whole: of near copies the one that the others were made from. Round two takes, under each shingle, the sets
that are not yet in the shingle's largest component, against all sets of other components. Each pair under a shingle is
thereby either in one component already or a candidate, so no link between components is lost, and a group of m near copies
costs about m pairs, not m * m. Candidates pass the length filter and the positional filter in the join (of what stands before
the common shingle only shingles posted by another set can be common; what stands behind counts whole), are made unique, pass the
suffix filter and are verified once, exactly. The suffix filter bounds an intersection three times. In the join, by odd sketches: a bit for each of ODD hash classes tells
whether a set has an odd number of shingles in it, and as many bits of two sets differ as shingles at most. Then by counts of
the shingles in BINS classes, small enough to send for every candidate; and, where whole sets meet, by halving. Nothing is gathered by key in one task: hot shingles meet in ordinary joins
and pre-aggregated sums.

Defined results: a set of fewer words than n is the whole sequence as one shingle; without words or text it is empty and
linked with nothing; a null doc_id is linked with nothing and has no component; rows that repeat an id and a text repeat the
result; different texts under one id are told apart by their sets, and classes with the same smallest id are one; extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_value, discard, documents, few, mapped, slices, tidied, tokens_of, written
from .components import components

#: Bits of the sketch's number of counters, bytes of text to a counter, and how many counters a row carries. MOST_BITS bounds
#: what a worker holds; beyond it rare shingles are told apart less well, which costs candidates and loses none.
LEAST_BITS, MOST_BITS, BYTES_A_COUNTER = 20, 26, 8
SKETCH_BLOCK = 1 << 16
#: Classes of which a task remembers that it has posted them.
REMEMBER = 500_000
#: Hash classes whose counts stand for a set in the suffix filter.
BINS = 64
#: Bits of an odd sketch, and the columns of 64 bits that hold it.
ODD = 256
SKETCHED = [f"o{k}" for k in range(ODD // 64)]
#: Bits of a packed posting: typicality (what is left, but for the sign), size of the set, place in the prefix.
N_BITS, POS_BITS = 28, 24
MOST_TYPICAL = (1 << 63 - N_BITS - POS_BITS) - 1
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = [tokens_of(t) for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, (w for ws in split for w in ws)), np.uint64, int(lengths.sum()))
    count = max(0, len(codes) - n + 1)
    h = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        h += codes[k : k + count] * np.uint64(MIX[k % len(MIX)])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    out, at = [], 0
    for ws, length in zip(split, lengths.tolist()):
        if length >= n:
            out.append(np.unique(h[at : at + length - n + 1]))
        elif length:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=length)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += length
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8")
    return int(a), int(b)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """For each of ODD hash classes whether it holds an odd number of shingles, as 64-bit integers."""
    odd = np.bincount(((s >> np.uint64(7)) % np.uint64(ODD)).astype(np.int64), minlength=ODD) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(docs: DataFrame) -> int:
    """For about one counter a shingle: counted, as texts have about BYTES_A_COUNTER bytes for each."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size) / BYTES_A_COUNTER))))


def typicality(common: np.ndarray) -> int:
    """How frequent a set's shingles (given by their levels, 0 to 255) are on the whole, in the bits that a posting has for it."""
    return min(MOST_TYPICAL, round(8 * float(common.mean())))


def _survey(n: int, bits: int):
    """Rows of documents (block null) and, at a task's end, of its part of the sketch (doc_id null)."""
    names = ["doc_id", "n", "d1", "d2", *SKETCHED, "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << bits, dtype=np.uint8)  # a task's counters stop at 250: such shingles are frequent in any case
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), n)
            for s in sets:
                places, many = np.unique(_bucket(s, bits), return_counts=True)
                sketch[places] = np.minimum(sketch[places] + many, 250)
            digests = [_digest(s) for s in sets]
            size, odd = len(sets), np.stack([odd_sketch(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), *[pa.array(odd[:, k].copy()) for k in range(len(SKETCHED))], pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=names)
        for block in range((1 << bits) // SKETCH_BLOCK):
            part = sketch[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * (4 + len(SKETCHED)), pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=names)

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels, about 16 for each doubling of the count, of the blocks of this partition; one running sum for each block."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
            if block not in total:
                total[block] = np.zeros(SKETCH_BLOCK, dtype=np.uint32)
            total[block] += np.frombuffer(zlib.decompress(counts), dtype=np.uint8)
    for block, counts in total.items():
        level = np.minimum(255, np.round(16 * np.log2(1.0 + counts))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "level"])


def _needed(percent: int) -> Column:
    """Least intersection of sets of n and n2 shingles: i * (100 + p) >= p * (n + n2)."""
    return F.expr(f"cast(({percent} * (n + n2) + {99 + percent}) div {100 + percent} as long)")


def _near(percent: int) -> Column:
    """Whether odd sketches (o0, ... and o02, ...) leave room for the intersection that sets of n and n2 shingles need."""
    apart = sum((F.bit_count(F.col(o).bitwiseXOR(F.col(o + "2"))) for o in SKETCHED), F.lit(0))
    return apart <= F.col("n") + F.col("n2") - 2 * _needed(percent)


def _candidates(pairs: DataFrame, percent: int) -> DataFrame:
    """Unique a < b of the pairs (node, n, pos, r, node2, n2, pos2, r2) that pass the length and the positional filter. r: how
    many of the `pos` shingles before are posted by another set."""
    fits = pairs.filter((F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent) & (F.least("r", "r2") + 1 + F.least(F.col("n") - 1 - F.col("pos"), F.col("n2") - 1 - F.col("pos2")) >= _needed(percent)))
    return fits.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """At least the size of the intersection of two sorted sets: halves of one against what lies beside its middle in the other."""
    if depth == 0 or not len(x) or not len(y):
        return min(len(x), len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    same = int(at < len(x) and x[at] == y[middle])
    return suffix_bound(x[:at], y[:middle], depth - 1) + same + suffix_bound(x[at + same :], y[middle + 1 :], depth - 1)


def _bins(s: np.ndarray) -> bytes:
    return np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS).astype("<i4").tobytes()


def _verify(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the similarity."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shingle_sets(batch.column("text").to_pylist(), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([_bins(s) for s in found], pa.binary())], names=["node", "s", "bins"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<i4").reshape(-1, BINS).astype(np.int64) for c in ("x", "y"))
            least = -(-percent * (x.sum(1) + y.sum(1)) // (100 + percent))
            yield batch.select(["a", "b"]).filter(pa.array(np.minimum(x, y).sum(1) >= least))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                least = -(-percent * (len(x) + len(y)) // (100 + percent))
                good = suffix_bound(x, y) >= least
                keep.append(good and len(np.intersect1d(x, y, assume_unique=True)) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # texts stay where they are read while the candidates are few
    nodes = few(written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "nodes"))
    found = written(docs.join(nodes, "doc_id", "left_semi").mapInArrow(sets, "node long, s binary, bins binary"), "sets")
    near = pairs.join(found.select(F.col("node").alias("a"), F.col("bins").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("bins").alias("y")), "b")
    near = near.select("a", "b", "x", "y").mapInArrow(bounded, "a long, b long")
    both = near.join(found.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    links = written(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct(), "links")
    discard(found)
    return links


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`: sets link when 100 * intersection >= percent * union."""
    spark, docs = docs.sparkSession, documents(docs)
    bits = sketch_bits(docs)
    survey = written(docs.mapInArrow(tidied(_survey(n, bits)), f"doc_id long, n long, d1 long, d2 long, {', '.join(f'{o} long' for o in SKETCHED)}, block int, counts binary"), "survey")
    members = survey.filter("block is null").select("doc_id", "n", "d1", "d2", *SKETCHED)
    held = bytearray(1 << bits)
    level = np.frombuffer(held, dtype=np.uint8)
    for r in survey.filter("block is not null").select("block", "counts").repartition(16, "block").mapInArrow(_sum_blocks, "block int, level binary").toLocalIterator():
        level[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["level"], dtype=np.uint8)
    rarity = broadcast_value(spark, held)
    del held, level

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        levels = mapped(rarity)
        for batch in slices(batches):
            keys, owner, place, rows = [], [], [], []  # rows: digest, size and typicality of each set
            for s in shingle_sets(batch.column("text").to_pylist(), n):
                if not len(s):
                    continue
                digest = _digest(s)
                if digest in seen:
                    continue
                if len(seen) < REMEMBER:
                    seen.add(digest)
                length = len(s) - -(-percent * len(s) // 100) + 1
                common = levels[_bucket(s, bits)]
                order = np.lexsort((s, common))[:length]
                keys.append(s[order])
                place.append(np.arange(length))
                owner.append(np.full(length, len(rows)))
                rows.append((*digest, len(s), typicality(common)))
            if not rows:
                continue
            d1, _, size, typical = (np.array(c, dtype=np.int64)[np.concatenate(owner)] for c in zip(*rows))
            packed = ((typical << N_BITS) | size) << POS_BITS | np.concatenate(place)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(d1), pa.array(packed)], names=["key", "d1", "packed"])

    # half a digest is enough here: should two classes share it, both become candidates, and candidates are verified
    posted = written(docs.filter(F.col("doc_id").isNotNull()).mapInArrow(tidied(post, rarity), "key long, d1 long, packed long"), "posted")
    rarity.destroy()
    # what is known of each shingle is written before it is joined: then a shingle that many sets post is split over tasks
    shared = written(posted.groupBy("key").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).filter("low <> high").select("key"), "shared")
    reps = members.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), *[F.first(o).alias(o) for o in SKETCHED])
    # sorted runs merge at every size, so the plan is the same for small inputs and large ones
    n_of, pos_of = F.expr(f"cast(shiftright(packed, {POS_BITS}) & {(1 << N_BITS) - 1} as int)").alias("n"), F.expr(f"cast(packed & {(1 << POS_BITS) - 1} as int)").alias("pos")
    # one exchange by set serves the ranks, the removal of copies that several tasks posted, and the join of the sets' ids
    before = F.dense_rank().over(Window.partitionBy("d1").orderBy(pos_of, "key")) - 1
    kept = posted.join(shared.hint("merge"), "key").withColumn("r", before).dropDuplicates(["d1", "key", "packed"])
    kept = written(kept.join(reps.select("d1", "node"), "d1").select("key", "node", "packed", "r"), "kept")
    discard(posted)
    wide = lambda *more: ["key", "node", n_of, pos_of, "r", *more]
    other = lambda *more: ["key", *[F.col(c).alias(c + "2") for c in ("node", "n", "pos", "r", *more)]]

    # round one: each set with the most typical under its shingle
    typical = F.expr(f"shiftright(packed, {N_BITS + POS_BITS})")
    first = written(kept.groupBy("key").agg(F.min(F.struct((-typical).alias("t"), "node", "packed", "r")).alias("f")).select("key", "f.node", "f.packed", "f.r"), "first").select(*wide()).select(*other())
    pairs = _candidates(kept.select(*wide()).join(first, "key").filter("node <> node2"), percent)
    odd = reps.select("node", "n", *SKETCHED)
    ends = odd.select(F.col("node").alias("a"), "n", *SKETCHED), odd.select(F.col("node").alias("b"), F.col("n").alias("n2"), *[F.col(o).alias(o + "2") for o in SKETCHED])
    pairs = written(pairs.join(ends[0], "a").join(ends[1], "b").filter(_near(percent)).select("a", "b").distinct(), "pairs")
    links = _verify(pairs, docs, n, percent)
    found = written(components(links), "found")

    # round two: what is not in its shingle's largest component, against the other components
    labelled = written(kept.join(found, "node", "left").select("key", "node", "packed", "r", F.coalesce("component", "node").alias("c")), "labelled")
    main = labelled.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "c")).alias("x"), F.count("*").alias("k")).filter("k > 1").select("key", F.col("x.c").alias("main"))
    main = written(main, "main")
    mixed = labelled.join(main, "key").join(odd.drop("n"), "node").select(*wide("c", "main", *SKETCHED))
    rest = mixed.filter("c <> main").select(*other("c", *SKETCHED))
    crossed = mixed.join(rest, "key").filter((F.col("c") != F.col("c2")) & ((F.col("c") == F.col("main")) | (F.col("node") < F.col("node2"))) & _near(percent))
    more = written(_candidates(crossed, percent).join(pairs, ["a", "b"], "left_anti"), "more")
    final = components(links.union(_verify(more, docs, n, percent)))

    classes = reps.join(final, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component"))
    out = members.join(classes, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `docs`, all columns, without those that are near copies of a document with a smaller id. Rows that repeat an id
    are one document and stay as often as they are there."""
    gone = few(written(join(docs, n, percent).filter("component_id <> doc_id").select("doc_id"), "gone"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
