"""Benchmark decontamination by SimHash of item-sized windows.

Each benchmark item has a weighted SimHash of 128 bits over its five-word shingles (rare shingles weigh more). In a text, each
window with as many words as an item has gets a SimHash too. A multi-index of eight 16-bit blocks finds every item whose
fingerprint lies within RADIUS bits: of two fingerprints that differ in at most RADIUS bits one block differs in at most
RADIUS // 8. For each block a directory holds the distinct values and the items behind them; a window meets only items behind
values that near, 8 % of unrelated ones. Candidates are verified by their exact weighted-shingle similarity, sum of w * min
over sum of w * max of the shingle counts, SIMILARITY or more.

A shingle's weight comes from the number of items that hold it, counted over the whole benchmark. Shingles of one item and of
none weigh the same, so only those that two items share are listed, in one broadcast table; results don't depend on how items
are dealt over blocks.

A window that shares no shingle with any item can't reach the similarity, so fingerprints are computed around shared
shingles only, for the sizes of the items that have them; that loses nothing. Texts are read once for each block of
BLOCK_WORDS words of items and nothing is shuffled; each block is broadcast by itself, whatever the size of the benchmark.

Words: runs without white space of the lower-cased text with ASCII punctuation cleared. Defined results: null and empty
texts and items match nothing; an item or window of fewer than five words is one shingle, its whole sequence; a text
shorter than an item is one window; repeated items and rows are each reported; of the windows of one item in one text the
most similar, of equal ones the first, is reported; extra columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, documents, slices, tidied, written

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 128, 8, 31
#: Words of items that are broadcast at a time.
BLOCK_WORDS = 4_000_000
#: Windows that get their fingerprints at a time.
WINDOWS = 4096
CLEAR = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _ones() -> np.ndarray:
    """How many bits are set in each 16-bit value."""
    ones = np.zeros(1, dtype=np.uint8)
    for _ in range(16):
        ones = np.concatenate([ones, ones + 1])
    return ones.astype(np.uint8)


ONES = _ones()


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(CLEAR).split()


def hashed(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def mixed(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the runs of `size` in an array of word codes."""
    n = max(0, len(codes) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out += codes[k : k + n] * np.uint64(MIX[k])
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def shingles(ws: list[bytes]) -> np.ndarray:
    """Hashes of a word list's shingles, in order."""
    return mixed(hashed(ws), min(SHINGLE, len(ws)))


def signs(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight or its negative for each hash and each of BITS bits; the second half is drawn from the hash mixed once more."""
    other = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    both = np.stack([hashes, other ^ (other >> np.uint64(30))], 1).astype("<u8")
    bits = np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").astype(np.int32)
    return (2 * bits - 1) * weights[:, None].astype(np.int32)


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Rows of eight 16-bit blocks from rows of BITS sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u2")


class Weights:
    """Weights of shingles. hashes: those that two of the `n` items or more hold, in order; items: how many do."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray, n: int):
        self.hashes, self.items, self.n = hashes, items, n
        self.other = max(1, round(16 * math.log1p(n)))

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.other, dtype=np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = self.hashes[at] == h
            out[found] = np.maximum(1, np.round(16 * np.log1p(self.n / self.items[at[found]])))
        return out


def weights_of(benchmark: DataFrame) -> Weights:
    """Counted over all items by Spark; a row for each shingle that several items share comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            each = [np.unique(shingles(ws)) for t in batch.column("text").to_pylist() if (ws := words(t or ""))]
            h = np.concatenate(each) if each else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(h.view(np.int64)), pa.nulls(len(each), pa.int64())])], names=["h"])

    counts = written(benchmark.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")), "shingles")
    n = counts.filter("h is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = counts.filter("h is not null and n > 1").toArrow()
    h = shared["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return Weights(h[order], shared["n"].to_numpy()[order], n)


class Items:
    """A block of benchmark items, ready to be matched."""

    def __init__(self, rows: list[tuple[int, str]], weights: Weights):
        split = [(i, words(t or "")) for i, t in rows]
        split = [(i, w) for i, w in split if w]
        self.ids, self.weights = [i for i, _ in split], weights
        self.size = [len(w) for _, w in split]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({x for _, ws in split for x in ws}))}
        each = [shingles(w) for _, w in split]
        self.shingles = [np.unique(h, return_counts=True) for h in each]
        self.total = [int((weights.of(h) * n).sum()) for h, n in self.shingles]
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for k, size in enumerate(self.size):
            self.by_size[size].append(k)
        self.prints = {size: np.concatenate([fingerprint(signs(each[k], weights.of(each[k])).sum(0, keepdims=True)) for k in ks]) for size, ks in self.by_size.items()}
        # the multi-index: for each size and block the distinct values, and which of them each item has
        self.index = {size: [np.unique(p[:, b], return_inverse=True) for b in range(BLOCKS)] for size, p in self.prints.items()}
        # shared shingles are looked for by vocabulary codes: for each shingle size the hashes, and the item sizes that have them
        self.known: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        sizes_of: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for _, ws in split:
            size = min(SHINGLE, len(ws))
            for h in mixed(np.array([self.vocabulary[x] for x in ws], dtype=np.uint64), size).tolist():
                sizes_of[size][h].add(len(ws))
        for size, found in sizes_of.items():
            order = sorted(found)
            self.known[size] = np.array(order, dtype=np.uint64), [sorted(found[h]) for h in order]

    def near(self, prints: np.ndarray, size: int) -> np.ndarray:
        """Whether some block of a window's fingerprint is near that of an item of `size` words: windows x items."""
        out = np.zeros((len(prints), len(self.by_size[size])), dtype=bool)
        for b, (values, which) in enumerate(self.index[size]):
            out |= (ONES[prints[:, b, None] ^ values[None, :]] <= RADIUS // BLOCKS)[:, which]
        return out

    def similarity(self, window: np.ndarray, weight: np.ndarray, k: int) -> float:
        """Exact weighted-shingle similarity of item k and a window, given by its shingles' hashes and their weights."""
        h, first, n = np.unique(window, return_index=True, return_counts=True)
        item, m = self.shingles[k]
        _, i, j = np.intersect1d(h, item, assume_unique=True, return_indices=True)
        w = weight[first]
        both = int((np.minimum(n[i], m[j]) * w[i]).sum())
        return both / (int((n * w).sum()) + self.total[k] - both)

    def match(self, ws: list[bytes], hits: list[tuple[int, int, list[int]]]) -> list[tuple[int, float, int, int, int]]:
        """item, similarity, distance, start and end of the best window for each item. hits: place and size of shared
        shingles, and the sizes of the items that have them."""
        starts: dict[int, set[int]] = defaultdict(set)
        n = len(ws)
        for at, size, lengths in hits:
            for length in lengths:
                if n <= length:
                    starts[length].add(0)
                else:
                    starts[length].update(range(max(0, at + size - length), min(at, n - length) + 1))
        best: dict[int, tuple[float, int, int, int, int]] = {}
        for length, found in starts.items():
            if min(SHINGLE, length) != min(SHINGLE, n) and n < SHINGLE:
                continue  # a text of fewer words than a shingle is one shingle of another size
            size, order = min(SHINGLE, length, n), sorted(found)
            for lo in range(0, len(order), WINDOWS):
                at = np.array(order[lo : lo + WINDOWS])
                first, last = int(at[0]), min(n, int(at[-1]) + length)
                h = mixed(hashed(ws[first:last]), size)
                weight = self.weights.of(h)
                sums = np.zeros((len(h) + 1, BITS), dtype=np.int32)
                np.cumsum(signs(h, weight), axis=0, out=sums[1:])
                ends = np.minimum(at + length, n)
                prints = fingerprint(sums[ends - first - size + 1] - sums[at - first])
                for i, j in zip(*(x.tolist() for x in np.nonzero(self.near(prints, length)))):
                    distance = int(ONES[prints[i] ^ self.prints[length][j]].sum())
                    if distance > RADIUS:
                        continue
                    k, s, e = self.by_size[length][j], int(at[i]), int(ends[i])
                    window = slice(s - first, e - first - size + 1)
                    like = self.similarity(h[window], weight[window], k)
                    if like >= SIMILARITY and (k not in best or (like, -s) > (best[k][0], -best[k][2])):
                        best[k] = (like, distance, s, e, k)
        return [(k, like, distance, s, e) for like, distance, s, e, k in best.values()]


def find(items: Items, texts: list[str]) -> Iterator[tuple[int, int, float, int, int, int]]:
    """Place of the text, item, similarity, distance, start and end (in words)."""
    split = [words(t) for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    codes = np.fromiter(map(items.vocabulary.get, (w for ws in split for w in ws), repeat(0)), np.int64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    hits: dict[int, list[tuple[int, int, list[int]]]] = defaultdict(list)
    for size, (known, sizes) in items.known.items():
        if len(codes) < size:
            continue
        inside = codes[: len(codes) - size + 1] > 0
        for k in range(1, size):
            inside &= codes[k : len(codes) - size + 1 + k] > 0
        at = np.flatnonzero(inside)
        owner = np.searchsorted(ends, at, side="right")
        at, owner = at[at + size <= ends[owner]], owner[at + size <= ends[owner]]
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):  # as in mixed()
            h += codes[at + k].astype(np.uint64) * np.uint64(MIX[k])
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        found = known[place] == h
        for a, o, x in zip(at[found].tolist(), owner[found].tolist(), place[found].tolist()):
            hits[o].append((a - int(ends[o] - lengths[o]), size, sizes[x]))
    for o, found in hits.items():
        for k, like, distance, s, e in items.match(split[o], found):
            yield o, items.ids[k], like, distance, s, e


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Blocks of BLOCK_WORDS words of items (a longer item goes alone); the driver holds one at a time."""
    weights = weights_of(benchmark)
    rows: list[tuple[int, str]] = []
    held = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator():
        size = len(words(r["text"]))
        if rows and held + size > BLOCK_WORDS:
            yield Items(rows, weights)
            rows, held = [], 0
        rows.append((r["item_id"], r["text"]))
        held += size
    if rows:
        yield Items(rows, weights)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, hamming, start_word, end_word: a row for each text and item it holds, no others."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, similarity double, hamming int, start_word int, end_word int"
    texts, out = documents(docs), None
    for block in item_blocks(benchmark):
        if not block.ids:
            continue
        shared = broadcast_value(spark, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[o], *r) for o, *r in find(shared.value, batch.column("text").to_pylist())]
                columns = list(zip(*rows)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "similarity", "hamming", "start_word", "end_word"])

        found = texts.mapInArrow(tidied(run, shared), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs`, all columns, that hold no item. Texts are matched where they lie, by one worker in each task: what a
    block leaves is written before the next one, if there is one, takes it."""
    out, matched = docs, False
    for block in item_blocks(benchmark):
        if not block.ids:
            continue
        shared = broadcast_value(docs.sparkSession, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                bad = {o for o, *_ in find(shared.value, [t or "" for t in batch.column("text").to_pylist()])}
                yield batch.filter(pa.array([o not in bad for o in range(batch.num_rows)], pa.bool_()))

        out, matched = (written(out, "unmatched") if matched else out).mapInArrow(tidied(run, shared), docs.schema), True
    return out
