"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

A word is a leaf of a tree of three levels of BRANCH: P(word | history) = P(class | history) * P(subclass | class, history) *
P(leaf | subclass, history) * P(word | leaf). The OWN most frequent words have a leaf each; all others are dealt over GROUPS
leaves by hash, inside which a word's probability is its smoothed share of the leaf's counts. So context moves rare words as
well, and the model is a distribution over all words, unseen ones included. Each level is a softmax over hashed features of the
history: the word before, the pair before, and the word over a skip; a level below takes them beside the node above.

Training: one pass counts every training token (Spark sums); one counts, for each row of weights, the branches that followed;
then gradient passes compare these with what the model expects. Each task adds up its part of the gradient, parts are summed in
blocks, and the driver moves the weights by the logarithm of one plus the preconditioned gradient, damped. The first step
takes the priors for expectations, each later one what the model expects at every position of every training text. The number
of tokens counted sizes the table of weights: twice the rows for four times the tokens, up to MOST_BITS more than for 2^22
tokens (what tasks and driver hold is bounded; beyond that features share rows more often, none is dropped). The gradient
passes run in as many tasks as there are cores twice over, or one for FILES_A_TASK partitions of text where that is more: each
task sends one table, so few tasks send little, and no task grows with the corpus.

Scoring looks KNOWN frequent words up in a broadcast table of bounded size and joins the counts of all others by a shuffle, so
no word is dropped.

Words: `[^\\x20\\x09-\\x0D]+` with A-Z lowered, then one end of text. Defined results: null text counts as empty and has the
end alone; without training rows every count is 0 and the score is that of an unseen word; repeated rows are scored
each by itself and train each; a null doc_id falls in the fold of the empty text; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, documents, row_base, slices, tokens_of, written

BRANCH = 16
LEAVES = BRANCH**3
OWN = LEAVES // 2
GROUPS = LEAVES - OWN
KNOWN = 150_000
OTHERS = 1 << 16
#: Of each level: the features (0: the word before; 1, 2: those over a skip of one and two words; 3: the pair before) and, for
#: 2^22 tokens, the bits of their hashes.
FEATURES = ((0, 1, 3), (0, 1), (0,))
HASH_BITS = (12, 10, 8)
LEAST_BITS, MOST_BITS = -4, 7
BLOCK, FILES_A_TASK = 1 << 16, 16
#: A rate for each step; weight of the prior beside what is expected.
RATES, PRIOR = (0.45, 0.3, 0.3), 60.0
CHUNK = 4096
#: No word holds white space, so these can't be words.
END = b"\n"
LONG_WORD = 24


def key_of(word: bytes) -> bytes:
    """A word, or a tab and the digest of a long one."""
    return word if len(word) <= LONG_WORD else b"\t" + xxhash.xxh3_128_digest(word)


def group_of(key: bytes) -> int:
    """The group that a word shares a leaf with, unless it has its own."""
    return xxhash.xxh32_intdigest(key) % OTHERS % GROUPS


class Lexicon:
    """What the token counts give: known words by rank, their counts, the groups' tokens and types, totals."""

    def __init__(self, words: list[bytes], counts: np.ndarray, group_tokens: np.ndarray, group_types: np.ndarray):
        """group_tokens, group_types: of all words by group, those with a leaf of their own included."""
        self.words, self.counts = words, counts.astype(np.int64)
        self.tokens, self.types = int(group_tokens.sum()), int(group_types.sum())
        self.known = len(words)
        self.own = min(OWN, self.known)
        groups = np.fromiter(map(group_of, words), np.int64, len(words))
        inside_tokens = group_tokens - np.bincount(groups[: self.own], weights=self.counts[: self.own], minlength=GROUPS)
        inside_types = group_types - np.bincount(groups[: self.own], minlength=GROUPS)
        # leaves and, for words in groups, log10 of what their counts are shares of
        self.leaf_of = np.concatenate([np.arange(self.own), OWN + groups[self.own :], OWN + np.arange(OTHERS) % GROUPS])
        self.log_share = np.where(self.leaf_of >= OWN, np.log10(inside_tokens + inside_types + 1)[np.maximum(self.leaf_of - OWN, 0)], 0.0)
        mass = np.concatenate([np.zeros(OWN), inside_tokens + 0.5])
        mass[: self.own] = self.counts[: self.own]
        # a leaf's branches: its number's digits, the lowest first, so that frequent words stand apart
        tree = (mass / mass.sum()).reshape(BRANCH, BRANCH, BRANCH).transpose(2, 1, 0)
        self.priors = [(t + 1e-9) / (t + 1e-9).sum(1, keepdims=True) for t in (tree.sum((1, 2))[None], tree.sum(2), tree.reshape(-1, BRANCH))]
        self.log_count = np.zeros(self.known + OTHERS)
        self.log_count[: self.known] = np.log10(self.counts + 1.0)
        grown = min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(1, self.tokens) / (1 << 22)) / 2)))
        self.bits = tuple(b + grown for b in HASH_BITS)

    def ids(self) -> dict[bytes, int]:
        """Ranks of the known words."""
        if "_ids" not in self.__dict__:
            self._ids = dict(zip(self.words, range(len(self.words))))
        return self._ids

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_ids"}


def coded(lexicon: Lexicon, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Codes of the tokens of all texts, one after the other, the tokens' places in their texts, and the words."""
    split = [tokens_of(t) for t in texts]
    for ws in split:
        ws.append(END)
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    total = int(lengths.sum())
    flat = list(chain.from_iterable(split))
    codes = np.fromiter(map(lexicon.ids().get, flat, repeat(-1)), np.int64, total)
    place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    unknown = np.flatnonzero(codes < 0)
    long = [i for i in unknown.tolist() if len(flat[i]) > LONG_WORD]  # known by their digests only, so none was found yet
    if long:
        for i, d in zip(long, (np.searchsorted(np.cumsum(lengths), long, side="right")).tolist()):
            flat[i] = split[d][int(place[i])] = key_of(flat[i])
            codes[i] = lexicon.ids().get(flat[i], -1)
        unknown = np.flatnonzero(codes < 0)
    codes[unknown] = [lexicon.known + xxhash.xxh32_intdigest(flat[i]) % OTHERS for i in unknown.tolist()]  # codes behind the known ones
    return codes, place, split


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the tokens of all rows, one after the other, and their places in their texts."""
    packed = batch.column("codes").to_pylist()
    lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    codes = np.frombuffer(b"".join(packed), dtype="<i4").astype(np.int64)
    return codes, np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Layout:
    """Where the rows of weights stand: for each level and feature a block of hash values times nodes above."""

    def __init__(self, bits: tuple[int, ...]):
        self.bits, self.start, at = bits, [], 0
        for level, features in enumerate(FEATURES):
            nodes = BRANCH**level
            self.start.append([at + k * (nodes << bits[level]) for k in range(len(features))])
            at += len(features) * (nodes << bits[level])
        self.rows = at

    def of(self, codes: np.ndarray, place: np.ndarray, leaf: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """For each level the nodes above and the rows of the features at the positions `at`. leaf: of the words there."""
        start = 1 << 40  # stands for what is before a text
        back = [np.where(place[at] >= k, codes[np.maximum(at - k, 0)], start).astype(np.uint64) for k in (1, 2, 3)]
        values = [b * np.uint64(4) + np.uint64(k) for k, b in enumerate(back)]
        values.append((back[0] * np.uint64(0xC2B2AE3D) + back[1]) * np.uint64(4) + np.uint64(3))
        for x in values:
            x ^= x >> np.uint64(31)
            x *= np.uint64(0x9E3779B97F4A7C15)
        out, node = [], np.zeros(len(at), dtype=np.int64)
        for level, features in enumerate(FEATURES):
            if level:
                node = node * BRANCH + leaf // BRANCH ** (level - 1) % BRANCH
            rows = [s + (values[f] >> np.uint64(64 - self.bits[level])).astype(np.int64) * BRANCH**level + node for s, f in zip(self.start[level], features)]
            out.append((node, rows))
        return out


class Model:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.layout = lexicon, Layout(lexicon.bits)
        self.weights = np.zeros((self.layout.rows, BRANCH), dtype=np.float32)
        self.bias = [np.log(p).astype(np.float32) for p in lexicon.priors]

    def prior_rows(self) -> np.ndarray:
        """The prior over its branches for each row of weights."""
        out = np.empty((self.layout.rows, BRANCH), dtype=np.float32)
        for prior, starts, bits in zip(self.lexicon.priors, self.layout.start, self.lexicon.bits):
            for s in starts:
                out[s : s + (len(prior) << bits)] = np.tile(prior, (1 << bits, 1))
        return out

    def shares(self, level: int, node: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """Positions x branches."""
        x = np.take(self.bias[level], node, axis=0, mode="clip")
        for r in rows:
            x += np.take(self.weights, r, axis=0, mode="clip")
        np.minimum(x, 80, out=x)
        np.exp(x, out=x)
        x /= (x @ np.ones(BRANCH, dtype=np.float32))[:, None]
        return x

    def log10(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """For each token log10 of its leaf's share."""
        out = np.zeros(len(codes))
        for lo in range(0, len(codes), CHUNK):
            at = np.arange(lo, min(lo + CHUNK, len(codes)))
            leaf = self.lexicon.leaf_of[codes[at]]
            for level, (node, rows) in enumerate(self.layout.of(codes, place, leaf, at)):
                p = self.shares(level, node, rows)[np.arange(len(at)), leaf // BRANCH**level % BRANCH]
                out[at] += np.log10(np.maximum(p, 1e-30))
        return out

    def step(self, seen: np.ndarray, expected: np.ndarray, rate: float, prior: np.ndarray) -> None:
        """Move the weights by the damped, preconditioned gradient; in blocks, as the tables are large."""
        for k in range(0, len(seen), BLOCK):
            s, e = seen[k : k + BLOCK], expected[k : k + BLOCK]
            gradient = (s - e) / (e + PRIOR * prior[k : k + BLOCK] + 1e-9)
            self.weights[k : k + BLOCK] += (rate * np.log1p(np.maximum(gradient, -0.98))).astype(np.float32)


def _blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's vector in compressed blocks; none where all is zero."""
    press = zstandard.ZstdCompressor(level=1)
    for k in range(0, len(total), BLOCK):
        part = total[k : k + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([press.compress(part.tobytes())], pa.binary())], names=["block", "part"])


def _summed(parts: DataFrame, size: int, sent: str, held: str) -> np.ndarray:
    """Sum of the tasks' vectors (type `sent`). Blocks are added up as they stream by; the driver gets one of each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, part in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist()):
                part = np.frombuffer(unpress.decompress(part), dtype=sent)
                if k not in total:
                    total[k] = np.zeros(len(part), dtype="i8" if sent == "i4" else "f8")
                total[k] += part
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.astype(held).tobytes()], pa.binary())], names=["block", "part"])

    out = np.zeros(size, dtype=held)
    for r in parts.repartition(24, "block").mapInArrow(add, "block int, part binary").toLocalIterator():
        x = np.frombuffer(r["part"], dtype=held)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(x)] = x
    return out


def count(docs: DataFrame) -> DataFrame:
    """key, g, c: how often each token occurs in the training texts, and its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def emit():
            keys = list(map(key_of, total))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(map(group_of, keys), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["key", "g", "c"])

        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            total[END] += len(texts)
            for t in texts:
                total.update(tokens_of(t))
            if len(total) > 400_000:
                yield emit()
                total.clear()
        yield emit()

    return written(docs.mapInArrow(run, "key binary, g int, c long").groupBy("key", "g").agg(F.sum("c").alias("c")).filter("c > 0"), "counts")


def lexicon_of(counts: DataFrame, known: int = KNOWN) -> tuple[Lexicon, int]:
    """The lexicon, and the count from which words are known: the least one that `known` words or fewer reach."""
    tokens, types = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in counts.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["g"]], types[r["g"]] = r["n"], r["v"]
    # counts from 1000 on are binned to about a thousandth, so the histogram is small
    binned = F.when(F.col("c") < 1000, F.col("c")).otherwise((F.lit(1000) + F.floor(F.log(F.col("c") / 1000.0) / F.log(F.lit(1.001)))).cast("long"))
    histogram = sorted(counts.groupBy(binned.alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), key=lambda r: -r["b"])
    least, seen = 1 << 62, 0
    for r in histogram:
        seen += r["n"]
        if seen > known:
            break
        least = min(least, r["least"])
    rows = counts.filter(F.col("c") >= least).toArrow()
    found = sorted(zip(rows["key"].to_pylist(), rows["c"].to_pylist()), key=lambda r: (-r[1], r[0]))
    return Lexicon([bytes(k) for k, _ in found], np.array([c for _, c in found], dtype=np.int64), tokens, types), least


def code_table(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """row, doc_id, learn, codes (four bytes each), rare (the words that aren't known): every text tokenised once more, for
    all passes that follow."""
    shared = broadcast_value(texts.sparkSession, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = row_base()
        for batch in slices(batches):
            codes, place, split = coded(shared.value, batch.column("text").to_pylist())
            packed, starts = codes.astype("<i4"), np.flatnonzero(place == 0).tolist()
            rare: list[list[bytes]] = [[] for _ in split]
            unknown = np.flatnonzero(codes >= shared.value.known)
            for d, k in zip((np.searchsorted(starts, unknown, side="right") - 1).tolist(), place[unknown].tolist()):
                rare[d].append(split[d][k])
            n = len(split)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("learn"), pa.array([packed[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(packed)])], pa.binary()), pa.array(rare, pa.list_(pa.binary()))], names=["row", "doc_id", "learn", "codes", "rare"])
            row += n

    return written(texts.mapInArrow(run, "row long, doc_id long, learn boolean, codes binary, rare array<binary>"), "codes")


def observe(lexicon: Lexicon, layout: Layout, codes: np.ndarray, place: np.ndarray, total: np.ndarray) -> None:
    """Add to `total` how often each branch followed each row's feature."""
    one = np.ones(1 << 16, dtype=total.dtype)
    for lo in range(0, len(codes), 1 << 16):
        at = np.arange(lo, min(lo + (1 << 16), len(codes)))
        leaf = lexicon.leaf_of[codes[at]]
        for level, (_, rows) in enumerate(layout.of(codes, place, leaf, at)):
            branch = leaf // BRANCH**level % BRANCH
            for r in rows:
                np.add.at(total, r * BRANCH + branch, one[: len(at)])


def expect(model: Model, codes: np.ndarray, place: np.ndarray, total: np.ndarray) -> None:
    """Add to `total` how often the model expects each branch after each row's feature, at every position. Two branches are
    added at a time, as the parts of a complex number; a chunk is so small that its rows stay in the cache meanwhile."""
    rows_of = total.view(np.complex128).reshape(-1, BRANCH // 2)
    for lo in range(0, len(codes), CHUNK // 2):
        at = np.arange(lo, min(lo + CHUNK // 2, len(codes)))
        leaf = model.lexicon.leaf_of[codes[at]]
        for level, (node, rows) in enumerate(model.layout.of(codes, place, leaf, at)):
            p = model.shares(level, node, rows).astype(np.float64).view(np.complex128)
            for r in rows:
                for k in range(BRANCH // 2):
                    np.add.at(rows_of[:, k], r, p[:, k])


def train(coded_texts: DataFrame, lexicon: Lexicon) -> Model:
    """Weights from a table of training texts (codes)."""
    spark, model = coded_texts.sparkSession, Model(lexicon)
    size = model.layout.rows * BRANCH
    shared = broadcast_value(spark, lexicon)
    texts = coded_texts.coalesce(max(2 * spark.sparkContext.defaultParallelism, coded_texts.rdd.getNumPartitions() // FILES_A_TASK))

    def observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, layout = np.zeros(size, dtype=np.int32), Layout(shared.value.bits)
        for batch in slices(batches, "codes"):
            observe(shared.value, layout, *unpacked(batch), total)
        yield from _blocks(total)

    seen = _summed(texts.mapInArrow(observed, "block int, part binary"), size, "i4", "f8").reshape(-1, BRANCH)
    shared.destroy()
    prior = model.prior_rows()
    # before any step the model expects the priors wherever a feature stands
    model.step(seen, seen.sum(1, keepdims=True) * prior, RATES[0], prior)
    for rate in RATES[1:]:
        now = broadcast_value(spark, model)

        def expected(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in slices(batches, "codes"):
                expect(now.value, *unpacked(batch), total)
            yield from _blocks(total.astype(np.float32))

        got = _summed(texts.mapInArrow(expected, "block int, part binary"), size, "f4", "f4")
        now.destroy()
        model.step(seen, got.reshape(-1, BRANCH), rate, prior)
    return model


def score(docs: DataFrame, training: Column, known: int = KNOWN) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`; `training`, a condition on
    doc_id, marks the rows to learn from."""
    texts = documents(docs).withColumn("learn", F.coalesce(training, F.lit(False)))
    counts = count(texts.filter("learn").select("text"))
    lexicon, least = lexicon_of(counts, known)
    every = code_table(texts, lexicon)
    shared = broadcast_value(docs.sparkSession, train(every.filter("learn").select("codes"), lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = shared.value, ["row", "doc_id", "n_tokens", "n_known", "logs", "model_logs"]
        lexicon = model.lexicon
        for batch in slices(batches, "codes"):
            codes, place = unpacked(batch)
            starts = np.flatnonzero(place == 0)
            log_count = lexicon.log_count[codes]
            inside = np.where(lexicon.leaf_of[codes] >= OWN, log_count - lexicon.log_share[codes], 0.0)
            total = lambda x: np.add.reduceat(x.astype(np.float64), starts)
            columns = [total(np.ones(len(codes))).astype(np.int64), total(codes < lexicon.known).astype(np.int64), total(log_count), total(model.log10(codes, place) + inside)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *map(pa.array, columns)], names=names)

    parts = every.select("row", "doc_id", "codes").mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, logs double, model_logs double")
    words = every.select("row", F.explode("rare").alias("key"))
    found = words.join(counts.filter(F.col("c") < least).select("key", "c"), "key").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"))
    joined = parts.join(found, "row", "left").withColumn("more", F.coalesce("more", F.lit(0))).withColumn("more_logs", F.coalesce("more_logs", F.lit(0.0)))
    base = F.log10(F.lit(float(lexicon.tokens + lexicon.types + 1)))
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.col("more")).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model_logs") + F.col("more_logs")).alias("score"),
    )
