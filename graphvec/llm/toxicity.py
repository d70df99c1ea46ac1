"""Toxicity by class-conditional interpolated Kneser-Ney models of pairs of words.

For the toxic and the ordinary class a Kneser-Ney model counts, for each pair of words, the distinct words before it, and for
each word the distinct words it follows (so copies of a text add nothing). Counts are discounted. P(word | history, class) is
the discounted share of the pair among those of its history, plus the mass that this history's discounts set free times
P(word | class), which in turn gives its free mass to one backoff distribution that both classes share: a rare expression
falls back to the same value in both and tells little. Only pairs with a count left after the discount in either class are
in a table, and only histories of such pairs: for all others the rule gives log P(word | toxic) - log P(word | ordinary)
exactly. A span's evidence is its length-normalised log-likelihood ratio, the mean over its words. Evidence of a text: the
greatest of its one-word spans, of its spans of SPAN words, and that of the whole text, by P(word | class) and by
P(word | history, class): the toxic class is the smaller one, so its histories free more mass, which blurs what single words
tell. A logistic curve turns these six into a score; it is fitted on training texts, each half scored by the counts of the
other half.

Learning uses a bounded, documented sample: at most about MAX_LABELLED labelled rows, chosen by hash; the broadcast table
holds the words with a count left after the discount (all others have the ratio of an unseen word). Scoring is one map without a shuffle.

Defined results: null text counts as empty; a text without words has the evidence 0 and so a score as well; rows with null
label teach nothing; a doc_id that is labelled twice is toxic if either says so; without both classes every score is 0;
extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, discard, documents, fold, slices, tidied, written

MAX_LABELLED = 20_000
DISCOUNT = 1.5
SPAN = 8
REJECT = 0.7
#: Triples that a worker turns into an Arrow batch at a time.
EMITTED = 10_000
CLEAR = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
#: Mean logistic loss is minimised with this ridge; steps of Newton's method.
RIDGE, NEWTON = 1e-3, 30


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(CLEAR).split()


def _shares(toxic: np.ndarray, plain: np.ndarray, shared: np.ndarray, total: tuple[float, float], free: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """P(w | toxic) and P(w | ordinary) for each word. total: contexts in each class; free: the mass that the discount sets free."""
    return tuple(np.maximum(c - DISCOUNT, 0) / t + f * shared for c, t, f in ((toxic, total[0], free[0]), (plain, total[1], free[1])))


class Ratios:
    """log P(w | h, toxic) - log P(w | h, ordinary). ids: places of the words in `word` (of the lowest order) and `back` (of
    the masses that their pairs set free), whose last place stands for unseen words; codes: history * len(word) + word of
    the pairs in `pair`, in order."""

    def __init__(self, ids: dict[bytes, int], word: np.ndarray, back: np.ndarray, codes: np.ndarray, pair: np.ndarray):
        order = np.argsort(codes)
        # a code that no pair has stands first, so that there always is one
        self.ids, self.word, self.back, self.codes, self.pair = ids, word, back, np.append(-1, codes[order]), np.append(0.0, pair[order])

    def of(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word, by the lowest order and by pairs."""
        unseen, get = len(self.word) - 1, self.ids.get
        at = np.fromiter([get(w, unseen) for w in ws], np.int64, len(ws))
        before = np.append(unseen, at[:-1])[: len(at)]  # a text's first word has no pair
        alone, code = self.word[at], before * len(self.word) + at
        place = np.searchsorted(self.codes, code, side="right") - 1
        return alone, np.where(self.codes[place] == code, self.pair[place], alone + self.back[before])

    def evidence(self, text: str) -> tuple[float, ...]:
        alone, paired = self.of(words(text))
        return (*evidence(alone), *evidence(paired))


def evidence(llr: np.ndarray) -> tuple[float, float, float]:
    """Greatest mean of one word, of SPAN words, and the mean of all."""
    if not len(llr):
        return 0.0, 0.0, 0.0
    mean = float(llr.mean())
    if len(llr) <= SPAN:
        return float(llr.max()), mean, mean
    sums = np.concatenate([[0.0], np.cumsum(llr)])
    return float(llr.max()), float((sums[SPAN:] - sums[:-SPAN]).max() / SPAN), mean


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression, classes weighted alike, on standardised columns; returns weights for raw columns and a constant."""
    mu, sd = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([(x - mu) / sd, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    beta = np.zeros(z.shape[1])
    for _ in range(NEWTON):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weight * (p - y)) + RIDGE * beta
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    w = beta[:-1] / sd
    return np.append(w, beta[-1] - mu @ w)


class _Known(dict):
    """Values by word; a word without one has the unseen word's."""

    def __init__(self, values, unseen: float):
        super().__init__(values)
        self.unseen = unseen

    def __missing__(self, word: bytes) -> float:
        return self.unseen


class Model:
    def __init__(self, ratios: Ratios | None, curve: np.ndarray | None):
        self.ratios, self.curve = ratios, curve

    @property
    def ratio(self) -> dict[bytes, float]:
        """Ratios of the lowest order by word."""
        return _Known(((w, float(self.ratios.word[k])) for w, k in self.ratios.ids.items()), float(self.ratios.word[-1]))

    def scores(self, texts: list[str]) -> list[float]:
        if self.curve is None:
            return [0.0] * len(texts)
        x = np.array([self.ratios.evidence(t) for t in texts]).reshape(-1, 6)
        return (1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))).tolist()


def _sample(labels: DataFrame) -> DataFrame:
    """doc_id, toxic, half of about MAX_LABELLED rows at most, chosen by hash: all of them if there are fewer."""
    found = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    share = min(1.0, MAX_LABELLED / max(1, found.count()))
    mixed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    return found.filter(mixed < share * (1 << 20)).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct triples of words of each class, with the halves that hold them; a triple may come again."""
    seen: tuple[dict[bytes, int], dict[bytes, int]] = {}, {}  # by class

    def emit():
        for y, found in enumerate(seen):
            items = iter(found.items())
            while part := list(islice(items, EMITTED)):
                words_ = [pa.array(x, pa.binary()) for x in zip(*(triple.split(b" ") for triple, _ in part))]
                yield pa.RecordBatch.from_arrays([*words_, pa.array([y] * len(part), pa.int32()), pa.array([h for _, h in part], pa.int32())], names=["before", "history", "word", "toxic", "halves"])
            found.clear()

    for batch in slices(batches):
        for t, y, h in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half"))):
            ws, found = words(t), seen[y]
            for triple in set(map(b" ".join, zip([b"", b"", *ws], [b"", *ws], ws))):
                found[triple] = found.get(triple, 0) | (1 << h)
        if sum(map(len, seen)) > 300_000:
            yield from emit()
    yield from emit()


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows of `labels` (doc_id, toxic) and their texts in `docs`."""
    # the sample's size is bounded, so its rows may be broadcast: texts stay where they are read
    texts = documents(docs).join(F.broadcast(_sample(labels)), "doc_id")

    types = texts.mapInArrow(tidied(_triples), "before binary, history binary, word binary, toxic int, halves int").groupBy("toxic", "history", "word", "before").agg(F.bit_or("halves").alias("halves"))
    kinds = [f"{y}{m}" for y in (0, 1) for m in (1, 2, 3)]
    left = lambda c: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))
    by_pair = written(types.groupBy("history", "word").agg(*[F.sum(F.when((F.col("toxic") == int(k[0])) & (F.col("halves").bitwiseAND(int(k[1])) > 0), 1).otherwise(0)).alias(f"c{k}") for k in kinds]), "pairs")
    by_word = by_pair.groupBy("word").agg(*[F.sum((F.col(f"c{k}") > 0).cast("long")).alias(f"n{k}") for k in kinds])
    by_word.persist()
    sums = by_word.agg(F.count("*").alias("v"), *[F.sum(c).alias(c) for c in by_word.columns if c != "word"], *[F.sum(left(c)).alias(f"kept_{c}") for c in by_word.columns if c != "word"]).first()
    # the sample's size bounds these; a word whose counts are all discounted has the unseen word's ratio; a half has no count left where both together have none
    kept = by_word.filter(F.greatest("n03", "n13") > DISCOUNT).toArrow()
    several = by_pair.filter(F.greatest("c03", "c13") > DISCOUNT)
    followers = by_word.join(several.select("word").distinct(), "word").toArrow()
    pairs = several.toArrow()
    histories = by_pair.groupBy("history").agg(*[F.sum(f"c{k}").alias(f"t{k}") for k in kinds], *[F.sum(left(f"c{k}")).alias(f"kept_{k}") for k in kinds]).filter("kept_03 + kept_13 > 0").toArrow()
    by_word.unpersist()
    discard(by_pair)
    if not sums["v"] or not sums["n03"] or not sums["n13"]:
        return Model(None, None)
    ids: dict[bytes, int] = {w: k for k, w in enumerate(kept["word"].to_pylist())}
    history, follower, opened = ([ids.setdefault(w, len(ids)) for w in column.to_pylist()] for column in (pairs["history"], pairs["word"], histories["history"]))
    place = {w: k for k, w in enumerate(followers["word"].to_pylist())}
    low = np.array([place[w] for w in pairs["word"].to_pylist()], dtype=np.int64)
    history, follower, opened = (np.array(x, dtype=np.int64) for x in (history, follower, opened))

    def ratio(m: int) -> Ratios:
        total = (max(1.0, float(sums[f"n1{m}"])), max(1.0, float(sums[f"n0{m}"])))
        free = [max(1e-9, 1 - float(sums[f"kept_n{y}{m}"]) / t) for y, t in zip((1, 0), total)]

        def lowest(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            plain, toxic = table[f"n0{m}"].to_numpy().astype(float), table[f"n1{m}"].to_numpy().astype(float)
            return _shares(toxic, plain, (plain + toxic + 0.5) / (total[0] + total[1] + 0.5 * (sums["v"] + 1)), total, free)

        word, (p, q) = np.full(len(ids) + 1, np.log(free[0] / free[1])), lowest(kept)
        word[: len(p)] = np.log(p / q)
        back, pair = np.zeros(len(word)), np.zeros(len(pairs))
        for y, share, sign in zip((1, 0), (s[low] for s in lowest(followers)), (1, -1)):
            t, size = np.ones(len(word)), np.zeros(len(word))
            t[opened] = np.maximum(1, histories[f"t{y}{m}"].to_numpy())
            size[opened] = histories[f"kept_{y}{m}"].to_numpy()
            mass = 1 - size / t
            back += sign * np.log(mass)
            pair += sign * np.log(np.maximum(pairs[f"c{y}{m}"].to_numpy() - DISCOUNT, 0) / t[history] + mass[history] * share)
        return Ratios(ids, word, back, history * len(word) + follower, pair)

    whole, crossed = ratio(3), {0: ratio(2), 1: ratio(1)}  # half 0 is scored by the counts of half 1 (bit 2)
    shared = broadcast_value(docs.sparkSession, crossed)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist()):
                rows.append(shared.value[h].evidence(t))
            x = np.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("toxic").to_pylist(), pa.int32()), *[pa.array(x[:, i]) for i in range(6)]], names=["y", *"abcdef"])

    found = texts.mapInArrow(tidied(measure, shared), "y int, a double, b double, c double, d double, e double, f double").toArrow()
    shared.destroy()
    x, y = np.stack([found[c].to_numpy() for c in "abcdef"], 1), found["y"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return Model(whole, _curve(x[order], y[order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of `docs`."""
    shared = broadcast_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(tidied(run, shared), "doc_id long, score double")


def learning_labels(labels: DataFrame) -> DataFrame:
    """The contract's learning fold: remainder by 3 not 1."""
    return labels.filter(fold("doc_id", 3) != 1)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of `docs`, all columns, whose text scores below REJECT. The texts are scored where they lie."""
    shared = broadcast_value(docs.sparkSession, model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = shared.value.scores([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([s < REJECT for s in scores], pa.bool_()))

    return docs.select(columns).mapInArrow(tidied(run, shared), docs.schema)
