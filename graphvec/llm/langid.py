"""Language identification by error-correcting output codes.

Each known language has a codeword; one binary n-gram classifier for each bit tells, from hashed byte 3- and 4-grams of the
lower-cased text, the languages with a 1 there from those with a 0. An n-gram's weight for a bit is the log ratio of its mean
share among the languages of either side; a logistic curve over the text's mean weight, fitted for each bit, turns it into a
margin. The loss of a codeword is the sum of the logistic losses of its bits; the language of the smallest loss wins, and a text
whose two best losses lie close is flagged as ambiguous.

Counts come from all learning texts: each task adds up dense bincounts of a few languages at a time and Spark sums them; the
driver receives two numbers for each bit and bucket and one for each language, and the number of bits grows with the logarithm
of that of the languages. The curves are fitted on a bounded sample of about MAX_FITTED rows, chosen by hash. Scoring is one
map without a shuffle.

Defined results: a null or empty text, or one without a letter, is `und` with score 0; rows with null lang teach nothing;
with no language learned every text is `und`; with one, that one has score 1 if the text has a letter; repeated rows count
each time; other columns are ignored. Ties of codewords go to the smaller language name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, documents, few, fold, slices, written

BUCKETS = 1 << 15
#: Rows that the curves are fitted on, and how strongly they are held to the margin as it is; languages that a task counts at a time.
MAX_FITTED, RIDGE, NEWTON = 20_000, 1e-2, 25
LANGUAGES_HELD = 32
#: Separates texts so that no n-gram touches two of them.
GAP = b"\x00\x00\x00\x00"
SMOOTHING = 0.5
#: Loss per unit of the margin; margins grow with the root of the n-gram count and stop here.
SHARPNESS, MOST_MARGIN = 1.0, 12.0
AMBIGUOUS = 0.6
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    found = LETTER.search(text)
    return bool(found) and (found.group().isalpha() or any(map(str.isalpha, text)))


def code_matrix(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language: all splits in two for up to five languages, then seeded random bits, the draw
    with the most distant closest rows."""
    if languages < 2:
        return np.ones((languages, 0), dtype=np.int8)
    if languages <= 5:
        bits = 2 ** (languages - 1) - 1
        return np.array([[1 if row == 0 or (b >> (row - 1)) & 1 == 0 else -1 for b in range(1, bits + 1)] for row in range(languages)], dtype=np.int8)
    bits, best, rng = math.ceil(10 * math.log2(languages)), None, np.random.default_rng(7)
    for _ in range(50):
        code = np.where(rng.random((languages, bits)) < 0.5, 1, -1).astype(np.int8)
        code = code[:, np.abs(code.sum(0)) < languages]
        apart = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
        closest = apart[~np.eye(languages, dtype=bool)].min()
        if best is None or closest > best[0]:
            best = (closest, code)
    return best[1]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of the 3- and 4-grams that begin at each byte of the texts (two rows), and the texts' sizes in bytes.
    At the end of a text n-grams hold zeros, never the next one's bytes."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    b = np.frombuffer(GAP.join(parts) + GAP, dtype=np.uint8).astype(np.uint32)
    three = b[:-3] * np.uint32(0x9E3779B1) + b[1:-2] * np.uint32(0x85EBCA77) + b[2:-1] * np.uint32(0xC2B2AE3D)
    four = three * np.uint32(0x27D4EB2F) + b[3:] * np.uint32(0x165667B1)
    out = np.stack([three, four])
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    inside = np.arange(int(sizes.sum())) + len(GAP) * np.repeat(np.arange(len(parts)), sizes)
    return out[:, inside] >> np.uint32(32 - 15), sizes


def curve(margin: np.ndarray, one: np.ndarray) -> tuple[float, float]:
    """Scale and offset of the logistic curve that tells rows with a 1 from those with a 0, by Newton's steps, each halved until
    the loss falls; with little evidence it stays near the margin as it is."""
    beta, start = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    x, sign = np.stack([margin, np.ones(len(margin))], 1), np.where(one > 0, 1.0, -1.0)

    def loss(beta: np.ndarray) -> float:
        return float(np.logaddexp(0, -sign * (x @ beta)).mean() + RIDGE / 2 * ((beta - start) ** 2).sum())

    now = loss(beta) if len(margin) else 0.0
    for _ in range(NEWTON if len(margin) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - one) / len(x) + RIDGE * (beta - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + RIDGE * np.eye(2), slope)
        while np.abs(step).max() >= 1e-9 and loss(beta - step) >= now:
            step = step / 2
        if np.abs(step).max() < 1e-9:
            break
        beta = beta - step
        now = loss(beta)
    return max(float(beta[0]), 1e-3), float(beta[1])


class Model:
    """Languages, their codewords and, for each bit's classifier, the n-grams' weights and the curve."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.code = languages, code_matrix(len(languages)).astype(np.float64)
        self.weights = weights.astype(np.float32)
        self.scale, self.offset = np.ones(self.code.shape[1]), np.zeros(self.code.shape[1])

    def margins(self, texts: list[str]) -> np.ndarray:
        """For each text and bit the mean weight of its n-grams, times the root of their number."""
        buckets, sizes = grams(texts)
        total = np.zeros((len(texts), self.weights.shape[1]))
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        for row in buckets:
            if len(some):
                total[some] += np.add.reduceat(self.weights[row], starts, axis=0, dtype=np.float64)
        return np.clip(total / np.sqrt(2.0 * np.maximum(1, sizes))[:, None], -MOST_MARGIN, MOST_MARGIN)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if len(self.languages) == 1:
            sure = [has_letter(t) for t in texts]
            return [self.languages[0] if s else "und" for s in sure], [float(s) for s in sure], [not s for s in sure]
        m = self.margins(texts) * self.scale + self.offset
        # loss[d, l] = sum over bits of log(1 + exp(-margin * bit))
        loss = np.logaddexp(0, -SHARPNESS * m[:, None, :] * self.code[None, :, :]).sum(2)
        weight = np.exp(loss.min(1, keepdims=True) - loss)
        score = weight.max(1) / weight.sum(1)
        best = loss.argmin(1)
        sure = [has_letter(t) for t in texts]
        return (
            [self.languages[i] if s else "und" for i, s in zip(best.tolist(), sure)],
            [float(x) if s else 0.0 for x, s in zip(score.tolist(), sure)],
            [not s or x < AMBIGUOUS for x, s in zip(score.tolist(), sure)],
        )


def count(known: DataFrame, place: dict[str, int]) -> DataFrame:
    """i, bucket, n: the n-grams of each language's texts. place: the languages' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def emit():
            i = np.repeat(list(total), [np.count_nonzero(x) for x in total.values()]).astype(np.int32)
            bucket = np.concatenate([np.flatnonzero(x) for x in total.values()]) if total else np.zeros(0)
            n = np.concatenate([x[x > 0] for x in total.values()]) if total else np.zeros(0)
            return pa.RecordBatch.from_arrays([pa.array(i), pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], names=["i", "bucket", "n"])

        for batch in slices(batches, limit=1 << 20):
            which = np.array([place[l] for l in batch.column("lang").to_pylist()])
            texts = batch.column("text").to_pylist()
            for i in np.unique(which).tolist():
                buckets, _ = grams([texts[k] for k in np.flatnonzero(which == i)])
                if i not in total:
                    if len(total) >= LANGUAGES_HELD:
                        yield emit()
                        total.clear()
                    total[i] = np.zeros(BUCKETS, dtype=np.int64)
                total[i] += np.bincount(buckets.ravel(), minlength=BUCKETS)
        yield emit()

    return written(known.mapInArrow(run, "i int, bucket int, n long").groupBy("i", "bucket").agg(F.sum("n").alias("n")), "grams")


def learn(docs: DataFrame) -> Model:
    """A model from all rows of `docs` (doc_id, text, lang) with a lang."""
    spark = docs.sparkSession
    known = docs.filter(F.col("lang").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = sorted(r["lang"] for r in sizes)
    model = Model(languages, np.zeros((BUCKETS, code_matrix(len(languages)).shape[1])))
    bits = model.code.shape[1]
    if not bits:
        return model
    place = {l: i for i, l in enumerate(languages)}
    counts = count(known, place)
    total = np.zeros(len(languages))
    for r in counts.groupBy("i").agg(F.sum("n").alias("n")).collect():
        total[r["i"]] = r["n"]
    whole = total + SMOOTHING * BUCKETS
    sides = spark.createDataFrame([(i, b, bool(model.code[i, b] > 0), float(1 / whole[i])) for i in range(len(languages)) for b in range(bits)], "i int, bit int, one boolean, share double")
    mine = F.col("n") * F.col("share")
    found = counts.join(few(sides), "i").groupBy("bit", "bucket").agg(F.sum(F.when(F.col("one"), mine).otherwise(0.0)).alias("one"), F.sum(F.when(F.col("one"), 0.0).otherwise(mine)).alias("other")).toArrow()
    bit, bucket = found["bit"].to_numpy(), found["bucket"].to_numpy()
    sums = np.zeros((2, BUCKETS, bits))
    sums[0, bucket, bit], sums[1, bucket, bit] = found["one"].to_numpy(), found["other"].to_numpy()
    for side, sign in zip(sums, (1, -1)):
        own = model.code * sign > 0
        # the mean over the side's languages of smoothed shares
        side += (SMOOTHING / whole) @ own
        side /= own.sum(0)
    model.weights = np.log(sums[0] / sums[1]).astype(np.float32)
    _fit(model, known, place, sum(r["n"] for r in sizes))
    return model


def _fit(model: Model, known: DataFrame, place: dict[str, int], rows: int) -> None:
    """The curves, from the margins of a bounded sample of rows."""
    shared = broadcast_value(known.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            m = shared.value.margins(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([place[l] for l in batch.column("lang").to_pylist()], pa.int32()), pa.array([x.tobytes() for x in m], pa.binary())], names=["i", "m"])

    mixed = F.pmod(F.xxhash64("doc_id", F.lit("fitted")), F.lit(1 << 20))
    sample = known.filter(mixed < min(1.0, MAX_FITTED / max(1, rows)) * (1 << 20)).mapInArrow(run, "i int, m binary").toArrow()
    shared.destroy()
    i, bits = sample["i"].to_numpy(), model.code.shape[1]
    m = np.frombuffer(b"".join(sample["m"].to_pylist())).reshape(-1, bits)
    order = np.lexsort((*m.T, i))  # the same sums whatever the order of rows
    for b in range(bits):
        model.scale[b], model.offset[b] = curve(m[order, b], (model.code[i[order], b] > 0).astype(float))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row of `docs`."""
    shared = broadcast_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            lang, score, ambiguous = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def learning_rows(docs: DataFrame) -> DataFrame:
    """The contract's learning fold: remainder by 4 not 2."""
    return docs.filter(fold("doc_id", 4) != 2)
