"""Language model, toxicity, language identification and neighbours."""

import math
import random
import sys
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphvec.llm import ann, langid, maxent, toxicity
from graphvec.llm.common import documents, fold


def crc(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def tokens(t):
    return (t or "").encode().lower().split() + [b"\n"]


def test_language_model_base(docs, awkward):
    rng = random.Random(0)
    texts = awkward + [" ".join(rng.choice(["the", "a", "cat", "dog", "Runs", "fast", "q" * 30]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    out = {r["doc_id"]: r for r in maxent.score(docs(texts), fold("doc_id", 7) != 2).collect()}
    counts = Counter(w for i, t in enumerate(texts) if crc(i, 7) != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        w = tokens(t)
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(w), sum(x in counts for x in w), n)
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel=1e-9, abs=1e-9)
        assert out[i]["score"] <= 1e-9
    fresh = [i for i in range(len(awkward), len(texts)) if crc(i, 7) == 2]
    assert sum(out[i]["score"] for i in fresh) > sum(out[i]["base_score"] for i in fresh)
    assert maxent.score(docs([]), fold("doc_id", 7) != 2).count() == 0
    untrained = maxent.score(docs(["a b"]), F.lit(False)).first()
    assert untrained["train_tokens"] == 0 and untrained["n_known"] == 0 and untrained["base_score"] == 0


def test_language_model_joins_rare_words(docs):
    """With few known words the others are counted by the join: same numbers."""
    texts = [" ".join(f"w{(i * k) % 40}" for k in range(1, 30)) for i in range(40)]
    wanted = {r["doc_id"]: (r["n_known"], r["base_score"]) for r in maxent.score(docs(texts), fold("doc_id", 7) != 2).collect()}
    got = {r["doc_id"]: (r["n_known"], r["base_score"]) for r in maxent.score(docs(texts), fold("doc_id", 7) != 2, known=5).collect()}
    for i, (n, s) in wanted.items():
        assert got[i][0] == n and got[i][1] == pytest.approx(s)


def a_lexicon(words=300):
    names = [f"w{i}".encode() for i in range(words)]
    counts, groups = np.arange(words, 0, -1), [maxent.group_of(w) for w in names]
    return names, counts, maxent.Lexicon(names, counts, np.bincount(groups, weights=counts, minlength=maxent.GROUPS), np.bincount(groups, minlength=maxent.GROUPS))


def test_language_model_is_a_distribution(monkeypatch):
    """Over all words and the unseen ones, the shares of any history sum to 1, with leaves of their own or shared."""
    monkeypatch.setattr(maxent, "KNOWN", 300)
    for own in (2048, 40):
        monkeypatch.setattr(maxent, "OWN", own)
        monkeypatch.setattr(maxent, "GROUPS", maxent.LEAVES - own)
        names, counts, lexicon = a_lexicon()
        model = maxent.Model(lexicon)
        model.weights += np.random.default_rng(0).normal(size=model.weights.shape).astype(np.float32)

        def share(code, count):
            logs = model.log10(np.array([5, 17, code]), np.arange(3))[2]
            return 10 ** (logs + (math.log10(count + 1) - lexicon.log_share[code] if lexicon.leaf_of[code] >= own else 0))

        # each group has its unseen words' share as well
        unseen = sum(share(lexicon.known + g, 0) for g in range(maxent.GROUPS))
        alone = 0.0
        for leaf in range(lexicon.own, own):  # leaves that no word has
            lexicon.leaf_of[299] = leaf
            alone += 10 ** model.log10(np.array([5, 17, 299]), np.arange(3))[2]
        lexicon.leaf_of[299] = 299 if own > 299 else own + maxent.group_of(names[299])
        assert sum(share(c, int(counts[c])) for c in range(300)) + unseen + alone == pytest.approx(1, abs=1e-4)


def test_language_model_grows():
    """Four times the tokens: twice the rows of weights."""
    zeros = np.zeros(maxent.GROUPS)

    def rows(tokens):
        t = zeros.copy()
        t[0] = tokens
        return maxent.Layout(maxent.Lexicon([], zeros[:0], t, zeros).bits).rows

    sizes = [rows((1 << 22) * 4**k) for k in range(4)]
    assert [b / a for a, b in zip(sizes, sizes[1:])] == [2, 2, 2]


def test_language_model_expects_every_position(docs):
    """Weights are those of steps whose expectations take all positions, in texts of a few tokens too, position by position."""
    texts = [f"w{i % 7} w{i * 3 % 5} w{i % 3}" for i in range(60)]
    table = documents(docs(texts)).withColumn("learn", F.lit(True))
    lexicon, _ = maxent.lexicon_of(maxent.count(table.select("text")))
    model = maxent.train(maxent.code_table(table, lexicon).select("codes"), lexicon)
    codes, place, _ = maxent.coded(lexicon, texts)
    wanted = maxent.Model(lexicon)
    leaves, prior = lexicon.leaf_of[codes], wanted.prior_rows().astype(float)
    levels = wanted.layout.of(codes, place, leaves, np.arange(len(codes)))
    for k, rate in enumerate(maxent.RATES):
        seen, expected = np.zeros(wanted.weights.shape), np.zeros(wanted.weights.shape)
        for level, (node, rows) in enumerate(levels):
            for i in range(len(codes)):
                x = np.log(lexicon.priors[level][node[i]]) + sum(wanted.weights[r[i]].astype(float) for r in rows)
                p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
                for r in rows:
                    seen[r[i], leaves[i] // maxent.BRANCH**level % maxent.BRANCH] += 1
                    expected[r[i]] += p if k else lexicon.priors[level][node[i]]
        gradient = (seen - expected) / (expected + maxent.PRIOR * prior + 1e-9)
        wanted.weights += (rate * np.log1p(np.maximum(gradient, -0.98))).astype(np.float32)
    assert np.abs(model.weights - wanted.weights).max() < 0.01


def test_language_model_uses_context(docs):
    """Words that follow each other: held-out texts are likelier than by their counts alone, rare words too."""
    rng = random.Random(6)
    after = {f"w{i}": [f"w{rng.randrange(3000)}" for _ in range(2)] for i in range(3000)}

    def text():
        w = [f"w{rng.randrange(3000)}"]
        while len(w) < 60:
            w.append(rng.choice(after[w[-1]]))
        return " ".join(w)

    out = maxent.score(docs([text() for _ in range(700)]), fold("doc_id", 7) != 2)
    held = out.filter(fold("doc_id", 7) == 2).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] > held[1] + 0.1 * held[2]


def test_toxicity(docs, spark, awkward):
    rng = random.Random(1)
    plain, rude = [f"word{i}" for i in range(150)], ["nasty", "awful", "vile"]

    def text(toxic):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(rude)
        return " ".join(w)

    marks = [int(i % 4 == 0) for i in range(300)]
    texts = [text(m) for m in marks]
    table = docs(texts + awkward)
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(5000, 1, 1), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(table, toxicity.learning_labels(labels))
    out = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    held = [i for i in range(300) if crc(i, 3) == 1]
    assert np.mean([(out[i] >= toxicity.REJECT) == bool(marks[i]) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in out.values()) and len(out) == len(texts) + len(awkward)
    kept = toxicity.keep_clean(table, model)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, s in out.items() if s < toxicity.REJECT}
    assert kept.columns == table.columns
    nothing = toxicity.learn(table, labels.limit(0))
    assert {r["score"] for r in toxicity.score(table, nothing).collect()} == {0.0}
    assert toxicity.score(docs([]), model).count() == 0


def test_copies_add_no_evidence(docs, spark):
    """A text repeated in the toxic class makes its words no more toxic: contexts are counted once."""
    table = docs([(i, "quiet words of a text that was copied") for i in range(30)] + [(100 + i, f"calm talk number {i} about things") for i in range(40)] + [(200 + i, f"you vile thing {i} go vile away {i}") for i in range(20)])
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(40)] + [(200 + i, 1) for i in range(20)], "doc_id long, toxic int")
    model = toxicity.learn(table, labels)
    assert model.ratio[b"vile"] > model.ratio[b"copied"]


def test_toxicity_tells_word_order(docs, spark):
    """An expression of words that are ordinary one by one: the same words in another order are not rejected."""
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(60)]

    def text(toxic):
        w = [rng.choice(plain) for _ in range(40)]
        for at in (3, 13, 23, 33):
            w[at : at + 2] = ["stone", "head"] if toxic else ["head", "stone"]
        return " ".join(w)

    marks = [int(i % 3 == 0) for i in range(300)]
    table = docs([text(m) for m in marks])
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    out = {r["doc_id"]: r["score"] for r in toxicity.score(table, toxicity.learn(table, toxicity.learning_labels(labels))).collect()}
    held = [i for i in range(300) if crc(i, 3) == 1]
    assert np.mean([(out[i] >= toxicity.REJECT) == bool(marks[i]) for i in held]) > 0.95


def test_toxicity_pairs_against_brute_force(docs, spark):
    rng = random.Random(5)
    marks = [i % 2 for i in range(40)]
    texts = [" ".join(rng.choice("abcdefgh"[m : m + 7]) for _ in range(25)) for m in marks]
    model = toxicity.learn(docs(texts), spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int"))
    triples = {(m, *x) for t, m in zip(texts, marks) for w in [toxicity.words(t)] for x in zip([b"", b"", *w], [b"", *w], w)}
    pairs = Counter((m, h, w) for m, _, h, w in triples)
    follows = Counter((m, w) for m, _, w in pairs)
    vocabulary, d = {w for _, w in follows}, toxicity.DISCOUNT
    total = [sum(n for (y, _), n in follows.items() if y == m) for m in (0, 1)]

    def alone(w, m):
        free = sum(min(n, d) for (y, _), n in follows.items() if y == m) / total[m]
        return max(follows[m, w] - d, 0) / total[m] + free * (follows[0, w] + follows[1, w] + 0.5) / (sum(total) + 0.5 * (len(vocabulary) + 1))

    def paired(h, w, m):
        own = {k[2]: n for k, n in pairs.items() if k[:2] == (m, h)}
        if not own:
            return alone(w, m)
        return (max(own.get(w, 0) - d, 0) + sum(min(n, d) for n in own.values()) * alone(w, m)) / sum(own.values())

    for t in [*texts[:6], "a zzz b", "zzz a a", "h g f e d c b a"]:
        ws = toxicity.words(t)
        by_word, by_pair = model.ratios.of(ws)
        assert by_word == pytest.approx([math.log(alone(w, 1) / alone(w, 0)) for w in ws])
        assert by_pair == pytest.approx([math.log(paired(h, w, 1) / paired(h, w, 0)) for h, w in zip([b"", *ws], ws)])


def test_toxicity_table_leaves_out_unseen_ratios_only(docs, spark):
    texts = [f"once{i} twice{i // 2} often{i % 3} rare{i}x" for i in range(30)]
    model = toxicity.learn(docs(texts), spark.createDataFrame([(i, int(i < 16)) for i in range(30)], "doc_id long, toxic int"))
    follows = {(int(i < 16), h, w) for i, t in enumerate(texts) for ws in [toxicity.words(t)] for h, w in zip([b"", *ws], ws)}
    contexts = Counter((m, w) for m, _, w in follows)
    several = {w for (_, w), n in contexts.items() if n > toxicity.DISCOUNT}
    assert several and several <= set(model.ratio)
    # a word beyond these is there for a pair, and has the ratio of an unseen word
    assert b"rare3x" not in model.ratio and model.ratio[b"rare3x"] == model.ratio[b"never seen"]
    assert all(model.ratio[w] == model.ratio[b"never seen"] for w in set(model.ratio) - several)


def test_toxicity_triples_are_those_of_the_texts_and_leave_in_small_batches():
    """A worker's share of the triples goes to Arrow piece by piece, so it holds them once only."""
    rng = random.Random(5)
    rows = [(" ".join(f"word{rng.randrange(1 << 40):x}" for _ in range(60)) + " the cat the cat", rng.randrange(2), rng.randrange(2)) for _ in range(3_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32()))], names=["text", "toxic", "half"])
    expected, found, most = {}, {}, 0
    tracemalloc.start()
    for out in toxicity._triples(iter([batch])):
        most = max(most, tracemalloc.get_traced_memory()[1])
        assert out.num_rows <= 10_000
        tracemalloc.stop()
        for before, history, word, y, h in zip(*(out.column(c).to_pylist() for c in ("before", "history", "word", "toxic", "halves"))):
            found[before, history, word, y] = found.get((before, history, word, y), 0) | h
        tracemalloc.start()
    tracemalloc.stop()
    for t, y, h in rows:
        ws = [b"", b"", *toxicity.words(t)]
        for triple in zip(ws, ws[1:], ws[2:]):
            expected[*triple, y] = expected.get((*triple, y), 0) | 1 << h
    assert found == expected
    assert most < 50 << 20


def test_language_identification(docs, awkward):
    rng = random.Random(2)
    syllables = {"en": ["the", "ing", "and", "her"], "de": ["sch", "ung", "ein", "ich"], "fr": ["eau", "ais", "que", "ère"], "es": ["ción", "que", "los", "ñar"]}

    def text(l):
        return " ".join("".join(rng.choice(syllables[l]) for _ in range(rng.randrange(1, 4))) for _ in range(30))

    langs = [rng.choice(list(syllables)) for _ in range(200)]
    table = docs([text(l) for l in langs] + awkward, langs + [None] * len(awkward))
    model = langid.learn(langid.learning_rows(table))
    assert model.languages == sorted(syllables) and model.code.shape == (4, 7)
    out = {r["doc_id"]: r for r in langid.identify(table, model).collect()}
    held = [i for i in range(200) if crc(i, 4) == 2]
    assert np.mean([out[i]["lang_pred"] == langs[i] for i in held]) > 0.95
    assert [out[200 + i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and out[206]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    # the same whatever the neighbours in a batch
    one = langid.identify(docs([(7, table.filter("doc_id = 7").first()["text"])]), model).first()
    assert one["score"] == pytest.approx(out[7]["score"])
    assert langid.identify(docs(["abc"]), langid.learn(table.limit(0))).first()["lang_pred"] == "und"
    alone = langid.identify(docs(["abc", "12"]), langid.learn(table.filter("lang = 'en'")))
    assert sorted((r["lang_pred"], r["score"]) for r in alone.collect()) == [("en", 1.0), ("und", 0.0)]


def test_language_weights_against_brute_force(docs):
    """Weights, curves and losses of a small corpus, counted n-gram by n-gram."""
    rng = random.Random(7)
    langs = [rng.choice(["aa", "bb", "cc"]) for _ in range(60)]
    texts = [" ".join("".join(rng.choice({"aa": "abcx", "bb": "bcdx", "cc": "cdex"}[l]) for _ in range(4)) for _ in range(8)) for l in langs]
    model = langid.learn(docs(texts, langs))

    def buckets(t):
        return langid.grams([t])[0].ravel().tolist()

    counts = {l: Counter(b for t, x in zip(texts, langs) if x == l for b in buckets(t)) for l in model.languages}
    share = np.array([[(counts[l][b] + langid.SMOOTHING) / (sum(counts[l].values()) + langid.SMOOTHING * langid.BUCKETS) for b in range(langid.BUCKETS)] for l in model.languages])
    for b in range(model.code.shape[1]):
        one = model.code[:, b] > 0
        assert np.allclose(model.weights[:, b], np.log(share[one].mean(0) / share[~one].mean(0)), atol=1e-5)

    def margin(t, b):
        w = [float(model.weights[g, b]) for g in buckets(t)]
        real = 2 * len(t.encode())
        return min(max(sum(w) / math.sqrt(real), -langid.MOST_MARGIN), langid.MOST_MARGIN)

    for b in range(model.code.shape[1]):
        m, y = np.array([margin(t, b) for t in texts]), np.array([model.code[model.languages.index(l), b] > 0 for l in langs])
        loss = lambda a, c: np.logaddexp(0, -(a * m + c) * np.where(y, 1, -1)).mean() + langid.RIDGE / 2 * ((a - 1) ** 2 + c**2)
        best = loss(model.scale[b], model.offset[b])
        assert all(best <= loss(model.scale[b] + da, model.offset[b] + dc) + 1e-9 for da in (-0.05, 0, 0.05) for dc in (-0.05, 0, 0.05))
    for r in langid.identify(docs(texts), model).collect():
        t = texts[r["doc_id"]]
        losses = [sum(math.log1p(math.exp(-(model.scale[b] * margin(t, b) + model.offset[b]) * model.code[i, b])) for b in range(model.code.shape[1])) for i in range(3)]
        assert r["lang_pred"] == model.languages[int(np.argmin(losses))]
        assert r["score"] == pytest.approx(1 / sum(math.exp(min(losses) - x) for x in losses), rel=1e-3)


def test_curve_settles_on_outliers():
    """Sure margins, some of them wrong: the steps neither overshoot nor end before the least loss."""
    rng = np.random.default_rng(5)
    for wrong in (0.0, 0.01, 0.1, 0.3):
        one = (rng.random(4000) < 0.5).astype(float)
        margin = np.clip((2 * one - 1) * rng.normal(9, 3, 4000), -12, 12) * np.where(rng.random(4000) < wrong, -1, 1)
        loss = lambda a, c: np.logaddexp(0, -(a * margin + c) * (2 * one - 1)).mean() + langid.RIDGE / 2 * ((a - 1) ** 2 + c**2)
        a, c = langid.curve(margin, one)
        assert a > 0.01 and all(loss(a, c) <= loss(a + x, c + y) + 1e-9 for x in (-0.01, 0, 0.01) for y in (-0.01, 0, 0.01))


def test_many_languages(docs, monkeypatch):
    """Seventy languages, more than a task holds at a time."""
    monkeypatch.setattr(langid, "LANGUAGES_HELD", 8)
    rng = random.Random(70)
    names = [f"l{i:02}" for i in range(70)]
    alphabets = {l: [chr(0x61 + rng.randrange(26)) + chr(0x61 + rng.randrange(26)) + chr(0x61 + rng.randrange(26)) for _ in range(6)] for l in names}
    langs = names * 6
    table = docs([" ".join(rng.choice(alphabets[l]) for _ in range(30)) for l in langs], langs)
    model = langid.learn(langid.learning_rows(table))
    assert model.languages == names
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table, model).collect()}
    held = [i for i in range(len(langs)) if crc(i, 4) == 2]
    assert np.mean([out[i] == langs[i] for i in held]) > 0.9


@pytest.mark.parametrize("languages", [2, 3, 5, 6, 20, 70])
def test_codewords_differ(languages):
    code = langid.code_matrix(languages)
    assert len({tuple(r) for r in code.tolist()}) == languages and (np.abs(code.sum(0)) < languages).all()


def brute_neighbours(ids, x, q, k):
    s = x @ x[q]
    order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))[:k]
    return [ids[i] for i in order]


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x[100:140] = x[100]  # equal vectors
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(3000)]
    rows += [(9001, None, 0), (9002, [0.0] * 32, 0), (9003, [float("nan")] * 32, 0), (9004, [None] * 32, 0), (9005, [1.0], 0), (None, [1.0] * 32, 0), (7, [float(v) for v in x[7]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int").repartition(4)
    out = {}
    for r in ann.nearest(df, F.pmod("id", F.lit(50)) == 0, k=10).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert sorted(out) == list(range(0, 3000, 50))
    hits = 0
    for q, found in out.items():
        assert [r for *_, r in found] == list(range(1, 11)) and q not in [i for i, *_ in found]
        for i, s, _ in found:
            assert s == pytest.approx(float(x[i] @ x[q]), abs=1e-9)
        hits += len({i for i, *_ in found} & set(brute_neighbours(range(3000), x, q, 10)))
    assert hits / (10 * len(out)) >= 0.9
    # equal vectors come by id
    assert [i for i, *_ in out[100]] == brute_neighbours(range(3000), x, 100, 10)


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("id") == 0, k=20).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(df.limit(0), F.col("id") == 0).count() == 0


def _offered(nodes: int, offers: int) -> list[tuple]:
    """Sorted rows of a merge: each node's own list, then what others offer, with a score for each pair."""
    rng = np.random.default_rng(5)
    score = rng.permutation(nodes * 300).reshape(nodes, 300).astype(np.float32)

    def entries(v, m):
        w = rng.choice(300, m, replace=False)
        w = w[np.argsort(-score[v, w])]
        return w.astype(np.int64).tobytes(), score[v, w].tobytes()

    return [(v, b"own" if k == 0 else None, *entries(v, rng.integers(0 if k == 0 else 1, ann.DEGREE + 1))) for v in range(nodes) for k in range(offers + 1)]


def _arrow(rows: list[tuple], size: int):
    for k in range(0, len(rows), size):
        columns = list(zip(*rows[k : k + size]))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["v", "vec", "ids", "s"])


def test_ann_merge_keeps_the_best_of_all_offers_however_batches_are_cut():
    rows = _offered(40, 9)
    for size in (1, 4, 10, 1000):
        got = [r for b in ann._merge(_arrow(rows, size)) for r in b.to_pylist()]
        assert [r["v"] for r in got] == list(range(40))
        for r in got:
            pairs = {}
            for _, _, w, s in (x for x in rows if x[0] == r["v"]):
                pairs |= dict(zip(np.frombuffer(w, np.int64).tolist(), np.frombuffer(s, np.float32).tolist()))
            best = sorted(pairs, key=lambda w: -pairs[w])[: ann.DEGREE]
            own = set(np.frombuffer(rows[r["v"] * 10][2], np.int64).tolist())
            assert np.frombuffer(r["ids"], np.int64).tolist() == best
            assert list(r["new"]) == [int(w not in own) for w in best] and r["changed"] == sum(r["new"])


def test_ann_merge_does_not_go_through_offers_one_by_one():
    batches, calls = list(_arrow(_offered(50, 60), 10_000)), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        list(ann._merge(iter(batches)))
    finally:
        sys.setprofile(None)
    assert calls < 50 * 60


def test_ann_local_join_offers_what_a_list_would_take():
    rng = np.random.default_rng(6)
    x = rng.integers(-127, 128, size=(90, 8)).astype(np.int8)
    packed = [np.float32(1).tobytes() + r.tobytes() for r in x]
    least = rng.normal(0, 20_000, 90).astype(np.float32)
    rows = [(u, int(w), bool(rng.random() < 0.3)) for u in range(30) for w in rng.choice(90, rng.integers(1, 40), replace=False)]
    want: dict[int, dict[int, float]] = {}
    for u in range(30):
        group = [(w, f) for k, w, f in rows if k == u]
        for w, f in group:
            score = {z: float(x[w].astype(float) @ x[z]) for z, g in group if z != w and (f or g)}
            for z in sorted(score, key=lambda z: -score[z])[: ann.OFFERS]:
                if score[z] > least[w]:
                    want.setdefault(w, {})[z] = score[z]
    for size in (1, 17, 10_000):
        batches = (pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array([r[2] for r in part]), pa.array([packed[r[1]] for r in part], pa.binary()), pa.array(least[[r[1] for r in part]])], names=["u", "w", "fresh", "vec", "least"]) for part in (rows[k : k + size] for k in range(0, len(rows), size)))
        got = {r["v"]: dict(zip(np.frombuffer(r["ids"], np.int64).tolist(), np.frombuffer(r["s"], np.float32).tolist())) for b in ann._local_join(batches) for r in b.to_pylist()}
        assert got == {w: dict(sorted(z.items(), key=lambda i: -i[1])[: ann.DEGREE]) for w, z in want.items()}


def _random_model() -> maxent.Model:
    words = [b"w%d" % k for k in range(5000)] + [maxent.key_of(b"k" * 30)]
    counts = np.append(np.arange(5000, 0, -1), 1) * 50
    groups = np.array([maxent.group_of(w) for w in words])
    lexicon = maxent.Lexicon(words, counts, np.bincount(groups, weights=counts, minlength=maxent.GROUPS), np.bincount(groups, minlength=maxent.GROUPS))
    model = maxent.Model(lexicon)
    model.weights[:] = np.random.default_rng(0).normal(size=model.weights.shape) * 0.1
    return model


def test_maxent_expectations_are_the_sums_of_shares_and_take_no_index_per_branch():
    model, rng = _random_model(), np.random.default_rng(1)
    codes, place = rng.integers(0, 5000, 9001), np.arange(9001) % 40
    total, want = np.zeros(model.weights.size), np.zeros(model.weights.shape)
    tracemalloc.start()
    maxent.expect(model, codes, place, total)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for level, (node, rows) in enumerate(model.layout.of(codes, place, model.lexicon.leaf_of[codes], np.arange(9001))):
        for r in rows:
            np.add.at(want, r, model.shares(level, node, rows).astype(np.float64))
    assert np.allclose(total.reshape(want.shape), want, rtol=1e-6, atol=1e-12)
    assert peak < 1_300_000


def test_maxent_codes_of_long_words_are_those_of_their_digests():
    lexicon = _random_model().lexicon
    known, new = b"k" * 30, b"n" * 40
    codes, place, split = maxent.coded(lexicon, ["W3 " + known.decode() + " w3", "", new.decode().upper() + " w0"])
    unknown = lexicon.known + maxent.xxhash.xxh32_intdigest(maxent.key_of(new)) % maxent.OTHERS
    end = lexicon.known + maxent.xxhash.xxh32_intdigest(maxent.END) % maxent.OTHERS
    assert codes.tolist() == [3, 5000, 3, end, end, unknown, 0, end] and place.tolist() == [0, 1, 2, 3, 0, 0, 1, 2]
    assert split == [[b"w3", maxent.key_of(known), b"w3", maxent.END], [maxent.END], [maxent.key_of(new), b"w0", maxent.END]]
