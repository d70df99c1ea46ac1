"""Near copies, repeated passages and contamination against brute force."""

import pathlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from graphvec.llm import components, decontaminate, jaccard, substring
from graphvec.llm.common import mapped

WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def plain_sets(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(texts, n, percent):
    sets = [plain_sets(t, n) for t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(root)
        for i in range(len(texts)):
            for j in range(i):
                a, b = sets[i], sets[j]
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    return [(len(s), r) for s, r in zip(sets, root)]


def corpus(seed):
    """Groups of copies, near copies and chains of near copies, unrelated texts, a common line."""
    rng = random.Random(seed)
    out = []
    for _ in range(6):
        base = sentence(rng, rng.choice([2, 5, 30, 80, 200])).split()
        out += [" ".join(base)] * rng.choice([1, 2, 4])
        for _ in range(rng.choice([0, 8, 20])):
            base = list(base) if rng.random() < 0.5 else out[-1].split()
            base[rng.randrange(len(base))] = rng.choice(WORDS)
            out.append(" ".join(base))
    out += [sentence(rng, 40) + " released under the common license of all" for _ in range(10)]
    rng.shuffle(out)
    return out + [None, "", " \n", "one", "ONE", "a b"]


@pytest.mark.parametrize("seed,n,percent", [(1, 3, 90), (2, 5, 80), (3, 3, 50)])
def test_join_is_exact(docs, seed, n, percent):
    texts = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(texts), n, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, n, percent)


def test_join_edge_cases(docs, awkward):
    assert jaccard.join(docs([])).count() == 0
    out = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(awkward)).collect()}
    assert out[12] == 11 and out[0] == 0 and out[1] == 1
    odd = jaccard.join(docs([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (2, "a b c d")])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in odd if r["doc_id"] is not None) == [(False, 2, 2), (False, 5, 2), (False, 5, 2)]
    kept = jaccard.keep_one(docs(["a b c d e f", "a b c d e f", "x y", None]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3] and kept.columns[:3] == ["doc_id", "text", "lang"]


def test_suffix_bound_never_too_small():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(2))
        assert jaccard.suffix_bound(x, y) >= len(np.intersect1d(x, y))
        odd = sum(int(v).bit_count() for v in (jaccard.odd_sketch(x) ^ jaccard.odd_sketch(y)).view(np.uint64))
        assert odd <= len(np.setxor1d(x, y))
        assert np.minimum(np.frombuffer(jaccard._bins(x), "<i4"), np.frombuffer(jaccard._bins(y), "<i4")).sum() >= len(np.intersect1d(x, y))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (200, 200), (7, 3)]
    df = spark.createDataFrame(chain, "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, 90: 90, 95: 90, 100: 90}
    assert components.components(df.limit(0)).count() == 0


# -- substrings --------------------------------------------------------------------------------------------------------
def test_gear_hash():
    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog", dtype=np.uint8)
    wanted = [sum(int(substring.GEAR[data[i - k]]) << k for k in range(min(16, i + 1))) & 0xFFFF for i in range(len(data))]
    assert substring.gear_hash(data).tolist() == wanted


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(5)
    text = sentence(rng, 400) + "é中😀" + "a" * 2000
    own, h1, h2, start, end = substring.chunks([text, "", "Q" + text, text])
    for k in (0, 2, 3):
        s, e = start[own == k], end[own == k]
        assert s[0] == 0 and (s[1:] == e[:-1]).all() and e[-1] == len(text) + (k == 2)
    assert not (own == 1).any()
    one, shifted = ({(a, b) for a, b in zip(h1[own == k].tolist(), h2[own == k].tolist())} for k in (0, 2))
    assert len(one & shifted) >= len(one) - 2


def test_repeats(docs, awkward):
    rng = random.Random(9)
    passage = sentence(rng, 60)
    texts = [sentence(rng, 50) + " " + passage + " " + sentence(rng, 30), sentence(rng, 90), sentence(rng, 20) + " " + passage, sentence(rng, 40) + " All rights reserved.", sentence(rng, 40) + " All rights reserved."]
    found = substring.repeats(docs(texts)).collect()
    assert {r["doc_id"] for r in found} == {0, 2}
    for r in found:
        part = texts[r["doc_id"]][r["start"] : r["end"]]
        assert part in passage and len(part) > len(passage) / 2
        assert r["first_doc_id"] == 0 and r["kept"] == (r["doc_id"] == 0)
    assert substring.repeats(docs([])).count() == 0
    copies = substring.repeats(docs(awkward + [passage, passage])).collect()
    assert {(r["doc_id"], r["start"], r["end"]) for r in copies} >= {(len(awkward), 0, len(passage)), (len(awkward) + 1, 0, len(passage))}
    again = substring.repeats(docs([(3, passage), (3, passage)]))
    assert again.count() == 0  # one document


# -- contamination -----------------------------------------------------------------------------------------------------
def similarity(items, a, b):
    """Exact weighted-shingle similarity of word lists, b an item."""
    from collections import Counter

    df = Counter(s for w in items for s in set(grams(w)))
    import math

    weight = lambda s: max(1, round(16 * math.log1p(len(items) / df[s]))) if s in df else max(1, round(16 * math.log1p(len(items))))
    x, y = Counter(grams(a)), Counter(grams(b))
    return sum(min(x[s], y[s]) * weight(s) for s in x) / sum(max(x[s], y[s]) * weight(s) for s in set(x) | set(y))


def grams(w):
    n = min(5, len(w))
    return list(zip(*(w[k:] for k in range(n))))


def test_contamination_is_complete(docs, spark, awkward):
    rng = random.Random(3)
    items = [sentence(rng, n) for n in (3, 12, 20, 40, 40, 60)]
    edited = items[4].split()
    edited[-1] = "changed"
    texts = [sentence(rng, 30) + " " + items[2].upper() + "! " + sentence(rng, 10), sentence(rng, 200), items[0], " ".join(edited), sentence(rng, 5) + " " + " ".join(edited) + " " + items[5], items[3][: len(items[3]) // 2], items[1] + " " + items[1], None, ""]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(99, None, "x"), (98, "", "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs(texts), benchmark).collect()}
    split = [decontaminate.words(t) for t in items]
    wanted = set()
    for d, t in enumerate(texts):
        w = decontaminate.words(t or "")
        for i, item in enumerate(split):
            best = max((similarity(split, w[s : s + len(item)], item) for s in range(max(1, len(w) - len(item) + 1))), default=0) if w else 0
            if best >= decontaminate.SIMILARITY:
                wanted.add((d, i))
                assert got[d, i]["similarity"] == pytest.approx(best)
    assert set(got) == wanted and (0, 2) in wanted and (3, 4) in wanted
    kept = decontaminate.keep_clean(docs(texts), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in wanted}
    assert decontaminate.contaminated(docs(awkward), benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(docs([]), benchmark).count() == 0
    assert decontaminate.contaminated(docs(awkward), benchmark).count() == 0


def test_contamination_does_not_depend_on_blocks(docs, spark, monkeypatch):
    rng = random.Random(8)
    stem = sentence(rng, 30)
    items = [stem + " " + sentence(rng, 12) for _ in range(4)] + [sentence(rng, 42) for _ in range(3)]
    texts = [sentence(rng, 20) + " " + t + " " + sentence(rng, 9) for t in items] + [stem, sentence(rng, 50)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = []
    for most in (1, 100, 4_000_000):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", most)
        found.append(sorted(map(tuple, decontaminate.contaminated(docs(texts), benchmark).collect())))
        assert {r["doc_id"] for r in decontaminate.keep_clean(docs(texts), benchmark).collect()} == {7, 8}
    assert found[0] == found[1] == found[2] and {r[0] for r in found[0]} == set(range(7))


def test_multi_index_guarantees_the_radius():
    """Whatever bits differ, up to RADIUS of them: some block is near; of unrelated fingerprints few are."""
    rng = np.random.default_rng(1)
    bits, per = decontaminate.BITS, decontaminate.BITS // decontaminate.BLOCKS
    near = lambda a, b: (decontaminate.ONES[a ^ b] <= decontaminate.RADIUS // decontaminate.BLOCKS).any(-1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, decontaminate.BLOCKS).astype(np.uint16)
        b = a.copy()
        for f in rng.choice(bits, decontaminate.RADIUS, replace=False):
            b[f // per] ^= 1 << (f % per)
        assert near(a, b)
    x, y = (rng.integers(0, 1 << 16, (20_000, decontaminate.BLOCKS)).astype(np.uint16) for _ in range(2))
    assert near(x, y).mean() < 0.1


@pytest.mark.parametrize("edits", [1, 2])
def test_edited_windows_stay_within_the_radius(edits):
    """Windows of 60 words with a similarity of 0.8 and more: the fingerprints find them."""
    rng = random.Random(edits)
    missed = total = 0
    for _ in range(150):
        item = sentence(rng, 60)
        changed = item.split()
        for k in rng.sample(range(60), edits):
            changed[k] = "zz"
        items = decontaminate.Items([(0, item)], decontaminate.Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1))
        h = decontaminate.shingles([w.encode() for w in changed])
        if items.similarity(h, items.weights.of(h), 0) >= decontaminate.SIMILARITY:
            total += 1
            missed += not list(decontaminate.find(items, [" ".join(changed)]))
    assert missed <= 0.01 * total and total > 10


def test_removal_keeps_each_chunk_once(docs):
    """Without the runs that aren't kept, every chunk of the corpus still stands somewhere: A, A B and A B against brute force."""
    rng = random.Random(4)
    a, b, c = (sentence(rng, 70) for _ in range(3))
    texts = [a, a + " " + b, a + " " + b, c + " " + a + " " + c, b, None, "a" * 3000, "a" * 3000 + " " + c, (20, "x " + b)]
    texts = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    found = substring.repeats(docs(texts)).collect()
    gone = {}
    for r in found:
        if not r["kept"]:
            gone.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    before, after = set(), set()
    for i, t in texts:
        own, h1, h2, start, end = substring.chunks([t or ""])
        for d, s, e in zip(zip(h1.tolist(), h2.tolist()), start.tolist(), end.tolist()):
            before.add(d)
            if not any(x <= s and e <= y for x, y in gone.get(i, ())):
                after.add(d)
    assert before == after and sum(map(len, gone.values())) >= 4


def test_repeats_against_brute_force(docs):
    rng = random.Random(12)
    shared = [sentence(rng, n) for n in (20, 60, 100)]
    texts = [" ".join([sentence(rng, rng.randrange(40)), rng.choice(shared), sentence(rng, rng.randrange(40)), rng.choice(shared)]) for _ in range(25)] + [None, ""]
    pieces = {i: list(zip(*(x.tolist() for x in substring.chunks([t])[1:]))) for i, t in enumerate(texts) if t}
    holders, first = {}, {}
    for i in sorted(pieces):
        for h1, h2, s, _ in pieces[i]:
            holders.setdefault((h1, h2), set()).add(i)
            first.setdefault((h1, h2), (i, s))
    wanted = set()
    for i, parts in pieces.items():
        stretch = []
        for h1, h2, s, e in [*parts, (None, None, -9, -9)]:
            if len(holders.get((h1, h2), ())) > 1:
                stretch.append((s, e, first[h1, h2]))
                continue
            if stretch and stretch[-1][1] - stretch[0][0] >= substring.LEAST_RUN:
                run = []
                for piece in [*stretch, None]:
                    if run and (piece is None or (piece[2] == (i, piece[0])) != (run[-1][2] == (i, run[-1][0]))):
                        wanted.add((i, run[0][0], run[-1][1], len(run), min(p[2][0] for p in run), run[0][2] == (i, run[0][0])))
                        run = []
                    run += [piece] if piece else []
            stretch = []
    assert {tuple(r) for r in substring.repeats(docs(texts)).collect()} == wanted and len(wanted) > 20


def test_workers_map_a_broadcast_table_and_hold_no_copy(spark):
    table = bytearray(np.random.default_rng(4).integers(0, 256, 1 << 26, dtype=np.uint8))
    shared = spark.sparkContext.broadcast(table)
    total = int(np.frombuffer(table, np.uint8).sum(dtype=np.int64))

    def anonymous():
        return int(re.search(r"Pss_Anon:\s+(\d+)", pathlib.Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    def run(batches):
        for _ in batches:
            before = anonymous()
            x = mapped(shared)
            found = int(x.sum(dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([found]), pa.array([anonymous() - before])], names=["total", "mb"])

    for r in spark.range(2).repartition(2).mapInArrow(run, "total long, mb double").collect():
        assert r["total"] == total and r["mb"] < 48
    assert int(mapped(shared).sum(dtype=np.int64)) == total  # on the driver


@pytest.mark.parametrize("size", [0, 3, 100, 70_000])
def test_a_mapped_table_of_any_size_is_whole(spark, size):
    table = bytearray(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8))
    shared = spark.sparkContext.broadcast(table)

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([mapped(shared).tobytes()], pa.binary())], names=["x"])

    assert {bytes(r["x"]) for r in spark.range(2).mapInArrow(run, "x binary").collect()} == {bytes(table)}
