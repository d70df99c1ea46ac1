import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark):
    """Each stage keeps what it should: checked against plain versions on the smallest tables."""
    import re

    import corpus_pipeline as p

    from graphvec.llm import decontaminate, jaccard

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert [n for n, _ in p.STAGES] == ["toxicity", "ngram_jaccard", "decontaminate", "pii", "bpe"] and p.ORACLE_SQL is None
    stages = {}
    for name, f in p.STAGES:
        before, docs = docs, f(spark, docs, DATA).persist()
        if name != "bpe":
            assert docs.columns == before.columns
        stages[name] = ({r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in docs.collect()})
    before, after = stages["toxicity"]
    gone = set(before) - set(after)
    assert set(after) <= set(before) and sum(labels.get(i, 0) == 0 for i in gone if i in labels) <= 2
    before, after = stages["ngram_jaccard"]
    sets = {i: s for i, s in zip(before, jaccard.shingle_sets([r["text"] for r in before.values()], 5))}
    link = lambda a, b: len(sets[a]) and len(sets[b]) and 100 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 80 * len(set(sets[a].tolist()) | set(sets[b].tolist()))
    for i in set(before) - set(after):
        assert any(link(i, j) for j in before if j != i)
    kept = sorted(after)
    assert not any(link(a, b) for k, a in enumerate(kept) for b in kept[:k])
    before, after = stages["decontaminate"]
    items = [b" ".join(decontaminate.words(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for i, r in before.items():
        if any(b" %b " % t in b" %b " % b" ".join(decontaminate.words(r["text"])) for t in items):
            assert i not in after
    before, after = stages["pii"]
    assert set(before) == set(after)
    for i, r in after.items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r["text"])
    assert set(stages["bpe"][1]) == set(after)


def tables(spark, path, documents, labels=(), benchmark=()):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, mark string, base string, `row` string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_awkward_rows(spark, tmp_path, awkward):
    """Nulls, empty and long texts, repeated ids and rows, ties, clashing columns: each stage keeps what its docstring says."""
    import corpus_pipeline as p

    item = "the quick brown fox jumps over the lazy dog and then it goes home to sleep for the night"
    plain = [f"document {i} tells of {i * 7} things that happened on day {i * 3} of the month number {i} in a far country" for i in range(30)]
    texts = [(i, t) for i, t in enumerate(awkward + plain)]
    texts += [(100, plain[0]), (100, plain[0]), (None, plain[1]), (None, None), (101, "x " + item + " y"), (102, "Mail zeb@example.org now, and nothing else today"), (103, None), (103, "another text under one id, quite unlike the others")]
    docs = [(i, t, "en", "s", None if t is None else len(t), "m", "b", "r") for i, t in texts]
    path = tables(spark, str(tmp_path), docs, [(i, 1, 0) for i in range(13, 30)], [(1, item), (2, None), (3, "")])
    out = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, f in p.STAGES[:-1]:
        before, out = out, f(spark, out, path).persist()
        assert out.columns == before.columns and out.schema.simpleString() == before.schema.simpleString()
        seen[name] = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(map(str, seen["toxicity"])) == sorted(map(str, texts))
    left = [x for x in texts if x[0] != 100 and x != (12, "same text here")]
    assert sorted(map(str, seen["ngram_jaccard"])) == sorted(map(str, left))  # 100 is a copy of a smaller id, so is 12
    left = [x for x in left if x[0] != 101]
    assert sorted(map(str, seen["decontaminate"])) == sorted(map(str, left))
    hidden = dict(x for x in seen["pii"] if x[0] == 102)
    assert len(seen["pii"]) == len(left) and hidden[102].startswith("Mail [EMAIL] now")
    last = p.run(spark, path).collect()
    assert sorted(str(r["doc_id"]) for r in last) == sorted(str(i) for i, _ in left)
    assert all(r["n_tokens"] == 0 for r in last if r["doc_id"] in (0, 1))


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    assert p.run(spark, tables(spark, f"{tmp_path}/a", [])).count() == 0
    assert p.run(spark, tables(spark, f"{tmp_path}/b", [(1, "some words here", "en", "s", 15, "m", "b", "r")])).count() == 1


def test_join_against_its_sql(spark):
    """The n-gram join's rows are those of its SQL, on whole tables."""
    import duckdb
    from graphvec.llm import queries

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    wanted = c.execute(queries.oracle_sql()["op7_jaccard"]).fetchall()
    assert sorted(map(tuple, queries.op7_jaccard(spark, DATA).collect())) == sorted(wanted)


def test_run_and_registration(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    assert "pipeline" in found and [next(n for n in found if n.startswith(f"op{k}_")) for k in range(1, 11)]
    assert found["pipeline"](spark, DATA).count() > 0
