import json

import pytest
from pyspark.sql import functions as F

from graphvec.collection import Collection
from graphvec.model import CollectionConfig, Distance, IndexConfig
from graphvec.sources import documents
from graphvec.sources.payload import value
from graphvec.sources.store import Catalog, export_collection, import_collection, load_collection
from graphvec.streaming.log import LOG, DurableCollection, LogSink, replay

SEVEN = {1: (1, 0, 0, 0), 2: (0.9, 0.1, 0, 0), 3: (0.8, 0.2, 0, 0), 4: (0, 1, 0, 0), 5: (0, 0.9, 0.1, 0), 6: (0, 0, 1, 0), 7: (0, 0, 0.9, 0.1)}


def made(spark, points=SEVEN, edges=(), **config):
    c = Collection.empty(spark, CollectionConfig("c", len(next(iter(points.values()))), **config))
    c = c.upsert_rows([{"id": i, "vector": v} for i, v in points.items()]).collection
    return c.add_edges(spark.createDataFrame(list(edges), "src long, dst long, relation string, weight double")) if edges else c


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_configuration():
    assert Distance.parse("L2") is Distance.EUCLID
    for wrong in (lambda: CollectionConfig("a b", 3), lambda: CollectionConfig("a", 0), lambda: IndexConfig(m=1), lambda: IndexConfig(m=16, m0=8), lambda: IndexConfig(ef=0), lambda: Distance.parse("manhattan")):
        with pytest.raises(ValueError):
            wrong()
    c = CollectionConfig("a", 3, Distance.DOT)
    assert CollectionConfig.from_dict(json.loads(json.dumps(c.to_dict()))) == c


def test_search(spark):
    c = made(spark)
    assert ids(c.search([0.95, 0.05, 0, 0], 3)) in ([1, 2, 3], [2, 1, 3])
    axes = made(spark, {1: (1, 0, 0), 2: (0, 1, 0), 3: (0, 0, 1)})
    best = axes.search([1, 0, 0], 1).first()
    assert best["id"] == 1 and best["score"] < 0.01
    three = made(spark, {1: (1, 0, 0, 0), 2: (0.7, 0.7, 0, 0), 3: (0, 1, 0, 0)})
    found = ids(three.search([1, 0, 0, 0], 3, score_threshold=0.5))
    assert 1 in found and 3 not in found
    with pytest.raises(ValueError):
        c.search([1, 0], 3)
    with pytest.raises(ValueError):
        c.search([1, 0, 0, 0], 3, ef=0)
    assert c.search([1, 0, 0, 0], 1, with_vector=True, with_payload=True).columns == ["id", "score", "payload", "vector"]
    batch = c.search_batch([{"vector": [1, 0, 0, 0], "limit": 1}, {"vector": [0, 0, 1, 0], "score_threshold": 0.05}], 3).orderBy("query_id", "rank")
    assert [(r["query_id"], r["id"]) for r in batch.collect()] == [(0, 1), (1, 6), (1, 7)]


def test_payload_filter(spark):
    c = Collection.empty(spark, CollectionConfig("c", 1))
    c = c.upsert_rows([{"id": 1, "vector": [1], "payload": {"category": "test", "score": 42}}, {"id": 2, "vector": [1], "payload": {"category": "x"}}, {"id": 3, "vector": [1]}]).collection
    assert ids(c.search([1], 5, where={"must": {"category": "test"}})) == [1]
    assert ids(c.search([1], 5, where={"must_not": {"category": "test"}})) == [2, 3]
    row = c.get_points([1]).select(value("payload", "score", "long").alias("s"), value("payload", "category", "string").alias("c")).first()
    assert tuple(row) == (42, "test")
    g = c.graph({"score": "long", "category": "string"})
    assert [tuple(r) for r in g.cypher("MATCH (p:Point) WHERE p.score > 40 RETURN p.id AS i, p.category AS c").collect()] == [(1, "test")]


def test_upsert_and_delete(spark):
    c = made(spark, {1: (1, 0, 0, 0)})
    again = c.upsert_rows([{"id": 1, "vector": [0, 1, 0, 0]}])
    assert (again.inserted, again.updated) == (0, 1)
    assert again.collection.get_point(1).first()["vector"] == [0, 1, 0, 0]
    twice = c.upsert_rows([{"id": 5, "vector": [1, 1, 1, 1]}, {"id": 5, "vector": [2, 2, 2, 2]}])
    assert (twice.inserted, twice.updated) == (1, 0) and twice.collection.get_point(5).first()["vector"] == [2, 2, 2, 2]
    left, n = made(spark).delete_points([1, 3, 5, 99])
    assert n == 3 and sorted(ids(left.points)) == [2, 4, 6, 7]
    with pytest.raises(ValueError):
        c.upsert_rows([{"id": 1, "vector": [1]}])


def test_scroll_and_get(spark):
    c = made(spark, {i: (i * 0.1, 0, 0, 0) for i in range(25)})
    sizes, offset = [], None
    while True:
        page = c.scroll(10, offset)
        sizes.append(page.points.count())
        offset = page.next_offset
        if offset is None:
            break
    assert sizes == [10, 10, 5]
    assert ids(c.get_points([7, 3, 99])) == [7, 3]
    assert [r["id"] for r in c.get_points([7, 99], missing=True).collect()] == [7, 99]
    assert c.point_exists(3) and not c.point_exists(99) and c.point_count() == 25
    with pytest.raises(ValueError):
        c.scroll(0)


EDGES = [(1, 2, "similar", 0.9), (2, 3, "similar", 0.8), (1, 4, "related", 0.7), (4, 5, "related", 0.6), (3, 6, "similar", 0.5)]


def test_edges(spark):
    c = made(spark, edges=EDGES)
    assert {2, 3, 4, 5} <= set(ids(c.traverse(1, 3), "target_id"))
    found = set(ids(c.traverse(1, 3, ["similar"]), "target_id"))
    assert {2, 3, 6} <= found and not found & {4, 5}
    path = c.traverse(1, 3).filter("target_id = 6").first()
    assert (path["depth"], path["path"], path["relation"], round(path["weight"], 2)) == (3, [1, 2, 3, 6], "similar", 0.5)
    assert c.add_edge(1, 2, "similar", 5.0).get_edges(1).filter("dst = 2").first()["weight"] == pytest.approx(0.9)  # the first stays
    with pytest.raises(KeyError):
        c.add_edge(1, 99, "similar")
    assert c.remove_edge(1, 2).get_edges(1).count() == 1
    assert sorted(ids(c.neighbours(3, direction="both"), "neighbour")) == [2, 6]
    gone, _ = c.delete_points([6])
    assert 6 in ids(gone.traverse(1, 3), "target_id")  # edges stay dangling


def test_export_import(spark, tmp_path):
    c = made(spark, edges=EDGES)
    export_collection(c, f"{tmp_path}/c")
    back = load_collection(spark, f"{tmp_path}/c")
    assert back.config == c.config and back.point_count() == 7 and back.edges.count() == 5
    with pytest.raises(FileExistsError):
        import_collection(back, "create", c)
    small = made(spark, {1: (9, 9, 9, 9), 50: (1, 1, 1, 1)})
    merged, imported, skipped = import_collection(back, "merge", small)
    assert (imported, skipped) == (6, 1) and merged.get_point(1).first()["vector"] == [9, 9, 9, 9] and merged.point_count() == 8
    assert import_collection(back, "replace", small)[0].point_count() == 7
    catalog = Catalog(spark)
    catalog.create(CollectionConfig("x", 2))
    with pytest.raises(FileExistsError):
        catalog.create(CollectionConfig("x", 2))
    assert catalog.list() == ["x"] and catalog.info("x")["points"] == 0 and catalog.delete("x") and not catalog.delete("x")


def log(spark, *entries):
    return spark.createDataFrame([(e["lsn"], e["op"], e.get("ids"), e.get("point"), e.get("edge"), e.get("aborted")) for e in entries], LOG)


def point(i, x=1.0):
    return (i, [x], [], {})


def test_replay(spark):
    up = lambda lsn, i, x=1.0: {"lsn": lsn, "op": "upsert", "point": point(i, x)}
    only = replay(spark, CollectionConfig("c", 1), log(spark, up(0, 1), up(1, 999), {"lsn": 2, "op": "abort", "aborted": 1}))
    assert ids(only.points) == [1]
    entries = [up(i, i, i * 0.1) for i in range(100)] + [{"lsn": 100, "op": "delete", "ids": list(range(20))}] + [up(101 + i, 80 + i, 9.0) for i in range(10)]
    lived = replay(spark, CollectionConfig("c", 1), log(spark, *entries))
    assert lived.point_count() == 80 and lived.get_point(85).first()["vector"] == [9.0]
    edge = lambda lsn, op, s, d, r, w=1.0: {"lsn": lsn, "op": op, "edge": (s, d, r, w)}
    linked = replay(spark, CollectionConfig("c", 1), log(spark, edge(0, "add_edge", 1, 2, "a", 0.5), edge(1, "add_edge", 1, 2, "a", 0.7), edge(2, "remove_edge", 1, 2, "b"), edge(3, "add_edge", 1, 3, "a"), edge(4, "remove_edge", 1, 3, "a"), edge(5, "add_edge", 1, 3, "a", 0.2)))
    assert sorted((r["dst"], round(r["weight"], 1)) for r in linked.edges.collect()) == [(2, 0.5), (3, 0.2)]


def test_stream(spark, tmp_path):
    one = log(spark, {"lsn": 0, "op": "upsert", "point": point(1)}, {"lsn": 1, "op": "upsert", "point": point(2)})
    two = log(spark, {"lsn": 2, "op": "delete", "ids": [1]}, {"lsn": 3, "op": "upsert", "point": point(3)})
    sink = LogSink(spark, CollectionConfig("c", 1), f"{tmp_path}/snapshots")
    one.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/log")
    sink.start(stream, f"{tmp_path}/state").awaitTermination()
    assert sorted(ids(sink.current().points)) == [1, 2]
    two.write.mode("append").parquet(f"{tmp_path}/log")
    sink.start(stream, f"{tmp_path}/state").awaitTermination()
    assert sorted(ids(sink.current().points)) == [2, 3]


def test_documents(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><script>x()</script><p>Cats &amp; dogs</p></html>")
    (tmp_path / "b.csv").write_text("name,age\nAnn,3\n")
    html = documents.read(spark, f"{tmp_path}/a.html", "html")
    assert html.first()["text"] == "Cats & dogs"
    assert documents.read(spark, f"{tmp_path}/b.csv", "csv").first()["text"] == "name: Ann\nage: 3"
    pieces = documents.split(spark.createDataFrame([("s", "abcdefghij")], "source string, text string"), 4, 1)
    assert [r["text"] for r in pieces.orderBy("start").collect()] == ["abcd", "defg", "ghij"]
    points = documents.to_points(html, 16)
    c = Collection.empty(spark, CollectionConfig("d", 16)).upsert(points).collection
    query = spark.range(1).select(documents.hashed_embedding(F.lit("dogs cats"), 16).alias("v")).first()["v"]
    assert c.search(query, 1).first()["score"] < 0.01


def test_upsert_without_order_is_the_same_whatever_the_partitions(spark):
    c = made(spark)
    rows = spark.createDataFrame([(1, [float(i), 0.0, 0.0, 0.0]) for i in range(20)], "id long, vector array<float>")
    found = {tuple(c.upsert(rows.repartition(n)).collection.get_point(1).first()["vector"]) for n in (1, 3, 7)}
    assert len(found) == 1


def test_query_by_vector_or_point(spark):
    c = made(spark)
    vector = [float(x) for x in c.get_point(1).first()["vector"]]
    assert ids(c.query({"nearest": vector}, 3)) == ids(c.search(vector, 3)) and ids(c.query(vector, 3))[0] == 1
    assert 1 not in ids(c.query({"nearest": 1}, 3))
    with pytest.raises(KeyError):
        c.query({"nearest": 12345})


def test_durable_log(spark, tmp_path):
    """What was logged lasts; a batch that turns out wrong is aborted; snapshots come after enough entries and change nothing."""
    sink = LogSink(spark, CollectionConfig("c", 1), f"{tmp_path}/d", snapshot_entries=5)
    store = DurableCollection(sink)
    points = lambda *pairs: spark.createDataFrame([(i, [float(x)]) for i, x in pairs], "id long, vector array<float>")
    store.upsert(points((1, 1), (2, 2), (3, 3)))
    with pytest.raises(ValueError):
        store.upsert(spark.createDataFrame([(9, [1.0, 2.0]), (1, [7.0])], "id long, vector array<float>"))
    assert ids(store.collection.points) == [1, 2, 3] and store.collection.get_point(1).first()["vector"] == [1.0]
    assert sink.entries(sink.batches()).filter("op = 'abort'").count() == 2
    edges = spark.createDataFrame([(1, 2, "a"), (1, 3, "a")], "src long, dst long, relation string")
    store.add_edges(edges)
    assert sink.versions()  # 3 + 2 + 2 + 2 entries
    store.delete(points((2, 0)))
    out = store.remove_edges(edges.limit(1).withColumn("relation", F.lit(None).cast("string")))
    assert sorted(ids(out.points)) == [1, 3] and out.edges.count() == 1
    before = sorted(map(str, out.points.collect()))
    number = store.checkpoint()
    assert number == sink.versions()[-1] and sorted(map(str, DurableCollection(LogSink(spark, sink.config, sink.path)).collection.points.collect())) == before
