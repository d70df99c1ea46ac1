import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphvec.functions import distance as D
from graphvec.operators import knn as K
from graphvec.operators.index import InvertedLists
from graphvec.operators import quantization as Q
from graphvec.operators import traversal as T


@pytest.fixture(scope="module")
def cloud(spark):
    """1000 vectors of 64 components in 20 clusters."""
    rng = np.random.default_rng(42)
    x = (rng.normal(size=(20, 64))[np.arange(1000) % 20] + 0.3 * rng.normal(size=(1000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(4).persist()
    return x.astype(np.float64), df


def test_distances(spark):
    row = spark.range(1).select(D.cosine([1, 0], [0, 1]), D.cosine([0, 0], [1, 1]), D.euclid([0, 3], [4, 0]), D.dot([1, 2], [3, 4]), D.cosine_unit([1, 0], [1, 0])).first()
    assert [round(x, 6) for x in row] == [1.0, 1.0, 5.0, -11.0, 0.0]


@pytest.mark.parametrize("metric", ["cosine", "euclid", "dot"])
def test_exact_and_batch_agree(cloud, metric):
    x, df = cloud
    q = x[7]
    wanted = {"cosine": 1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), "euclid": np.linalg.norm(x - q, axis=1), "dot": -(x @ q)}[metric].argsort(kind="stable")[:10].tolist()
    assert [r["id"] for r in K.knn(df, q, 10, metric).collect()] == wanted
    batch = K.knn_batch(df, df.filter("id in (7, 8)").select(F.col("id").alias("query_id"), "vector"), 10, metric)
    assert [r["id"] for r in batch.filter("query_id = 7").orderBy("rank").collect()] == wanted


def test_top_k_plan(cloud):
    plan = K.knn(cloud[1], cloud[0][0], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan.split("InMemoryTableScan")[0]


def test_inverted_lists_recall(cloud):
    x, df = cloud
    index = InvertedLists.build(df, 16, "euclid")
    hits = [len({r["id"] for r in index.search(x[i], 10, probes=8).collect()} & set(np.linalg.norm(x - x[i], axis=1).argsort()[:10].tolist())) for i in range(5)]
    assert sum(hits) >= 45
    assert index.sizes().agg(F.sum("n")).first()[0] == 1000


def test_scalar_quantization(spark, cloud):
    x, df = cloud
    rows = df.limit(20).select("id", F.col("vector").cast("array<double>").alias("v"), Q.sq8_dequantize(Q.sq8_quantize("vector")).alias("back"), Q.sq8_quantize("vector")["scale"].alias("scale")).collect()
    for r in rows:
        assert np.abs(np.array(r["v"]) - np.array(r["back"])).max() <= r["scale"] / 2 + 1e-9
    flat = spark.range(1).select(Q.sq8_quantize([2.0, 2.0]).alias("q")).first()["q"]
    assert flat["scale"] == 0 and flat["codes"] == [-128, -128]
    assert [r["id"] for r in Q.sq8_knn(df, x[3], 1, "euclid").collect()] == [3]


def test_product_quantization(cloud):
    x, df = cloud
    pq = Q.ProductQuantizer.train(df, 8, 64)
    assert pq.compression_ratio == 32
    coded = pq.encode(df)
    wanted = set(np.linalg.norm(x - x[5], axis=1).argsort()[:10].tolist())
    assert len({r["id"] for r in pq.search(coded, x[5], 10).collect()} & wanted) >= 4
    assert len({r["id"] for r in pq.search_with_rerank(coded, df, x[5], 10).collect()} & wanted) >= 9
    by_table = {r["id"]: r["s"] for r in coded.select("id", pq.adc(F.col("codes"), x[5]).alias("s")).collect()}
    for r in pq.search(coded, x[5], 10).collect():
        assert by_table[r["id"]] == pytest.approx(r["score"])
    assert Q.anisotropic(x[:1], x[:3])[0, 0] == pytest.approx(0)
    with pytest.raises(ValueError):
        Q.ProductQuantizer.train(df, 7)


ADJACENCY = {1: [2, 3], 2: [4], 3: [4, 5], 4: [6]}


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([(a, b, "r", 1.0) for a, bs in ADJACENCY.items() for b in bs], "src long, dst long, relation string, weight double")


def test_breadth_and_depth_first(tree):
    assert {r["node"]: r["depth"] for r in T.bfs(tree, 1).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3}
    assert T.bfs(tree, 1, 1).count() == 3
    order = [r["node"] for r in T.dfs(tree, 1).orderBy("position").collect()]
    assert order[0] == 1 and sorted(order) == [1, 2, 3, 4, 5, 6]
    assert T.bfs(tree, 6).count() == 1
    with pytest.raises(ValueError):
        T.dfs(tree, 1, max_edges=2)


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (1, 3, 1.0), (3, 2, 1.0), (2, 4, 1.0), (4, 1, 1.0)], "src long, dst long, weight double")
    found = {r["node"]: (r["cost"], r["path"]) for r in T.shortest_paths(edges, 1).collect()}
    assert found == {1: (0.0, [1]), 3: (1.0, [1, 3]), 2: (2.0, [1, 3, 2]), 4: (3.0, [1, 3, 2, 4])}
    paths = spark.createDataFrame([([1, 3, 2],), ([1, 4],)], "path array<long>")
    assert {tuple(r["path"]): r["total_weight"] for r in T.path_weight(paths, edges).collect()} == {(1, 3, 2): 2.0, (1, 4): None}


def test_shortest_paths_settle(spark):
    edges = spark.createDataFrame([(i, i + 1, 0.5) for i in range(103)], "src long, dst long, weight double")
    assert {r["node"]: r["cost"] for r in T.shortest_paths(edges, 0).collect()} == {i: i / 2 for i in range(104)}
    with pytest.raises(ValueError):
        T.shortest_paths(edges, 0, max_rounds=3)
    with pytest.raises(ValueError):
        T.shortest_paths(spark.createDataFrame([(1, 2, -1.0), (2, 1, 0.5)], "src long, dst long, weight double"), 1)


def test_index_changes_on_disk(spark, cloud, tmp_path):
    """Insert, delete, insert again and compact: the answers are those of a scan of what is there, and only probed lists are read."""
    x, df = cloud
    index = InvertedLists.build(df, 16, "euclid", parts=8).write(f"{tmp_path}/i")
    index = index.delete([3, 5, 777_777]).insert(df.filter("id = 5").select("id", F.transform("vector", lambda v: v + 9).alias("vector")))
    index = index.insert(df.filter("id < 10").select((F.col("id") + 5000).alias("id"), "vector")).delete([5001])
    now = {i: v for i, v in enumerate(x) if i not in (3, 5)} | {5: x[5] + 9} | {5000 + i: x[i] for i in range(10) if i != 1}
    for found in (index, InvertedLists.load(spark, f"{tmp_path}/i"), index.compact(f"{tmp_path}/j")):
        wanted = sorted(now, key=lambda i: (np.linalg.norm(now[i] - x[0]), i))[:10]
        assert [r["id"] for r in found.search(x[0], 10, probes=16).collect()] == wanted
        assert [r["id"] for r in found.search_coded(x[0], 10, probes=16, factor=200).collect()] == wanted
        assert {r["id"] for r in found.ids().collect()} == set(now) and found.sizes().agg(F.sum("n")).first()[0] == len(now)
        assert found.memory_bytes() > 8 * 64 * len(now)
    plan = index.search(x[0], 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    hits = [len({r["id"] for r in index.search_coded(x[i], 10, probes=8).collect()} & set(sorted(now, key=lambda j: (np.linalg.norm(now[j] - x[i]), j))[:10])) for i in range(40, 45)]
    assert sum(hits) >= 45


def test_batches_of_queries_share_a_scan(spark, cloud, monkeypatch):
    """Blocks of queries and of bytes give what one block gives, ties by id included."""
    _, df = cloud
    points = df.unionByName(df.filter("id < 300").withColumn("id", F.col("id") + 10_000))
    asked = df.filter("id < 30").select(F.col("id").alias("query_id"), "vector")
    wanted = sorted(map(tuple, K.knn_batch(points, asked, 5).collect()))
    monkeypatch.setattr(K, "QUERY_BLOCK", 4)
    monkeypatch.setattr(K, "QUERY_BYTES", 64 * 8 * 10)
    got = sorted(map(tuple, K.knn_batch(points, asked, 5).collect()))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in wanted] and [r[2] for r in got] == pytest.approx([r[2] for r in wanted])


@pytest.mark.parametrize("tied", [False, True])
def test_memory_of_a_batch_is_bounded(spark, monkeypatch, tied):
    """A task holds a few blocks of distances, not those of a whole batch, also where more points tie than are asked for."""
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(1024, 16)), rng.normal(size=(10_000, 16))
    if tied:
        x = np.repeat(x[:500], 20, axis=0)
    points = spark.createDataFrame([(0, [0.0])], "id long, vector array<double>")
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(q.tolist())], "query_id long, vector array<double>")
    kept, plain = [], type(points).mapInArrow
    monkeypatch.setattr(type(points), "mapInArrow", lambda self, f, *a, **o: kept.append(f) or plain(self, f, *a, **o))
    K.knn_batch(points, asked, 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x)), pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "vector"])
    tracemalloc.start()
    try:
        out = list(kept[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 10 * len(q) and peak < 64 << 20
    wanted = np.lexsort((np.arange(len(x)), K.numpy_distances(x, q[:1], K.Distance.COSINE)[:, 0].round(12)))[:10]
    rows = out[0].to_pandas().query("query_id == 0").sort_values(["score", "id"])
    assert rows["id"].tolist() == wanted.tolist()


@pytest.mark.parametrize("metric", list(K.Distance))
@pytest.mark.parametrize("order", ["mixed", "nearer", "same"])
def test_nearest_in_pieces(metric, order):
    """Pieces of points give what scores of all pairs give: copies, zeros, tiny and huge ones, pieces that come ever nearer."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(300, 7)), np.zeros((30, 7)), 1e-160 * rng.normal(size=(20, 7)), 1e100 * rng.normal(size=(20, 7))])
    x = np.concatenate([x, x])[rng.permutation(740)]
    v = np.concatenate([x[:12], np.zeros((1, 7)), 1e-160 * np.ones((1, 7)), rng.normal(size=(5, 7))])
    if order == "nearer":
        x = x[np.argsort(-K.numpy_distances(x, v[:1], metric)[:, 0])]
    if order == "same":
        x = np.repeat(x[:2], 370, axis=0)
    ids = rng.permutation(740)
    every = K._Nearest(v, 5, metric)
    a, b = (z.ravel() for z in np.meshgrid(np.arange(740), np.arange(len(v))))
    scores = every.scores(x, (x * x).sum(1), a, b).reshape(len(v), 740)
    for most, step in ((5, 64), (5, 1), (800, 100)):
        near = K._Nearest(v, most, metric)
        for i in range(0, 740, step):
            near.add(ids[i : i + step], x[i : i + step])
        for j in range(len(v)):
            best = np.lexsort((ids, scores[j]))[:most]
            own = near.held[0] == j
            mine = np.lexsort((near.held[1][own], near.held[2][own]))
            assert near.held[1][own][mine].tolist() == ids[best].tolist() and np.array_equal(near.held[2][own][mine], scores[j][best])


def test_kmeans_leaves_no_centre_empty():
    x = np.concatenate([np.zeros((50, 2)), np.ones((50, 2)), [[9.0, 9.0]]])
    centres = K.kmeans(x, 3)
    assert {tuple(c) for c in centres.tolist()} == {(0.0, 0.0), (1.0, 1.0), (9.0, 9.0)} and len(K.kmeans(x[:1], 5)) == 1


def test_traversal_goes_on(spark):
    """Chains beyond a hundred steps are walked to their end."""
    edges = spark.createDataFrame([(i, i + 1, "r", 1.0) for i in range(105)], "src long, dst long, relation string, weight double")
    assert T.bfs(edges, 0).agg(F.max("depth")).first()[0] == 105
    assert T.dfs(edges, 100).count() == 6 and T.dfs(edges, 100, 2).count() == 3
