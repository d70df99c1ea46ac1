"""Queries over whole tables against brute force on the smallest tables."""

import heapq
import os

import numpy as np
import pytest

from graphvec import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def vectors(spark):
    return {r["vec_id"]: list(map(float, r["embedding"])) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()}


@pytest.fixture(scope="module")
def links(vectors):
    n = len(vectors)
    return {v: [(x, w) for x, w in (((7 * v + 1) % n, 1.0), ((13 * v + 5) % n, 0.5)) if x != v] for v in vectors}


def test_shortest_path(spark, links):
    cost, queue = {}, [(0.0, 0)]
    while queue:
        c, v = heapq.heappop(queue)
        if v not in cost:
            cost[v] = c
            for x, w in links.get(v, ()):
                heapq.heappush(queue, (c + w, x))
    assert {r["node"]: r["cost"] for r in core.queries()["shortest_path"](spark, DATA).collect()} == cost


def test_knn_batch(spark, vectors):
    out = {}
    for r in core.queries()["knn_batch"](spark, DATA).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert sorted(out) == sorted(v for v in vectors if v % 50 == 0)
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q, found in out.items():
        d = 1 - x @ x[ids.index(q)]
        assert [s for _, s in found] == pytest.approx(np.sort(d)[: core.K_NEAREST].tolist(), abs=2e-4)
        assert [d[ids.index(i)] for i, _ in found] == pytest.approx([s for _, s in found], abs=2e-4)


@pytest.mark.parametrize("name, least, most", [("var_len_1_3", 1, 3), ("var_len_exact2", 2, 2)])
def test_var_len(spark, links, name, least, most):
    wanted = []
    for v in links:
        depth, level = {v: 0}, [v]
        for k in range(1, most + 1):
            level = sorted({x for a in level for x, _ in links[a]} - set(depth))
            depth |= dict.fromkeys(level, k)
        wanted += [(v, x) for x, k in depth.items() if least <= k]
    assert sorted((r["a"], r["b"]) for r in core.queries()[name](spark, DATA).collect()) == sorted(wanted)
