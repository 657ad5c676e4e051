"""Neighbours and density groups against brute force, and the memory of their tiles."""

import tracemalloc

import numpy as np

from papyra.operators import learning, neighbours


def peak(run) -> float:
    tracemalloc.start()
    run()
    mb = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return mb


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(range(len(x)) if ids is None else ids, x)], "vec_id long, embedding array<float>")


def vectors(n, dims, seed=0):
    return np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)


def brute_knn(x, ids, k):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    out = {}
    for a, i in enumerate(ids):
        out[i] = sorted((-s[a, b], j) for b, j in enumerate(ids) if j != i)[:k]
    return out


def test_knn_with_copies_over_several_chunks(spark, monkeypatch):
    x = vectors(300, 8)
    x[100:180] = x[7]
    x[200] = -x[7]
    monkeypatch.setattr(neighbours, "CHUNK_BYTES", 4000)
    ids = [3 * i - 200 for i in range(300)]
    want, got = brute_knn(x, ids, 6), {}
    for r in neighbours.knn(table(spark, x, ids), 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.similarity, r.vec_id))
    assert got.keys() == want.keys()
    for i, line in want.items():
        assert [j for _, j in got[i]] == [j for _, j in line] and np.allclose([s for s, _ in got[i]], [-d for d, _ in line], atol=1e-11)


def test_knn_of_fewer_rows_than_k(spark):
    got = neighbours.knn(table(spark, vectors(3, 4)), 10).groupBy("query_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 2), (1, 2), (2, 2)]


def test_memory_of_nearest_is_bounded_for_a_whole_chunk(spark):
    """A chunk of queries and a batch of rows meet in tiles, not in one matrix of both."""
    p, q, k = neighbours._unit(vectors(2048, 64)).astype(float), neighbours._unit(vectors(16384, 64, 1)).astype(float), 15
    best, names = np.full((2048, k), -np.inf), np.zeros((2048, k), np.int64)
    single = q.astype(np.float32)
    mb = peak(lambda: neighbours.nearest(np.arange(2048), p, np.arange(2048, 18432), q, best, names, single))
    assert mb < 80 and (best > 0).all()
    s = np.round(p[:50] @ q.T, 12)
    assert (np.sort(-s, axis=1)[:, :k] == -best[:50]).mean() > 0.999


def brute_density(x, ids, radius, least):
    d = np.sqrt(np.maximum(((x[:, None, :].astype(float) - x[None].astype(float)) ** 2).sum(2), 0))
    close = (d <= radius) & ~np.eye(len(x), dtype=bool)
    core = close.sum(1) >= least
    name = {a: ids[a] for a in range(len(x)) if core[a]}
    changed = True
    while changed:
        changed = False
        for a in name:
            m = min([name[a]] + [name[b] for b in np.flatnonzero(close[a]) if core[b]])
            changed, name[a] = changed or m != name[a], m
    out = {}
    for a, i in enumerate(ids):
        at = [(d[a, b], ids[b], name[b]) for b in np.flatnonzero(close[a]) if core[b]]
        out[i] = name[a] if core[a] else min(at)[2] if at else -1
    return out


def test_density_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK_BYTES", 2000)
    x = vectors(250, 2)
    ids = [500 - 2 * i for i in range(250)]
    for radius, least in ((0.15, 3), (0.3, 6), (0.05, 1), (9.0, 4), (-1.0, 1)):
        got = {r.vec_id: r.cluster for r in learning.density(table(spark, x, ids), radius, least).collect()}
        assert got == brute_density(x, ids, radius, least)


def test_density_of_values_that_single_precision_cannot_hold(spark):
    x = np.array([[1e30, 0], [1e30, 0], [1e30, 0], [2e30, 0], [0, 1], [0, 1]], np.float32)
    got = {r.vec_id: r.cluster for r in learning.density(table(spark, x), 0.5, 1).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: -1, 4: 4, 5: 4}


def test_memory_and_number_of_links_are_bounded(spark):
    """All within the radius: tiles hold a bounded number of pairs, and links are as many as rows, not pairs."""
    p, q = vectors(1024, 16).astype(float), vectors(8192, 16, 1).astype(float)
    seen = []
    mb = peak(lambda: seen.extend([sum(len(i) for i, _ in neighbours.near(p, q, 100.0))]))
    assert seen == [1024 * 8192] and mb < 100
    same = table(spark, np.ones((300, 4))).selectExpr("vec_id AS id", "transform(embedding, x -> double(x)) AS v")
    assert neighbours.links(same, 0.1).count() <= 2 * 300 * max(1, same.rdd.getNumPartitions())
