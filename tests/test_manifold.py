"""Maps against plain Python: affinities, memberships, repulsion, falling divergence, agreement of seeds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import manifold as M
from rankforge.operators.keep import stored
from rankforge.operators.neighbours import nearest


def clusters(n=300, d=8, groups=6, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, d))[np.arange(n) % groups] * 6 + rng.normal(size=(n, d))


@pytest.fixture(scope="module")
def world(spark):
    v = clusters()
    df = stored(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>").repartition(3), "v")
    return v, df, M.neighbour_graph(df, 15)


def test_affinities(world):
    v, df, graph = world
    got = {(r.i, r.j): r.p for r in M.affinities(graph, 5.0).collect()}
    far = ((v[:, None] - v[None]) ** 2).sum(2)
    p = np.zeros((300, 300))
    for i in range(300):
        near = sorted((j for j in range(300) if j != i), key=lambda j: (round(math.sqrt(far[i, j]), 6), j))[:15]
        low, high = 0.0, 1e6
        for _ in range(200):
            beta = (low + high) / 2
            e = np.exp(-beta * (far[i, near] - far[i, near].min()))
            q = e / e.sum()
            if -(q * np.log(q + 1e-300)).sum() > math.log(5.0):
                low = beta
            else:
                high = beta
        p[i, near] = q
    p = (p + p.T) / 600
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(p))} and abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got[i, j] - p[i, j]) < 1e-9 for i, j in got)


def test_memberships(world):
    v, df, graph = world
    got = {(r.i, r.j): r.w for r in M.memberships(graph).collect()}
    near = {}
    for r in graph.collect():
        near.setdefault(r.a, []).append((r.b, r.value))
    w = np.zeros((300, 300))
    for i, own in near.items():
        d = np.array([x for _, x in own])
        gap, low, high = np.maximum(d - d[d > 0].min(), 0), 0.0, 1e6
        for _ in range(200):
            sigma = (low + high) / 2
            low, high = (low, sigma) if np.exp(-gap / sigma).sum() > math.log2(len(d)) else (sigma, high)
        w[i, [j for j, _ in own]] = np.exp(-gap / max(sigma, 1e-3 * d.mean()))
    w = w + w.T - w * w.T
    assert set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(w)))) and all(abs(got[i, j] - w[i, j]) < 1e-6 for i, j in got)


def test_repulsion_of_the_grid(spark):
    rng = np.random.default_rng(5)
    for size, near in ((0.01, 0.002), (1.0, 0.01), (20.0, 0.03)):  # nodes are half a unit apart in the last
        y = rng.normal(size=(400, 2)) * size
        grid = M._grid(spark.createDataFrame([tuple(map(float, r)) for r in y], "y0 double, y1 double").repartition(3))
        z, r = grid.repulsion(y)
        gap = y[:, None] - y[None]
        w = 1 / (1 + (gap**2).sum(2))
        assert abs(z.sum() - (w.sum() - 400)) < near * (w.sum() - 400)
        exact = (w[..., None] ** 2 * gap).sum(1)
        assert np.abs(r - exact).max() < 2 * near * np.abs(exact).max()


def recall(a, b):
    return np.mean([len(a[i] & b[i]) / len(a[i]) for i in a])


def around(places, k=15):
    near = {}
    for r in nearest(places.select(F.col("i").alias("vec_id"), F.array("y0", "y1").alias("v")), k).collect():
        near.setdefault(r.a, set()).add(r.b)
    return near


def test_tsne_falls_and_seeds_agree(world):
    v, df, graph = world
    edges, ids = stored(M.affinities(graph, 5.0), "edges"), df.select(F.col("vec_id").alias("i"))
    history = []
    one = M.tsne(edges, ids, steps=32, early=11, seed=1, history=history)
    assert history[-1] < 0.6 * history[0] and history[-1] < min(history[:11])
    two = M.tsne(edges, ids, steps=32, early=11, seed=2)
    real = {i: {r.b for r in graph.where(F.col("a") == i).collect()} for i in range(0, 300, 60)}
    a, b = around(one), around(two)
    same = lambda near: np.mean([np.mean([j % 6 == i % 6 for j in near[i]]) for i in near])
    assert same(a) > 0.95 and same(b) > 0.95 and recall(a, b) > 0.3
    assert recall(real, {i: a[i] for i in real}) > 0.3


def test_umap_keeps_neighbours(world):
    v, df, graph = world
    edges, ids = stored(M.memberships(graph), "edges"), df.select(F.col("vec_id").alias("i"))
    places = stored(M.umap(edges, ids, epochs=40), "map")
    near = around(places)
    assert np.mean([np.mean([j % 6 == i % 6 for j in near[i]]) for i in near]) > 0.9
    assert M.trustworthiness(df, places, 15) > 0.5


def test_one_vector_and_none(spark):
    one = spark.createDataFrame([(1, [0.0, 1.0])], "vec_id long, v array<double>")
    for df in (one, one.where("false")):
        ids, graph = df.select(F.col("vec_id").alias("i")), M.neighbour_graph(df, 3, by_cosine=True)
        assert M.tsne(stored(M.affinities(graph, 2.0), "e"), ids, steps=2).count() == M.umap(stored(M.memberships(graph), "e"), ids, epochs=2).count() == df.count()
