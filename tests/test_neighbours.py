"""Nearest neighbours against whole matrices: clusters, no structure, ties, hot parts; and what pruning leaves out."""

import numpy as np
import pytest

from rankforge.operators import neighbours as N


def brute(rows, k):
    ids, x = np.array([i for i, v in rows if v is not None]), np.array([v for _, v in rows if v is not None])
    far = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 0))
    out = {}
    for i, a in enumerate(ids):
        own = sorted((round(far[i, j], 6), b) for j, b in enumerate(ids) if b != a)[:k]
        out |= {(a, b): (r + 1, d) for r, (d, b) in enumerate(own)}
    return out


def check(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(4)
    got = {(r.a, r.b): (r["rank"], r.value) for r in N.nearest(df, k).collect()}
    want = brute(rows, k)
    assert {p: r for p, (r, _) in got.items()} == {p: r for p, (r, _) in want.items()}
    assert all(abs(got[p][1] - want[p][1]) < 2e-6 for p in want)


def clustered(n, d, groups, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 10
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.3


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(N, "PART", 40)
    monkeypatch.setattr(N, "BLOCK", 60)


def test_clusters_ties_nulls_and_a_hot_part(spark, small):
    v = np.round(clustered(400, 6, 9), 1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, [1.0] * 6) for i in range(200)] + [(2000, None), (2001, [1e6] * 6)]
    check(spark, rows, 4)


def test_without_structure_and_few(spark, small):
    rng = np.random.default_rng(3)
    check(spark, [(i, x.tolist()) for i, x in enumerate(rng.uniform(size=(300, 10)))], 3)
    check(spark, [(1, [0.0, 1.0]), (2, [0.0, 2.0])], 5)
    assert N.nearest(spark.createDataFrame([(1, [0.0])], "vec_id long, v array<double>"), 2).collect() == []
    assert N.nearest(spark.createDataFrame([(1, None)], "vec_id long, v array<double>"), 2).collect() == []


def test_pruning(spark, small):
    share = lambda v: N.visited_share(N.Parts(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<double>"), 3)).first().share
    assert share(clustered(600, 16, 12)) < 0.45
    assert share(np.random.default_rng(4).normal(size=(600, 64))) > 0.9
