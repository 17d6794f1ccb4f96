"""Vectors travel once for each wide block, not for each product inside it; answers stay those of whole matrices."""

import numpy as np
import pytest

from rankforge.operators import neighbours as N
from rankforge.operators import pairwise as P

from test_neighbours import check, clustered


def test_neighbours_by_runs_of_blocks(spark, monkeypatch):
    for name, value in {"PART": 40, "BLOCK": 20, "WIDE": 4, "SIDES": 2}.items():
        monkeypatch.setattr(N, name, value)
    rows = [(i, x.tolist()) for i, x in enumerate(np.round(clustered(200, 5, 6), 1))] + [(1000 + i, [1.0] * 5) for i in range(90)]
    check(spark, rows, 4)
    noise = [(i, x.tolist()) for i, x in enumerate(np.random.default_rng(2).normal(size=(240, 20)))]
    check(spark, noise, 3)
    parts = N.Parts(spark.createDataFrame(noise, "vec_id long, v array<double>"), 3)
    assert parts.run_visits().count() <= 240 * 4 < parts.visits().count()


def test_block_pairs_by_products(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    monkeypatch.setattr(P, "WIDE", 3)
    monkeypatch.setattr(P, "SIDES", 2)
    rng = np.random.default_rng(6)
    x, label = rng.normal(size=(90, 4)), rng.integers(0, 3, 90)
    df = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, label))], "vec_id long, v array<double>, label long")
    assert P._block_pairs(df, ["v"], 7).count() == 90 * 5  # 13 products to a side
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(90):
        mean = {c: far[i, (label == c) & (np.arange(90) != i)].mean() for c in range(3)}
        inside, outside = mean.pop(label[i]), min(v for c, v in mean.items() if c != label[i])
        s.append((outside - inside) / max(inside, outside))
    assert P.silhouette(df).first()["silhouette"] == pytest.approx(np.mean(s), abs=1e-9)
    c = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None])
    for r in P.extremes(df, 5, 7).collect():
        own = np.sort(np.delete(c[r.vec_id], r.vec_id))
        assert r._near == pytest.approx(own[::-1][:5]) and r._far == pytest.approx(own[:5])
    at, to = np.triu_indices(90, 1)
    m = P.moments(df).first()
    assert (m["n"], m["d"], m["c"]) == (len(at), pytest.approx(far[at, to].sum()), pytest.approx(c[at, to].sum()))
    assert sum(r.n for r in P.by_smaller(df).collect()) == len(at)
