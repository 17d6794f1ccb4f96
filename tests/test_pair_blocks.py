"""All pairs by blocks: the most and least alike, and what is summed over larger ids, against plain numpy, with equal, opposite and zero vectors."""

import numpy as np
import pytest

from rankforge.operators import pairwise as P


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((230, 5))
    x[40], x[41:60], x[60], x[200:] = 0, x[7], -x[7], x[100:130]
    ids = rng.permutation(5000)[:230] - 1000
    return dict(zip(ids.tolist(), x)), spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x)], "vec_id long, v array<double>").repartition(3)


def _cosines(x):
    size = np.linalg.norm(x, axis=1)
    return np.divide(x @ x.T, np.outer(size, size), out=np.zeros((len(x), len(x))), where=np.outer(size, size) > 0)


@pytest.mark.parametrize("rows, block", [(256, 2048), (8, 24), (5, 9)])
def test_most_and_least_alike(table, monkeypatch, rows, block):
    monkeypatch.setattr(P, "ROWS", rows)
    own, df = table
    ids = sorted(own)
    c = _cosines(np.array([own[i] for i in ids]))
    got = {r.vec_id: r for r in P.extremes(df, 5, block).collect()}
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        others = np.sort(np.delete(c[k], k))
        assert got[i]["_near"] == pytest.approx(others[::-1][:5], abs=1e-12) and got[i]["_far"] == pytest.approx(others[:5], abs=1e-12)


def test_few_others_are_all_listed(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "vec_id long, v array<double>")
    assert {len(r["_near"]) for r in P.extremes(df, 5).collect()} == {len(r["_far"]) for r in P.extremes(df, 5).collect()} == {2}


def test_only_what_may_enter_is_sorted(monkeypatch):
    """Once a row has its best, a product is looked through for what is larger; nothing of it is sorted whole."""
    rng = np.random.default_rng(1)
    c, best = rng.standard_normal((64, 3000)), np.full((64, 5), -np.inf)
    P._raised(best, np.arange(64), c[:, :1000], 0, 1)
    monkeypatch.setattr(np, "partition", None)
    for at in (1000, 2000):
        P._raised(best, np.arange(64), c[:, at : at + 1000], 0, 1)
    assert (best == -np.sort(-c, axis=1)[:, :5]).all()


@pytest.mark.parametrize("rows, block", [(256, 2048), (8, 24), (5, 9)])
def test_sums_over_larger_ids(table, monkeypatch, rows, block):
    monkeypatch.setattr(P, "ROWS", rows)
    monkeypatch.setattr(P.pd.DataFrame, "groupby", None)  # sums are taken of matrices, not of a frame with a row for each pair
    own, df = table
    ids = sorted(own)
    x = np.array([own[i] for i in ids])
    c, d = _cosines(x), np.linalg.norm(x[:, None] - x[None], axis=2)
    got = {r.a: r for r in P.by_smaller(df, block).collect()}
    assert sorted(got) == ids[:-1]
    for k, i in enumerate(ids[:-1]):
        r, later = got[i], slice(k + 1, None)
        assert r.n == len(ids) - 1 - k
        assert (r.cosine, r.most_cosine) == pytest.approx((c[k, later].sum(), c[k, later].max()), abs=1e-9)
        assert (r.euclidean, r.most_euclidean) == pytest.approx((d[k, later].sum(), d[k, later].max()), abs=1e-5)
