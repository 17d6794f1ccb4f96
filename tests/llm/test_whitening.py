"""Whitening against whole matrices in numpy and exact integers in Python."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from rankforge.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(spark, rows, k=32):
    out = {}
    for r in whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), k).collect():
        out.setdefault(r.vec_id, []).append(r)
    return {i: sorted(rs, key=lambda r: r.component) for i, rs in out.items()}


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.linspace(0.2, 3, d)).astype(np.float32)


def test_against_whole_matrices(spark):
    v = vectors(400, 40)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(1000, None, 1), (1001, [float("nan")] + [0.0] * 39, 1), (1002, [float("inf")] + [0.0] * 39, 1), (1003, [None] + [0.0] * 39, 1), (1004, [1.0] * 7, 1), (1005, [], 1)]
    got = made(spark, rows)
    assert sorted(got) == list(range(400))
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r] for r in v], dtype=np.int64)
    sums, n = x.sum(0), len(x)
    centred = x - sums / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    for i in range(400):
        assert [r.component for r in got[i]] == list(range(1, 33)) and {r.n for r in got[i]} == {n}
        assert {r.deviation for r in got[i]} == {int(((n * x[i].astype(object) - sums.astype(object)) ** 2).sum())}
        want = centred[i] @ q[:, :32] / np.sqrt(e[:32])
        assert np.allclose(np.abs([r.whitened for r in got[i]]), np.abs(want), atol=1e-8)
        assert np.allclose([r.explained for r in got[i]], e[:32] / e.sum(), rtol=1e-9)
    w = np.array([[r.whitened for r in got[i]] for i in range(400)])
    error = np.abs(np.cov(w.T, bias=True) - np.eye(32)).max()
    assert error < 1e-9 and abs(got[0][0].identity_error - error) < 1e-9
    signs = np.sign(w * (centred @ q[:, :32]))
    assert (np.abs(signs.sum(0)) == 400).all()  # one sign for all rows


def test_few_dimensions_repeats_null_ids_and_clashes(spark):
    v = vectors(60, 3)
    rows = [(i % 50, x.tolist(), 0) for i, x in enumerate(v)] + [(None, v[0].tolist(), 0)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("_id"), F.lit(2).alias("_v"), F.lit("x").alias("component"), F.lit("y").alias("whitened"))
    got = whiten(df).collect()
    assert len(got) == 61 * 3 and sum(r.vec_id is None for r in got) == 3 and {r.n for r in got} == {61}


def test_without_variance(spark):
    same = made(spark, [(i, [1.0, 2.0], 0) for i in range(10)])
    assert len(same) == 10 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for rs in same.values() for r in rs)
    v = vectors(50, 2)
    flat = made(spark, [(i, [float(a), float(b), 5.0, float(a)], 0) for i, (a, b) in enumerate(v)])
    assert all([r.whitened is None for r in rs] == [False, False, True, True] and rs[0].identity_error < 1e-9 for rs in flat.values())
    assert made(spark, []) == {} and made(spark, [(1, None, 0)]) == {}


def test_deviations_are_exact_however_large(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) * 10 ** rnd.randrange(0, 12) for _ in range(4)], 0) for i in range(40)] + [(99, [3e38, 0.0, 0.0, -3e38], 0)]
    got = made(spark, rows)
    cast = lambda c: max(-(2**63), min(2**63 - 1, math.floor(64 * float(np.float32(c))) + 1_000_000))
    x = {i: [cast(c) for c in v] for i, v, _ in rows}
    n, sums = len(rows), [sum(c) for c in zip(*x.values())]
    for i, own in x.items():
        want = sum((n * c - s) ** 2 for c, s in zip(own, sums))
        assert got[i][0].deviation == (want if want < 2**63 else None)
