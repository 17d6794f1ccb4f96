"""Noise is worked out where it is compared: numpy's hashes are Spark's, and vectors made on the way rank as stored ones do."""

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from rankforge.operators import blocks
from rankforge.operators import expand as X


def test_draws_are_spark_s_hashes(spark):
    ids, i = np.array([0, 1, 7, -3, 1 << 40, 100_051_281]), np.arange(5, dtype=np.int32)
    keys = ["a", "doc:uniform:100:0/1", "doc:extreme_sequential:800:2/1/sign/r", "x" * 32, "é" * 21]
    df = spark.createDataFrame([(int(k), int(j)) for k in ids for j in i], "vec_id long, i int")
    for key in keys:
        want = [r[0] for r in df.select((F.pmod(F.xxhash64(F.lit(key), "vec_id", "i"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)).collect()]
        assert X.Noise(key, i, ids, {}).uniform(key).ravel().tolist() == want


def test_odd_rows_keep_their_vectors(spark):
    """No vector, several lengths, an unknown element: the vector stays as it is, noise of an unknown statistic is unknown."""
    rows = [(1, 0, [1.0, 2.0]), (2, 0, None), (3, 0, [1.0, None, 3.0]), (4, 0, [4.0])]
    df = X.described(spark.createDataFrame(rows, "vec_id long, label int, v array<double>"), neighbours=False).coalesce(1)
    for family, known in (("extreme_cluster", True), ("uniform", False)):
        dims, scale = X.FAMILIES[family][0][0]
        got = {r.vec_id: r.v for r in X.expand(df, family, dims, scale).collect()}
        alone = {r.vec_id: r.v for r in X.expand(df.where("vec_id in (1, 4)").repartition(2), family, dims, scale).collect()}
        assert got[2] is None and got[1][:2] == [1.0, 2.0] and got[3][:3] == [1.0, None, 3.0] and got[4][0] == 4.0
        assert {1: got[1], 4: got[4]} == alone and len(got[3]) == 3 + dims and all((x is not None) == known for x in got[3][3:])


def test_vectors_made_where_they_are_compared(spark):
    rng = np.random.default_rng(3)
    rows = X.described(spark.createDataFrame([(i, i % 2, r.tolist()) for i, r in enumerate(rng.standard_normal((120, 6)))], "vec_id long, label int, v array<double>")).cache()
    stored, made = {}, {}
    for family in ("uniform", "ultra_balance", "final_progressive"):
        dims, scale = X.FAMILIES[family][0][0]
        stored[family], made[family] = X.expand(rows, family, dims, scale), (rows, partial(X.expanded, draw=X.noise(family, dims, scale)))
    vectors = {k: {r.vec_id: np.array(r.v) for r in df.collect()} for k, df in stored.items()}
    near = {k: {i: v[i] + 0.9 * v[i + 1] for i in range(0, 120, 10)} for k, v in vectors.items()}
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    asked = spark.createDataFrame([(k, i, q.tolist(), cos(q, vectors[k][i])) for k, own in near.items() for i, q in own.items()], "group string, vec_id long, v array<double>, own double")
    want = {}
    for k, own in near.items():
        for i, q in own.items():
            s = {j: round(cos(q, v), 6) for j, v in vectors[k].items()}
            want[k, i] = 1 + sum((x, -j) > (s[i], -i) for j, x in s.items())
    for groups in (stored, made):
        assert {(r["group"], r["query_id"]): r["position"] for r in blocks.position_of_own(asked, groups, 20_000).collect()} == want
