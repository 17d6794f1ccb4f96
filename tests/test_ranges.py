"""Quantiles and ranks of groups of any size against numpy and sorting."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from rankforge.operators.quantiles import exact_quantiles
from rankforge.operators.ranking import rank_all


def groups(seed=5):
    rnd = random.Random(seed)
    made = {
        "hot": [rnd.gauss(0, 1) for _ in range(8_000)], "ties": [rnd.choice([1.0, 2.0]) for _ in range(501)], "one": [3.5], "same": [7.0] * 100,
        "wild": [rnd.choice([-1, 1]) * 10.0 ** rnd.randrange(-300, 300) for _ in range(300)], "edge": [-1.7e308, 1.7e308, 0.0, 5e-324], None: [1.0, 2.0, 4.0], "two": [1.0, 2.0],
    }
    return made


def test_quantiles(spark):
    rows = [(g, x, -x) for g, own in groups().items() for x in own] + [("hot", None, None), ("empty", None, 1.0)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    got = {r.g: r for r in exact_quantiles(df, ["x", "y"], ["g"], {"p25": 0.25, "mid": 0.5, "p99": 0.99}).collect()}
    assert set(got) == {*groups(), "empty"}
    for g, own in groups().items():
        for name, q in (("p25", 25), ("mid", 50), ("p99", 99)):
            with np.errstate(over="ignore"):
                want = np.percentile(own, q), np.percentile([-x for x in own], q)
            if g != "edge":
                assert math.isclose(got[g][f"x_{name}"], want[0], rel_tol=1e-12, abs_tol=1e-300) and math.isclose(got[g][f"y_{name}"], want[1], rel_tol=1e-12, abs_tol=1e-300), (g, name)
    assert got["edge"]["x_mid"] is not None and got["empty"]["x_mid"] is None and got["empty"]["y_mid"] == 1.0
    whole = exact_quantiles(df, ["x"], [], {"mid": 0.5}).collect()
    assert whole[0].x_mid == np.percentile([x for _, x, _ in rows if x is not None], 50)


def test_ranks_of_a_hot_group(spark):
    rnd = random.Random(2)
    rows = [("hot", i, round(rnd.random(), 2)) for i in range(9000)] + [(f"g{i % 50}", 10_000 + i, rnd.random()) for i in range(900)] + [(None, 1, 0.5), (None, 2, 0.7)]
    df = spark.createDataFrame(rows, "g string, chunk_id long, score double").withColumn("other", F.lit("x")).repartition(7)
    got = {(r.g, r.chunk_id): r["rank"] for r in rank_all(df, ["g"]).collect()}
    for g in {g for g, _, _ in rows}:
        own = sorted((-round(s, 6), i) for a, i, s in rows if a == g)
        assert [got[g, i] for _, i in own] == list(range(1, len(own) + 1))
    from rankforge.operators.keep import stored
    from rankforge.operators.ranking import numbered

    most = stored(df.repartitionByRange(4, F.col("g"), F.col("score"), F.col("chunk_id")).select("g", F.spark_partition_id().alias("p")), "parts").groupBy("g", "p").count().agg(F.max("count")).first()[0]
    assert most < 6000  # the hot group is spread
    assert numbered(df.where("false"), ["g"], [F.col("chunk_id")]).collect() == []
