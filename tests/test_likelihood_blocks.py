"""Likelihoods of every query and chunk are made where the chunks are: right at any smoothing, and no pair is exchanged."""

import math
from collections import Counter

import pytest

from rankforge.operators import lexical as L


@pytest.mark.parametrize("mu", [0.5, 1500.0])
def test_every_pair_without_an_exchange(spark, mu):
    docs = {1: ["a", "b", "a"], 2: [], 3: ["c"] * 40 + ["a"], 4: ["z"] * 3000 + ["b"], 9: ["q", "z"]}
    asked = {7: ["a", "a", "c"], 8: ["nowhere"], 9: [], 11: ["b", "nowhere", "q"]}
    index = L.Index(spark.createDataFrame(list(asked.items()), "query_id long, tokens array<string>"), spark.createDataFrame(list(docs.items()), "chunk_id long, tokens array<string>"))
    made = L.qlm_dirichlet(index, mu)
    cf = Counter(t for own in docs.values() for t in own)
    total = sum(cf.values())
    got = {(r.query_id, r.chunk_id): r.score for r in made.collect()}
    assert len(got) == len(docs) * len(asked)
    for q, words in asked.items():
        for c, own in docs.items():
            tf = Counter(own)
            want = sum(math.log(max((tf[t] + mu * cf[t] / total) / (len(own) + mu), 1e-6)) for t in words if cf[t]) if own else 0.0
            assert got[q, c] == pytest.approx(want, abs=1e-9), (q, c)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
