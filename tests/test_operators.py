"""Exact expectations on tiny tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.functions import text as T
from rankforge.functions import vectors as V
from rankforge.operators import evaluate as E
from rankforge.operators import fusion as N
from rankforge.operators import pairwise
from rankforge.operators import lexical as L
from rankforge.operators.graph import pagerank


def index(spark, queries, chunks):
    rows = lambda items, name: spark.createDataFrame(list(enumerate(items)), f"{name} long, text string").select(name, T.tokenize(F.col("text")).alias("tokens"))
    return L.Index(rows(queries, "query_id"), rows(chunks, "chunk_id"))


def scores(df):
    return {(r["query_id"], r["chunk_id"]): r["score"] for r in df.collect()}


def test_tokenize_keeps_accents(spark):
    row = spark.createDataFrame([("El paciente presenta SÍNTOMAS, de hipoxemia_2.",)], "t string").select(T.tokenize(F.col("t"))).first()
    assert row[0] == ["el", "paciente", "presenta", "síntomas", "de", "hipoxemia_2"]


def test_ordered_pairs_and_reversal(spark):
    i = index(spark, ["a b c d"], ["x a b y c d", "d c b a", ""])
    s = scores(L.mrf_ordered(i))
    assert s[0, 0] == pytest.approx(2 / 3) and s[0, 1] == 0 and s[0, 2] == 0


def test_unordered_window(spark):
    i = index(spark, ["a b"], ["a 1 2 3 4 5 b", "a 1 2 3 4 5 6 7 8 b"])
    s = scores(L.mrf_unordered(i, 8))
    assert s[0, 0] == 1 and s[0, 1] == 0
    assert scores(L.mrf_unordered(i, 4))[0, 0] == 0


def test_likelihood_floor_and_unknown_terms(spark):
    chunks = ["rare word here", " ".join(["w"] * 4000), ""]
    i = index(spark, ["rare w", "unknown"], chunks)
    s = scores(L.qlm_dirichlet(i, mu=0.5))
    total, cf = 4003, {"rare": 1, "w": 4000}
    for c, text in enumerate(chunks):
        own = text.split()
        want = sum(math.log(max((own.count(t) + 0.5 * cf[t] / total) / (len(own) + 0.5), 1e-6)) for t in cf) if own else 0.0
        assert s[0, c] == pytest.approx(want)
        assert s[1, c] == 0


def test_zscore_constant_clip_and_minmax(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 0.0), (2, 10.0)], "query_id int, s double")
    both = df.select("query_id", F.col("s").alias("z"), F.col("s").alias("m"))
    rows = N.minmax(N.zscore(both, ["z"], ["query_id"], 0.5), ["m"], ["query_id"]).collect()
    assert [r["z"] for r in rows if r["query_id"] == 1] == [0, 0] and [r["m"] for r in rows if r["query_id"] == 1] == [0.5, 0.5]
    assert sorted(r["z"] for r in rows if r["query_id"] == 2) == [-0.5, 0.5] and sorted(r["m"] for r in rows if r["query_id"] == 2) == [0, 1]
    with pytest.raises(ValueError):
        N.normalize_all(df, ["s"], ["query_id"], "nothing")


def test_pagerank_disconnected_and_single():
    none = np.zeros(0, int)
    assert pagerank(none, none, np.zeros(0), np.array([1.0]), 0.85, 1e-6, 100)[0] == 1
    p = pagerank(none, none, np.zeros(0), np.array([1.0, 0, 0]), 0.85, 1e-6, 100)
    assert p[0] == 1 and p[1] == p[2] == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, c, r) for r, c in enumerate([5, 7, 9], 1)], "query_id long, chunk_id long, rank int")
    relevant = spark.createDataFrame([(1, 7), (1, 8)], "query_id long, chunk_id long")
    m = {r["k"]: r for r in E.metrics_at_k(ranked, relevant, (1, 3)).collect()}
    assert m[1]["recall"] == 0 and m[3]["recall"] == 0.5 and m[3]["precision"] == pytest.approx(1 / 3) and m[3]["mrr"] == 0.5
    assert m[3]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def test_dtw_against_recurrence(spark):
    a, b = [0.0, 1.0, 3.0, 2.0], [0.0, 2.0, 2.0]
    d = np.full((5, 4), np.inf)
    d[0, 0] = 0
    for i in range(4):
        for j in range(3):
            d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    rows = [(1, 2, a, b), (1, 3, a, a), (2, 1, b, a), (4, 5, [], a), (4, 6, [], [])]
    got = {(r["a"], r["b"]): r["distance"] for r in pairwise.dtw(spark.createDataFrame(rows, "a long, b long, x array<double>, y array<double>")).collect()}
    assert got[1, 2] == got[2, 1] == pytest.approx(d[4, 3]) and got[1, 3] == got[4, 6] == 0 and got[4, 5] == float("inf")


def test_entry_points_load():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
