"""The full graph queries on a fixture, against a plain power iteration."""

import numpy as np
import pandas as pd

from rankforge.plans.graphs import nodes
from rankforge.plans.registry import queries


def test_full_graph_and_ranks(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    docs = pd.DataFrame({"doc_id": range(130), "source": [f"s{i % 3}" for i in range(130)], "text": [" ".join(rng.choice(words, 30)) for _ in range(130)]})
    docs.to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"item_id": [1, 2], "text": ["w1 w2 w3 w4", "w7 w8 w9"]}).to_parquet(tmp_path / "benchmark.parquet")
    pd.DataFrame({"vec_id": range(130), "embedding": [x.tolist() for x in rng.standard_normal((130, 64)).astype("float32")], "label": [0] * 130}).to_parquet(tmp_path / "embeddings.parquet")
    q = queries()
    ask = lambda name: q[name](spark, str(tmp_path)).toPandas()
    edges, scores, ranks = ask("build_graph"), ask("ppr"), ask("rerank")
    for query_id, own in scores.groupby("query_id"):
        ids = sorted(own["chunk_id"])
        assert len(ids) == 100
        w = np.zeros((100, 100))
        for r in edges[edges["query_id"] == query_id].itertuples():
            w[ids.index(r.dst), ids.index(r.src)] = r.weight
        got = own.set_index("chunk_id")["score"].loc[ids].to_numpy()
        seeds = {r["chunk_id"] for r in nodes(spark, str(tmp_path), 3).where(f"query_id = {query_id}").collect()}
        restart = np.array([1 / 3 if i in seeds else 0.0 for i in ids])
        p = restart.copy()
        for _ in range(2000):
            p = 0.15 * restart + 0.85 * w @ p
            p /= p.sum()
        assert np.abs(got - p).max() < 5e-6
    assert ranks.groupby("query_id").size().tolist() == [30, 30]
