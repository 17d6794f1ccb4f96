"""Experiments: noise families against their theory, components, clusters, paths, histories; files with odd bytes."""

import math
from collections import deque

import numpy as np
import pytest

from rankforge.operators import expand as X
from rankforge.operators import graph as G
from rankforge.operators import learning, pairwise
from rankforge.operators.ranking import first_position
from rankforge.sources import files


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(16) + 3 * (i % 3 == np.arange(16) % 3)], i % 3) for i in range(60)]
    return spark.createDataFrame(rows, "vec_id long, v array<double>, label int").repartition(3).cache()


def test_every_family_keeps_the_vector_and_repeats(spark, vectors):
    rows = X.described(vectors).cache()
    before = {r["vec_id"]: r for r in rows.collect()}
    spreads = {}
    for family, (configs, _, _) in X.FAMILIES.items():
        dims, scale = configs[0]
        got, again = ({r["vec_id"]: r["v"] for r in X.expand(d, family, dims, scale).collect()} for d in (rows, rows.repartition(5)))
        assert got == again and all(len(v) == 16 + dims and v[:16] == before[i]["v"] for i, v in got.items())
        spreads[family] = {i: np.array(v[16:]) for i, v in got.items()}
    for i, r in before.items():
        sd, flat = r["_sd"], lambda half: half * half / 3
        own = spreads["extreme_uniform"][i]
        assert own.var() == pytest.approx(flat(0.8) + flat(0.5 * sd) + flat(0.4), rel=0.35) and abs(own.mean()) < 0.3
        assert spreads["uniform"][i].mean() == pytest.approx(r["_mean"], abs=0.25) and np.abs(spreads["uniform"][i] - r["_mean"]).max() <= 0.3 * sd + 1e-9
        near = spreads["ultra_semantic"][i].var()
        assert near == pytest.approx(flat(0.15) + sum(flat(0.09) * (0.5 * s) ** 2 for s in r["_near"][:3]), rel=0.4)
    both = np.corrcoef(spreads["gaussian"][1], spreads["gaussian"][2])[0, 1]
    assert abs(both) < 0.35


def test_neighbours_are_the_most_alike(vectors):
    rows = {r["vec_id"]: np.array(r["v"]) for r in vectors.collect()}
    unit = {i: v / np.linalg.norm(v) for i, v in rows.items()}
    for r in pairwise.extremes(vectors, 5, block=16).collect():
        c = sorted((float(unit[r["vec_id"]] @ u) for j, u in unit.items() if j != r["vec_id"]), reverse=True)
        assert r["_near"] == pytest.approx(c[:5]) and r["_far"] == pytest.approx(c[::-1][:5])


def test_components_and_clusters(spark, vectors):
    rows = sorted(vectors.collect())
    x = np.array([r["v"] for r in rows])
    made, shares = X.pca(vectors, 4)
    centred = x - x.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred)
    assert shares == pytest.approx(values[::-1][:4] / values.sum())
    got = np.array([r["v"] for r in sorted(made.select("vec_id", "v").collect())])
    assert np.abs(got) == pytest.approx(np.abs(centred @ axes[:, ::-1][:, :4]), abs=1e-8)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    label = np.array([r["label"] for r in rows])
    s = []
    for i in range(len(x)):
        inside = d[i][(label == label[i]) & (np.arange(len(x)) != i)].mean()
        outside = min(d[i][label == k].mean() for k in set(label) if k != label[i])
        s.append((outside - inside) / max(inside, outside))
    assert pairwise.silhouette(vectors).first()["silhouette"] == pytest.approx(np.mean(s))
    assert X.kmeans(vectors, 3).select("cluster").distinct().count() == 3


def test_principal_components_of_standardised_vectors(spark, vectors):
    rows = sorted(vectors.collect())
    x = np.array([r["v"] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    made = X.principal(X.standard_scale(vectors.select("vec_id", "v")), 6)
    _, singular, axes = np.linalg.svd(z, full_matrices=False)
    assert made.deviations == pytest.approx(singular[:6] / math.sqrt(len(x) - 1)) and made.shares == pytest.approx(singular[:6] ** 2 / (singular**2).sum())
    assert np.abs(np.sum(made.axes * axes[:6], 1)) == pytest.approx(1) and (made.axes[np.arange(6), np.abs(made.axes).argmax(1)] > 0).all()
    few = X.principal(spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "vec_id long, v array<double>"), 2)  # no variance at all
    assert few.shares.tolist() == [0, 0] and few.deviations.tolist() == [0, 0]


def test_reductions_and_expansions_find_their_own(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((150, 24))
    spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    from rankforge.plans import registry

    got = {r["dims"]: r for r in registry.queries()["pca_reductions"](spark, str(tmp_path)).collect()}
    c = x - x.mean(0)
    _, s, axes = np.linalg.svd(c, full_matrices=False)
    assert sorted(got) == [2, 5, 10, 15]
    for d, r in got.items():
        assert r["explained"] == pytest.approx((s[:d] ** 2).sum() / (s**2).sum(), abs=1e-5) and r["n"] == 3
        p = c @ axes[:d].T
        p /= np.linalg.norm(p, axis=1, keepdims=True)
        places = [1 + int((np.round(p @ p[q], 6) > round(float(p[q] @ p[q]), 6)).sum() + (np.round(p @ p[q], 6)[:q] == 1).sum()) for q in (0, 50, 100)]
        assert r["mrr"] == pytest.approx(np.mean([1 / k for k in places]), abs=1e-6)
    # Expanded queries against expanded vectors: the places that numpy finds in the same vectors.
    from rankforge.plans import experiments

    rows = experiments.described(spark, str(tmp_path))
    docs, queries = ({(r["config"], r["vec_id"]): (r["label"], np.array(r["v"])) for r in experiments.configurations(*a).collect()} for a in ((rows,), (rows.where("vec_id % 50 = 0"), "query")))
    want = {}
    for (config, q), (label, v) in queries.items():
        cos = {i: round(float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)), 6) for (k, i), (_, u) in docs.items() if k == config}
        place = 1 + sum((s, -i) > (cos[q], -q) for i, s in cos.items())
        want.setdefault((config, "ca" if label % 2 == 0 else "es"), []).append(place)
    got = {(r["config"], r["lang"]): r for r in registry.queries()["expansion_eval"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for k, places in want.items():
        assert (got[k]["n"], got[k]["mrr"]) == (len(places), pytest.approx(np.mean([1 / p for p in places]), abs=2e-2 / len(places)))


def test_average_path_against_a_search(spark):
    rng = np.random.default_rng(6)
    edges = {(a, b) for a in range(30) for b in (int(rng.integers(0, 30)), (a + 1) % 30) if a != b}
    nodes = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 1), (2, 2)], "query_id long, chunk_id long")
    links = spark.createDataFrame([(1, a, b, 1.0) for a, b in edges], "query_id long, src long, dst long, weight double")
    got = {r["query_id"]: r["average_path"] for r in G.average_path(nodes, links).collect()}
    total = 0
    for start in range(30):
        far, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for a, b in edges:
                if a == at and b not in far:
                    far[b] = far[at] + 1
                    queue.append(b)
        assert len(far) == 30
        total += sum(far.values())
    assert got[1] == pytest.approx(total / (30 * 29)) and got[2] is None


def test_history_weights_against_a_loop(spark):
    rng = np.random.default_rng(7)
    groups = list(learning.GROUP_LENGTH)
    patterns = [(f"{g}_{m}", g, m, False, False) for g in groups for m in (True, False)]
    own = [patterns[int(rng.integers(0, len(patterns)))] for _ in range(90)]
    rows = [(i, p[0], {"short": 2, "medium": 5, "long": 9}[p[1]], 5.5, p[2], False, False) for i, p in enumerate(own)]
    ok = [(i, int(rng.random() < 0.6), int(rng.random() < 0.3)) for i in range(90) if i % 5]
    f = spark.createDataFrame(rows, "query_id long, pattern string, n_words int, mean_length double, has_medical boolean, has_question boolean, has_technical boolean")
    p = spark.createDataFrame(patterns, "pattern string, group string, has_medical boolean, has_question boolean, has_technical boolean")
    got = {r["query_id"]: r for r in learning.history_weights(f, p, spark.createDataFrame(ok, "query_id long, mrf int, emb int")).collect()}
    close, won = lambda a, b: 1 - abs(a - b) / max(a, b, 1), {i: (m, e) for i, m, e in ok}
    for i, _, n, mean, med, *_ in rows:
        seen = []
        for name, g, m, *_ in patterns:
            if 0.4 * close(n, learning.GROUP_LENGTH[g]) + 0.4 * ((med == m) + 2) / 3 + 0.2 * close(mean, 5.0) > 0.7:
                seen += [won.get(j, (0, 0)) for j in range(i) if own[j][0] == name][-10:]
        m, e = sum(x[0] for x in seen), sum(x[1] for x in seen)
        a, b = (min(0.8, max(0.2, x / (m + e) if m + e else 0.5)) for x in (m, e))
        assert got[i]["n_similar"] == len(seen) and got[i]["mrf_weight"] == pytest.approx(a / (a + b)) and got[i]["emb_weight"] == pytest.approx(b / (a + b))


def test_first_position_counts_ties(spark):
    scores = spark.createDataFrame([(1, c, s) for c, s in enumerate([5.0, 7.0, 7.0, 7.0, 1.0])] + [(2, 1, 0.0)], "query_id long, chunk_id long, score double")
    relevant = spark.createDataFrame([(1, 3), (1, 4), (2, 1), (3, 9)], "query_id long, chunk_id long")
    assert {r["query_id"]: r["position"] for r in first_position(scores, relevant, ["query_id"]).collect()} == {1: 3, 2: 1}


def test_odd_bytes_and_configurations(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    (d / "a.txt").write_bytes(b"\xef\xbb\xbf" + "niño con más de tres palabras".encode())
    (d / "b.txt").write_bytes("año nuevo y más palabras aquí".encode("latin-1"))
    (d / "c.txt").write_bytes(b"short")
    got = {r["doc"]: r["text"] for r in files.read_text_dir(spark, str(d), least_chars=10, least_words=4).collect()}
    assert got == {"a.txt": "niño con más de tres palabras", "b.txt": "año nuevo y más palabras aquí"}
    for bad in ({"nothing": 1}, {"fusion": {"a": 0.5}}, {"k": 30, "k_prime": 10}):
        files.save_config(spark, bad, str(tmp_path / "c"))
        with pytest.raises(ValueError):
            files.load_config(spark, str(tmp_path / "c"), {"k": 3, "k_prime": 10, "fusion": {"a": 1.0}})
    assert math.isclose(files.models(spark.createDataFrame([("/x/kind/model-0_0029",), ("/x/other",)], "path string")).first()["number"], 0.0029)


def test_query_noise_of_every_family(spark):
    """Bounds, middles and deviations of what queries draw, section by section."""
    from rankforge.operators import expand as X

    rng = np.random.default_rng(8)
    rows = [(i, 0, rng.normal(0.2, 0.5, 16).tolist()) for i in range(12)]
    df = X.described(spark.createDataFrame(rows, "vec_id long, label int, v array<double>"), neighbours=False)
    sd = lambda half: half / np.sqrt(3)
    flat = {"extreme_uniform": 1, "extreme_cluster": 1, "extreme_adaptive": 1.5, "ultra_semantic": 0.5, "ultra_progressive": 0.6, "ultra_document": 0.7, "ultra_balance": 0.6, "ultra_cluster": 0.8, "ultra_sequential": 0.7, "ultra_hybrid": 0.8, "ultra_max": 0.9, "final_similarity": 0.3, "final_fingerprint": 0.5, "final_progressive": 0.6, "final_balance": 0.4, "final_content": 0.7}
    wanted = {k: [(c, sd(c))] for k, c in flat.items()}
    wanted |= {"extreme_gaussian": [(None, 1)], "extreme_hybrid": [(1.2, sd(1.2)), (None, 1.1), (None, np.sqrt(2))], "extreme_sequential": [(1, sd(1)), (None, 1.1), (None, 0.8 * np.sqrt(2)), (1.5, sd(1.5))]}
    assert {*wanted, "uniform", "gaussian", "mixed"} == set(X.FAMILIES) == set(X.QUERY_KERNELS)
    for family, sections in wanted.items():
        dims, scale = X.FAMILIES[family][0][0]
        got = {r.vec_id: np.array(r.v) for r in X.expand(df, family, dims, scale, "query").collect()}
        assert all(len(v) == 16 + dims and (v[:16] == rows[i][2]).all() for i, v in got.items())
        noise, each = np.array([v[16:] for v in got.values()]), dims // len(sections)
        for k, (most, spread) in enumerate(sections):
            own = noise[:, k * each : dims if k == len(sections) - 1 else (k + 1) * each]
            assert most is None or np.abs(own).max() <= most * scale
            assert abs(own.std() - spread * scale) < 0.08 * spread * scale and abs(own.mean()) < 0.1 * spread * scale
    for family in ("uniform", "gaussian", "mixed"):
        dims, scale = X.FAMILIES[family][0][0]
        for r in X.expand(df, family, dims, scale, "query").collect():
            v = np.array(rows[r.vec_id][2])
            noise = np.array(r.v)[16:]
            assert abs(noise.mean() - v.mean()) < 0.5 * v.std() * scale and noise.std() < 1.3 * v.std() * scale  # the mean of 100 draws strays by a tenth
            if family != "gaussian":
                assert np.abs(noise[: dims // 2] - v.mean()).max() <= v.std() * scale + 1e-12
