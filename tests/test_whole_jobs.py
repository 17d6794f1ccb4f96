"""Whole jobs: every configuration of the expansions is evaluated; t-SNE goes through all its steps, in blocks as in plain Python."""

import math

import numpy as np

from rankforge.operators import expand as X
from rankforge.operators import manifold as M
from rankforge.operators.keep import stored
from rankforge.plans import experiments, registry


def test_every_configuration_is_evaluated(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((60, 6))
    spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    wanted = {f"{family}_{dims}": dims for family, (configs, _, _) in X.FAMILIES.items() for dims, _ in configs}
    assert len(wanted) == 29  # scripts/*_discriminator.py and aggressive_dimensional_expander.py of the reference: 8, 8, 8 and 5
    assert {c for c, *_ in experiments.configured()} == set(wanted)
    asked = {(r["config"], r["vec_id"]): len(r["v"]) for r in registry.queries()["expand_query"](spark, str(tmp_path)).collect()}
    assert asked == {(c, q): 6 + dims for c, dims in wanted.items() for q in (0, 50)}
    got = {(r["config"], r["lang"]): r["n"] for r in registry.queries()["expansion_eval"](spark, str(tmp_path)).collect()}
    assert got == {(c, "ca"): 2 for c in wanted}


def _plain(p, y, steps, early, rate):
    """Exact t-SNE: divergences before each step, and the last places."""
    speed, gain, history = np.zeros_like(y), np.ones_like(y), []
    for t in range(steps):
        more, momentum = (12.0, 0.5) if t < early else (1.0, 0.8)
        gap = y[:, None] - y[None]
        w = 1 / (1 + (gap**2).sum(2))
        np.fill_diagonal(w, 0)
        history.append((p[p > 0] * np.log(p[p > 0] * w.sum() / w[p > 0])).sum())
        slope = 4 * ((more * p - w / w.sum()) * w)[..., None]
        slope = (slope * gap).sum(1)
        gain = np.maximum(0.01, np.where(slope * speed < 0, gain + 0.2, gain * 0.8))
        speed = momentum * speed - rate * gain * slope
        y = y + speed
    return history, y


def test_steps_in_blocks_are_those_of_plain_python(spark, monkeypatch):
    """Several blocks, some without edges of their own; checkpoints between the steps; an id that repeats."""
    monkeypatch.setattr(M, "NARROW", 20)
    rng = np.random.default_rng(6)
    ids = [int(i) for i in rng.permutation(10_000)[:90]]
    near = {i: {ids[j] for j in rng.integers(0, 80, 5)} - {i} for i in ids[:80]}
    pairs = {(i, j) for i, js in near.items() for j in js} | {(j, i) for i, js in near.items() for j in js}
    edges = stored(spark.createDataFrame([(i, j, 1 / len(pairs)) for i, j in pairs], "i long, j long, p double"), "edges")
    table, history = spark.createDataFrame([(i,) for i in [*ids, ids[0]]], "i long").repartition(3), []
    got = M.tsne(edges, table, steps=25, early=8, history=history).collect()
    start = {r.i: (r.y0, r.y1) for r in M._start(table, 1, 1e-2).collect()}
    at, p = {i: k for k, i in enumerate(ids)}, np.zeros((90, 90))
    for i, j in pairs:
        p[at[i], at[j]] = 1 / len(pairs)
    wanted, y = _plain(p, np.array([start[i] for i in ids]), 25, 8, 10.0)
    assert np.abs(np.array(history) - wanted).max() < 0.02 and len(got) == 91
    found = np.array([next((r.y0, r.y1) for r in got if r.i == i) for i in ids])
    assert np.corrcoef(found.ravel(), y.ravel())[0, 1] > 0.99


def test_tsne_takes_all_its_steps_and_neighbours(spark, tmp_path, monkeypatch):
    """1000 steps, 250 of them exaggerated, over 3 x 30 + 1 neighbours, as the reference's library does."""
    rng, asked = np.random.default_rng(7), {}
    x = rng.standard_normal((5, 8))[np.arange(110) % 5] * 5 + rng.standard_normal((110, 8))
    spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    graph, tsne = M.neighbour_graph, M.tsne

    def counted(edges, ids, **given):
        asked.update(given)
        return tsne(edges, ids, **(given | {"steps": 2}))

    monkeypatch.setattr(M, "neighbour_graph", lambda v, k: asked.setdefault("graph", graph(v, k)))
    monkeypatch.setattr(M, "tsne", counted)
    assert registry.queries()["tsne"](spark, str(tmp_path)).count() == 110
    assert (asked["steps"], asked["early"]) == (1000, 250)
    assert {r["count"] for r in asked["graph"].groupBy("a").count().collect()} == {91}


def test_grid_stays_fine_on_wide_maps(spark):
    """Maps of all steps are a hundred units wide; nodes stay a third of a unit apart."""
    y = np.random.default_rng(8).uniform(-60, 60, (1500, 2))
    grid = M._grid(spark.createDataFrame([tuple(map(float, r)) for r in y], "y0 double, y1 double").repartition(2))
    gap = y[:, None] - y[None]
    w = 1 / (1 + (gap**2).sum(2))
    z, r = grid.repulsion(y)
    exact = (w[..., None] ** 2 * gap).sum(1)
    assert grid.step < 0.34 and abs(z.sum() - (w.sum() - 1500)) < 0.01 * (w.sum() - 1500)
    assert abs(grid.total - (w.sum() - 1500)) < 0.01 * (w.sum() - 1500) and np.abs(r - exact).max() < 0.05 * np.abs(exact).max()
