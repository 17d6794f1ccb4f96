"""Training pairs and sets: diverse negatives against a plain loop, folders with nulls and without rows."""

import json

import numpy as np
import pytest

from rankforge.operators.keep import fresh_path
from rankforge.plans.preparation import SETTINGS, diverse
from rankforge.sources import training


def plain_diverse(rows, terms, most):
    picked, used = [], set()
    for negative, similarity, kind in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(picked) < most and len(used & set(terms.get(negative, []))) < 2:
            picked.append((negative, similarity, kind))
            used |= set(terms.get(negative, []))
    return picked


@pytest.mark.parametrize("batch", [1, 3, 64])
def test_diverse_negatives_against_a_loop(spark, batch):
    rng = np.random.default_rng(5)
    terms = {i: [f"t{x}" for x in rng.choice(12, int(rng.integers(0, 6)), replace=False)] for i in range(80) if i % 9}
    found = [(a, n, round(float(s), 1), "easy") for a in range(6) for n, s in zip(rng.choice(80, 60, replace=False).tolist(), rng.random(60))]
    # One anchor whose candidates all clash after the first, one with few, one whose candidates have no terms.
    found += [(10, n, 0.5, "hard") for n in range(200, 260)] + [(11, 1, 0.3, "easy")] + [(12, n, 0.9, "easy") for n in range(300, 330)]
    terms.update({n: ["x", "y", "z"] for n in range(200, 260)})
    got = diverse(
        spark.createDataFrame(found, "anchor long, negative long, similarity double, pair_type string"), spark.createDataFrame(list(terms.items()), "id long, terms array<string>"), most=5, batch=batch
    ).collect()
    for anchor in {r[0] for r in found}:
        own = sorted((r for r in got if r["anchor"] == anchor), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        assert [(r["negative"], r["similarity"], r["pair_type"]) for r in own] == plain_diverse([r[1:] for r in found if r[0] == anchor], terms, 5)


def test_diverse_negatives_of_no_candidates(spark):
    none = spark.createDataFrame([], "anchor long, negative long, similarity double, pair_type string")
    assert diverse(none, spark.createDataFrame([], "id long, terms array<string>")).count() == 0


def _pairs(spark, rows):
    made = [(s, f"a{i}", f"p{i} \"é\"\n", None if i == 2 else f"n{i}", 0.1 * i, t, (i, i + 1, i + 2)) for i, (s, t) in enumerate(rows)]
    return spark.createDataFrame(made, "split string, anchor string, positive string, negative string, difficulty double, type string, ids struct<anchor:bigint,positive:bigint,negative:bigint>")


def _chunks(spark, rows):
    return spark.createDataFrame(rows, training.CHUNK)


def test_training_set_and_its_description(spark):
    rows = [("train", "hard"), ("train", "easy"), ("val", "hard"), ("train", "hard"), ("test", None)]
    chunks = [(1, 7, "one two", 0.0, 2, 0, 2, ["one", "two"]), (2, 7, None, 0.5, 0, 1, 2, None), (3, 8, "", 0.0, 0, 0, 1, [])]
    path = training.write_training_set(_pairs(spark, rows), _chunks(spark, chunks), fresh_path(spark, "set"), SETTINGS)
    back = sorted(training.read_pairs(spark, path).collect(), key=lambda r: r["ids"]["anchor"])
    assert [(r["split"], r["type"]) for r in back] == rows and back[1]["positive"] == 'p1 "é"\n' and back[2]["negative"] is None
    assert sorted(map(tuple, training.read_training_chunks(spark, path).collect())) == chunks
    m = training.read_metadata(spark, path).first()
    assert (m["total_chunks"], m["total_documents"]) == (3, 2) and all(m[k] == v for k, v in SETTINGS.items())
    assert m["splits"] == {"train": 3, "val": 1, "test": 1} and m["pair_types"] == {"hard": 2, "easy": 1}
    [line] = [r["value"] for r in spark.read.text(f"{path}/metadata").collect()]
    assert json.loads(line)["splits"]["train"] == 3
    with pytest.raises(Exception, match="(?i)exist"):
        training.write_training_set(_pairs(spark, rows), _chunks(spark, chunks), path, SETTINGS)


def test_training_set_without_rows(spark):
    path = training.write_training_set(_pairs(spark, [("train", "hard")]).where("false"), _chunks(spark, []), fresh_path(spark, "set"), SETTINGS)
    assert training.read_pairs(spark, path).count() == 0 and training.read_training_chunks(spark, path).count() == 0
    m = training.read_metadata(spark, path).first()
    assert (m["total_chunks"], m["total_documents"], m["splits"], m["pair_types"]) == (0, 0, {}, {})


def test_diverse_negatives_from_blocks(spark, monkeypatch):
    """Several blocks and passes, many copies of texts and vectors; against all negatives and the plain walk."""
    from rankforge.operators import blocks
    from rankforge.plans import preparation as P

    rng = np.random.default_rng(4)
    base = rng.standard_normal((25, 5))
    v = [(i, i // 10, base[i % 25].tolist() if i % 3 else rng.standard_normal(5).tolist()) for i in range(150)]
    words = {i: sorted({f"w{x}" for x in rng.integers(0, 9, int(rng.integers(0, 4)))}) if i % 3 else [f"w{i % 4}", "w8", "w9"] for i in range(150)}
    made = spark.createDataFrame(v, "vec_id long, doc long, v array<double>")
    terms = spark.createDataFrame([(i, t) for i, t in words.items() if t], "id long, terms array<string>")
    monkeypatch.setattr(blocks, "VECTORS", 40)
    monkeypatch.setattr(blocks.meet, "__defaults__", ((40, 40),))
    got = sorted(P.diverse_from(made, terms, most=6, batch=4).collect(), key=lambda r: (r["anchor"], r["place"]))
    x = np.array([r[2] for r in v])
    c = np.round(x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None, :]), 9)
    for a in (0, 50, 100):
        found = sorted((-c[a, b], b) for b in range(150) if b // 10 != a // 10 and c[a, b] <= 0.9)
        picked, used = [], set()
        for s, b in found:
            if len(picked) < 6 and len(used & set(words[b])) < 2:
                picked.append(b)
                used |= set(words[b])
        assert [r["negative"] for r in got if r["anchor"] == a] == picked
