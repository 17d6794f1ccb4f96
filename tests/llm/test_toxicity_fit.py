"""The ordinal fit against plain descent on the same objective; rows of every kind through scoring."""

import numpy as np
import pytest

from rankforge.llm.toxicity import OrdinalModel, drop_toxic, fit_ordinal, score


def objective(params, x, grades, n_grades, l2):
    """Mean balanced loss of P(grade = g) = P(grade >= g) - P(grade >= g + 1), one weight vector for all thresholds."""
    d = x.shape[1]
    w, t = params[:d], np.cumsum(np.concatenate((params[d : d + 1], np.exp(params[d + 1 :]))))
    counts = np.bincount(grades, minlength=n_grades + 1)
    loss = 0.0
    for row, g in zip(x, grades):
        upper = [1.0, *(1 / (1 + np.exp(t - row @ w))), 0.0]
        loss -= np.log(max(upper[g] - upper[g + 1], 1e-12)) * len(grades) / ((counts > 0).sum() * counts[g])
    return loss / len(grades) + l2 * float(w @ w) / 2 / len(grades)


def descend(x, grades, n_grades, l2, rounds=600):
    p, step = np.concatenate((np.zeros(x.shape[1]), [1.0], np.zeros(n_grades - 1))), 1.0
    here = objective(p, x, grades, n_grades, l2)
    for _ in range(rounds):
        slope = np.array([(objective(p + e, x, grades, n_grades, l2) - objective(p - e, x, grades, n_grades, l2)) / 2e-5 for e in 1e-5 * np.eye(len(p))])
        step *= 2
        while step > 1e-12 and objective(p - step * slope, x, grades, n_grades, l2) > here - step * float(slope @ slope) / 2:
            step /= 2
        if step <= 1e-12:
            break
        p = p - step * slope
        here = objective(p, x, grades, n_grades, l2)
    return p, here


@pytest.mark.parametrize("n_grades", [1, 2, 3])
def test_fit_against_plain_descent(n_grades):
    rng = np.random.default_rng(n_grades)
    x = (rng.random((80, 4)) < 0.4).astype(float)
    drawn = x @ np.array([2.0, -1.0, 1.5, 0.0]) + rng.logistic(size=80)
    grades = np.digitize(drawn, np.linspace(0.5, 2.5, n_grades))
    weights, cuts = fit_ordinal([np.flatnonzero(r) for r in x], grades, 4, n_grades, l2=2.0, steps=3000)
    best, least = descend(x, grades, n_grades, 2.0)
    found = np.concatenate((weights, cuts[:1], np.log(np.diff(cuts))))
    assert (np.diff(cuts) > 0).all()
    assert objective(found, x, grades, n_grades, 2.0) <= least + 1e-4
    assert weights == pytest.approx(best[:4], abs=0.03)


def test_grades_follow_the_thresholds():
    model = OrdinalModel({"bad": 3.0, "worse": 4.0}, (1.0, 4.0, 6.0))
    assert [sum(p >= 0.5 for p in model.at_least(t)) for t in ("", "fine", "bad", "worse", "Bad WORSE bad")] == [0, 0, 1, 2, 3]
    assert sum(model.at_least("bad")) < sum(model.at_least("worse"))


def test_rows_of_every_kind(spark):
    model = OrdinalModel({"bad": 3.0}, (1.0,))
    rows = [(1, "so bad", 0.5, 1), (1, "so bad", 0.5, 1), (2, None, 0.1, 2), (None, "bad", 0.2, 3), (3, "", 0.3, 4), (4, "fine " * 200_000 + "bad", 0.4, 5), (5, "badly", 0.5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity double, _id long")
    got = sorted((r["doc_id"] or 0, r["toxic"], r["grade"]) for r in score(docs, model).collect())
    assert got == [(0, True, 1), (1, True, 1), (1, True, 1), (2, False, 0), (3, False, 0), (4, True, 1), (5, False, 0)]
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5]
    assert score(docs.where("false"), model).count() == 0 and drop_toxic(docs.where("false"), model).count() == 0
