"""Smoothed tf-idf: only totals of terms and the terms that are kept are exchanged; ids that repeat count once for a term."""

from math import log

import pytest

from rankforge.operators import stats


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, tokens array<string>").repartition(3)


REPEATED = [(1, ["a", "b", "a"]), (1, ["b", "c"]), (None, ["a", "d"]), (None, ["d"]), (2, []), (3, None), (4, ["d", "e"])]


@pytest.mark.parametrize("rows", [REPEATED, [(1, ["a", "b", "a"]), (2, ["b"]), (None, ["c", "c"]), (3, None)], []])
def test_totals_are_those_of_chunks(spark, rows):
    t = frame(spark, rows)
    of = lambda df: {r["term"]: (r["cf"], r["df"]) for r in df.collect()}
    assert of(stats.term_totals(t)) == of(stats.term_stats(t))


def test_terms_of_chunks_are_not_exchanged_before_they_are_chosen(spark, monkeypatch):
    monkeypatch.setattr(stats, "chunk_term_freqs", lambda *a: pytest.fail("every term of every chunk is exchanged"))
    rows = [(i, ["x", "x", f"y{i % 3}", f"z{i}"]) for i in range(12)]
    got = {(r["chunk_id"], r["term"]): r["weight"] for r in stats.tfidf_smooth(frame(spark, rows), min_df=2, max_df=1.0, max_features=4).collect()}
    x, y = (1 + log(2)) * 1, log(13 / 5) + 1
    size = (x * x + y * y) ** 0.5
    assert got == pytest.approx({(i, t): w / size for i in range(12) for t, w in (("x", x), (f"y{i % 3}", y))})
