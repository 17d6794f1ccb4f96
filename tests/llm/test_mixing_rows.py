"""Mixing with repeated and null ids, in the operator and in the pipeline's stage."""

from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from rankforge.llm import mixing  # noqa: E402

SCHEMA = "doc_id long, text string, source string"


def test_stage_takes_each_row_as_often_as_the_mix(spark):
    rows = [(7, "five words of a text", "a")] * 40 + [(None, f"null id number {i} here", None if i % 2 else "b") for i in range(40)] + [(i, "some words " * (i % 9), "b") for i in range(100, 160)] + [(500, None, "a"), (501, "", "b")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = Counter()
    for r in mixing.mix(docs.withColumnRenamed("text", "t"), text_col="t", keep=["t"]).collect():
        want[r["doc_id"], r["t"], r["source"]] += r["copies"]
    got = Counter(tuple(r) for r in corpus_pipeline.mixing(spark, docs, "").collect())
    assert got == +want and all(got[r] <= 2 * n for r, n in Counter(rows).items())
    assert corpus_pipeline.mixing(spark, docs, "").columns == docs.columns


def test_equal_ids_do_not_meet_in_one_group(spark, monkeypatch):
    """The largest group of the error diffusion stays bounded however often an id, or a whole row, is repeated."""
    rows = [(None, f"text {i}", "a") for i in range(6000)] + [(7, "the same row", "a")] * 6000
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    seen, group = [], type(docs).groupBy

    def watched(self, *by):
        if "_bucket" in by:
            seen.append(max(r["count"] for r in group(self, *by).count().collect()))
        return group(self, *by)

    monkeypatch.setattr(type(docs), "groupBy", watched)
    got = mixing.mix(docs).collect()
    assert seen[-1] <= mixing.CROWDED and len(got) == 12000
    total = sum(r["size"] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * total, rel=0.01)
