"""Near copies whose fingerprints are close meet by pieces of these, without the min-wise keys."""

import numpy as np
from pyspark.sql import functions as F

from rankforge.llm import near_copies


def texts():
    rng = np.random.default_rng(2)
    made = []
    for g in range(8):
        base = [f"w{x}" for x in rng.integers(0, 5000, 600)]
        made += [" ".join(base), " ".join(base + [f"end{g}"]), " ".join([f"start{g}"] + base), " ".join(w.upper() for w in base)]
    return made + ["", None, " "]


def test_pieces_of_fingerprints_bring_pairs_together(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(3)
    made = near_copies._sketches
    monkeypatch.setattr(near_copies, "_sketches", lambda rows, words: made(rows, words).withColumn("_keys", F.array(F.col("_id").cast("long"))))
    prints = {r["_id"]: r["_fp"] for r in made(df.selectExpr("doc_id AS _id", "coalesce(text, '') AS _text"), 5).collect()}
    group = {i: i for i in prints}
    for _ in range(8):
        group = {i: min(group[j] for j in prints if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 2) for i in prints}
    got = {r["_id"]: r["component"] for r in near_copies.near_copy_groups(df).collect()}
    assert {i: got.get(i, i) for i in group} == group
    assert sum(group[i] < i for i in group) > 15 and group[33] == group[34] == 32


def test_close_fingerprints_of_unlike_texts_are_no_pair(spark):
    """What fingerprints link is tried by the texts themselves, and sizes must fit."""
    made = spark.createDataFrame([(1, 5, 100), (2, 5, 100), (3, 4, 90), (4, 6, 10), (5, 7 << 40, 100)], "_id long, _fp long, _n long")
    assert {(r["a"], r["b"]) for r in near_copies._ring_pairs(near_copies.checkpoint(made), 0.8).collect()} == {(1, 2), (1, 3)}
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n"), (3, "A B C D E F  g")], "_id long, _text string")
    pairs = spark.createDataFrame([(1, 2, 2), (1, 3, 1)], "a long, b long, _size long")
    assert [(r["a"], r["b"]) for r in near_copies._verified(pairs, rows, 5, 0.8).collect()] == [(1, 3)]
