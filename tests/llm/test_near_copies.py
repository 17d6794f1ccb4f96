"""Near copies of the pipeline: what the fingerprint filter may cost, and rows that share an id."""

import numpy as np

from rankforge.llm import near_copies
from rankforge.llm.simhash import fingerprint


def test_fingerprint_filter_loses_no_pair():
    """20,000 pairs of sets at a similarity of 0.8 to 0.9, of every size that the filter sees."""
    rng = np.random.default_rng(1)
    lost, worst = 0, 0
    for _ in range(20_000):
        n = int(rng.integers(near_copies.SMALL, 400))
        gone = int(n * rng.uniform(0.05, 1 / 9))  # of each side: similarity (n - gone) / (n + gone)
        both = rng.integers(0, 1 << 63, n + gone, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        far = fingerprint(both[:n]) ^ fingerprint(both[gone:])
        assert (n - gone) / (n + gone) >= 0.8
        lost += not near_copies._chains(np.array([far], np.uint64))[0]
        worst = max(worst, far.bit_count())
    assert lost == 0 and worst <= near_copies.FAR


def test_rows_of_one_id_are_judged_by_their_text(spark):
    base = " ".join(f"w{i}" for i in range(80))
    other = " ".join(f"v{i}" for i in range(80))
    rows = [(1, base, "a"), (5, base + " more", "b"), (5, other, "c"), (1, base + " end", "d"), (None, base, "e"), (7, other + " x", "f"), (7, "short text", "g"), (8, "Short  text", "h"), (9, None, "i"), (10, "", "j"), (11, base, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string").repartition(3)
    left = near_copies.drop_near_copies(df)
    assert sorted(r["component"] for r in left.collect()) == ["a", "c", "d", "e", "g", "i"] and left.columns == df.columns
