"""Entropy balancing against plain Python: targets by repeated resharing, rates by bisection, words taken near the target."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest

from rankforge.llm.mixing import mix


def reshared(totals, weights, share, cap):
    """Sources in order -> targets."""
    target, open_, left = {}, list(totals), share * sum(totals.values())
    weight = {s: weights[i % len(weights)] for i, s in enumerate(totals)}
    while open_:
        fair = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = [s for s in open_ if fair[s] > cap * totals[s]]
        for s in full or open_:
            target[s] = cap * totals[s] if full else fair[s]
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_rates_and_words(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60) ** 2 // 20)), [None, "b", "B", "é", "z", "a"][min(5, int(rng.exponential(1.5)))]) for i in range(900)]
    rows += [(5000, "w " * 4000, "a"), (5001, None, "empty"), (5002, "", "empty")]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    totals = {s: sum(size[i] for i in by[s]) for s in sorted(by, key=lambda s: (s is None, s or ""))}
    target = reshared(totals, (5, 2, 1), 1.5, 2.0)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-9, abs=1e-6)
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, own in by.items():
        assert abs(taken[s] - target[s]) <= max(size[i] for i in own)
        if not 0 < target[s] < 2 * totals[s] * (1 - 1e-9):
            continue
        mean, low, high = totals[s] / len(own), -1e3, 1e3
        rate = lambda i, m: min(2.0, math.exp(min(50.0, m * size[i] / mean)))
        for _ in range(200):
            m = (low + high) / 2
            low, high = (m, high) if sum(rate(i, m) * size[i] for i in own) < target[s] else (low, m)
        for r in got:
            if r["source"] == s and r["size"]:
                assert r["rate"] == pytest.approx(rate(r["doc_id"], low), abs=1e-4)
