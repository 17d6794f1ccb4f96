"""The stream of the learning history against the batch weights and a loop, across a restart."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from rankforge.operators import learning
from rankforge.streaming import history

PATTERNS = [("_".join((g, "med" if m else "no_med", "q" if q else "no_q", "tech" if t else "no_tech")), g, m, q, t) for g, m, q, t in product(learning.GROUP_LENGTH, *[(True, False)] * 3)]


def made(n=90, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words, flags = rnd.choice([2, 3, 5, 6, 9, 14]), [rnd.random() < 0.3 for _ in range(3)]
        group = "short" if words <= 3 else "medium" if words <= 6 else "long"
        pattern = next(p[0] for p in PATTERNS if p[1] == group and list(p[2:]) == flags)
        rows.append((i, pattern, words, rnd.uniform(3, 8), *flags, int(rnd.random() < 0.6), int(rnd.random() < 0.4)))
    return rows


def events(rows, scope="s"):
    out = []
    for i, pattern, words, mean, *flags, mrf, emb in rows:
        out.append((scope, 2 * i, "query", i, pattern, words, mean, *flags, None, None))
        out.append((scope, 2 * i + 1, "feedback", i, pattern, None, None, None, None, None, mrf, emb))
    return out


def loop(rows):
    held, out = {}, {}
    near = lambda a, b: 1 - abs(a - b) / max(a, b, 1)
    for i, pattern, words, mean, *flags, mrf, emb in rows:
        found = []
        for name, group, *own in PATTERNS:
            score = 0.4 * near(words, learning.GROUP_LENGTH[group]) + 0.4 * sum(a == b for a, b in zip(flags, own)) / 3 + 0.2 * near(mean, 5.0)
            if score > 0.7:
                found += held.get(name, [])
        m, e = sum(x[0] for x in found), sum(x[1] for x in found)
        wm, we = (m / (m + e), e / (m + e)) if m + e else (0.5, 0.5)
        wm, we = min(0.8, max(0.2, wm)), min(0.8, max(0.2, we))
        out[i] = (len(found), round(wm / (wm + we), 9), round(we / (wm + we), 9))
        held[pattern] = [*held.get(pattern, []), (mrf, emb)][-10:]
    return out


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    """Two scopes; three batches, a stop, and two more from the same checkpoint."""
    where = tmp_path_factory.mktemp("history")
    source, target, mark = (str(where / n) for n in ("in", "out", "mark"))
    both = {"s": made(), "t": made(40, 9)}
    every = [(k, events(r, k)) for k, r in both.items()]

    def put(part):
        rows = [e for _, own in every for e in own[part * 40 : part * 40 + 40]]
        random.Random(part).shuffle(rows)
        spark.createDataFrame(rows, history.EVENTS).coalesce(1).write.mode("append").parquet(source)

    def go():
        stream = spark.readStream.schema(history.EVENTS).parquet(source)
        q = history.run(stream, PATTERNS, lambda df, i: df.write.mode("append").parquet(target), mark)
        q.awaitTermination(150)
        assert q.exception() is None and not q.isActive

    put(0)
    go()
    put(1)
    put(2)  # one batch of two files
    go()
    put(3)
    put(4)
    go()
    return both, spark.read.parquet(target).collect()


def test_equals_a_loop_across_restarts(streamed):
    both, got = streamed
    for scope, rows in both.items():
        own = {r.query_id: (r.n_similar, round(r.mrf_weight, 9), round(r.emb_weight, 9)) for r in got if r.scope == scope}
        assert own == loop(rows)
    assert len(got) == sum(map(len, both.values()))


def test_equals_the_batch_weights(spark, streamed):
    both, got = streamed
    rows = both["s"]
    features = spark.createDataFrame([r[:7] for r in rows], "query_id long, pattern string, n_words int, mean_length double, has_medical boolean, has_question boolean, has_technical boolean")
    success = spark.createDataFrame([(r[0], r[7], r[8]) for r in rows], "query_id long, mrf int, emb int")
    known = spark.createDataFrame(PATTERNS, "pattern string, group string, has_medical boolean, has_question boolean, has_technical boolean")
    want = learning.history_weights(features, known, success).select("query_id", "n_similar", F.round("mrf_weight", 9), F.round("emb_weight", 9)).collect()
    assert {tuple(r) for r in want} == {(r.query_id, r.n_similar, round(r.mrf_weight, 9), round(r.emb_weight, 9)) for r in got if r.scope == "s"}
