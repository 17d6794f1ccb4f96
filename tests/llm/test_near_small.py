"""Small graphs of links take few small jobs, and links found later are followed between components only."""

import numpy as np

from rankforge.llm import components, near_copies
from rankforge.llm._base import checkpoint


def tasks(spark, run):
    """What ``run`` gives, and how many tasks its jobs had."""
    spark.sparkContext.setJobGroup("counted", "")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = run()
    finally:
        for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("counted") if (job := tracker.getJobInfo(j)) for s in job.stageIds}
    return made, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_a_small_graph_takes_few_tasks(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20] + [(100, i) for i in range(101, 140)], "a long, b long")
    made, n = tasks(spark, lambda: {r["node"]: r["component"] for r in components.connected_components(links).collect()})
    assert made == {i: 0 if i <= 20 else 21 if i <= 40 else 100 for i in [*range(41), *range(100, 140)]}
    assert n < 64 * 40


def test_later_links_join_components(spark, monkeypatch):
    for small in (10_000, 0):  # by broadcast, and by exchange
        monkeypatch.setattr(components, "SMALL", small)
        parts = checkpoint(components.connected_components(spark.createDataFrame([(1, 2), (3, 4), (5, 6), (7, 8)], "a long, b long")))
        later = checkpoint(spark.createDataFrame([(5, 3), (7, 9), (11, 12), (3, 3)], "a long, b long"))
        got = {r["node"]: r["component"] for r in components.joined_components(parts, later).collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 7: 7, 8: 7, 9: 7, 11: 11, 12: 11}
        assert components.joined_components(parts, later.limit(0)).count() == 8


def test_first_shared_key():
    rng = np.random.default_rng(1)
    keys = [near_copies.band_keys(np.unique(rng.integers(0, 60, 40).astype(np.uint64))) for _ in range(30)] + [near_copies.band_keys(np.array([], np.uint64))]
    made = near_copies._banded([k.tolist() for k in keys])
    for own, one in zip(keys, made):
        want = [min(set(k.tolist()) & set(own.tolist()), default=np.iinfo(np.int64).max) for k in keys]
        assert near_copies._first_shared(made, one).tolist() == want
