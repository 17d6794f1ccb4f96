"""Embedding near-duplicates against all pairs: links, components and who is kept."""

import numpy as np
import pytest

from rankforge.llm import embedding_dedup
from rankforge.llm.embedding_dedup import embedding_groups


def brute(rows):
    """Row by row: links, component and kept."""
    live = [k for k, (i, v, l) in enumerate(rows) if i is not None and l is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {}
    for k in live:
        x = np.array(rows[k][1], float)
        x = x / np.abs(x).max()
        unit[k] = x / np.linalg.norm(x)
    near = {k: [j for j in live if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.98] for k in live}
    group = {k: rows[k][0] for k in live}
    for _ in range(len(live)):
        new = {k: min([group[k], *(group[j] for j in near[k])]) for k in live}
        if new == group:
            break
        group = new
    return sorted((str(i), len(near.get(k, ())), str(group.get(k, i)), group.get(k, i) == i) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("kind", ["double", "float"])
def test_against_all_pairs(spark, kind):
    rng = np.random.default_rng(8)
    cast = (lambda v: [float(x) for x in v]) if kind == "double" else (lambda v: [float(np.float32(x)) for x in v])
    centres = rng.standard_normal((9, 16))
    rows = [(i, cast(centres[i % 9] + rng.uniform(0.02, 0.16) * rng.standard_normal(16)), i % 2) for i in range(260)]
    rows += [(400 + i, rows[3][1], 1) for i in range(40)] + [(3, rows[5][1], 1), (3, rows[4][1], 0)]
    rows += [(None, rows[0][1], 0), (None, None, None), (500, None, 0), (501, [0.0] * 16, 0), (502, [-0.0] * 16, 0), (503, [float("nan")] * 16, 0), (504, [float("inf")] * 16, 1), (505, rows[0][1], None), (506, [None] * 16, 1), (507, [], 1)]
    tiny, huge = (1e-200, 1e200) if kind == "double" else (1e-30, 1e30)
    rows += [(600, cast([tiny, 0.0]), 0), (601, cast([huge, 0.0]), 0), (602, cast([huge, -0.0]), 0), (603, cast([0.0, huge]), 0), (604, cast([1.0, 0.0, 0.0]), 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, _class string, _h1 int").repartition(4)
    for block in (16, 512):
        got = embedding_groups(df, miss=1e-9, block=block).collect()
        assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == brute(rows)


def test_tables_follow_from_the_miss():
    for bits in (6, 12, 20):
        n = embedding_dedup.tables_needed(0.98, bits, 0.002)
        same = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - same) ** n <= 0.002 < (1 - same) ** (n - 1)
