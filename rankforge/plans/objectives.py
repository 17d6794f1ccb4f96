"""Queries of training objectives over the training pairs."""

from __future__ import annotations

from ..operators import objectives as O
from ..operators.keep import stored
from .common import vectors
from .preparation import _BLOCKED, blocked
from .registry import query

_PC = f"""{_BLOCKED}, pc AS (SELECT pair_type, list_cosine_similarity(a.v, p.v) AS pos, list_cosine_similarity(a.v, n.v) AS neg FROM bp JOIN ck a ON a.id = anchor JOIN ck p ON p.id = positive JOIN ck n ON n.id = negative)"""


def cosines(spark, sf):
    return O.pair_cosines(blocked(spark, sf), vectors(spark, sf))


@query("triplet_loss_eval", f"WITH {_PC} SELECT pair_type, count(*) AS n, avg(greatest(0.0, neg - pos + 0.2)) AS loss, avg((neg - pos + 0.2 <= 0)::INT) AS satisfied, avg(pos) AS mean_positive FROM pc GROUP BY pair_type", "loss satisfied mean_positive")
def triplet_loss_eval(spark, sf):
    return O.triplet_loss(cosines(spark, sf), ["pair_type"])


@query("infonce_eval", f"WITH {_PC} SELECT pair_type, count(*) AS n, avg(ln(1 + exp((neg - pos) / 0.05))) AS loss, avg((neg < pos)::INT) AS accuracy FROM pc GROUP BY pair_type", "loss accuracy")
def infonce_eval(spark, sf):
    return O.infonce_loss(cosines(spark, sf), ["pair_type"])


@query(
    "uniformity_penalty",
    f"""WITH {_BLOCKED}, au AS (SELECT id, count(*) AS k FROM (SELECT anchor AS id FROM bp UNION ALL SELECT positive FROM bp UNION ALL SELECT negative FROM bp) GROUP BY id),
    uv AS (SELECT k, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM au JOIN ck USING (id)),
    sv AS (SELECT sum(s * s) AS square FROM (SELECT sum(k * x) AS s FROM (SELECT k, unnest(u) AS x, generate_subscripts(u, 1) AS dim FROM uv) GROUP BY dim)),
    ms AS (SELECT (SELECT sum(k)::BIGINT FROM uv) AS n, ((SELECT square FROM sv) - (SELECT sum(k) FROM uv)) / ((SELECT sum(k)::DOUBLE FROM uv) * (SELECT sum(k)::DOUBLE - 1 FROM uv)) AS mean_similarity)
    SELECT n, mean_similarity, CASE WHEN mean_similarity > 0.0005 THEN (mean_similarity - 0.0005) ** 2 ELSE 0.0 END AS penalty FROM ms""",
    "mean_similarity penalty",
)
def uniformity_penalty(spark, sf):
    """With a threshold that these vectors may pass."""
    return O.uniformity_penalty(stored(blocked(spark, sf), "pairs"), vectors(spark, sf), threshold=0.0005)
