"""Toxicity as ordered severity grades: cumulative-link logistic regression on sparse text features.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector for all ordered thresholds t_1 < t_2 < ...;
the expected severity is the sum of these probabilities. Features are the presence of words and of their
first 4, 5 and 6 letters (which inflected forms share), chosen by chi-square on the labelled sample.

Labels only say toxic or not, so grades are derived: clean is 0, and labelled toxic documents are cut into
equal thirds by how many of the features typical of them they hold.

Fitting takes a bounded sample of labelled documents (``sample`` of each class, those with the smallest hash
of their id); chosen features (at most ``features``) and their occurrences in that sample are all that the
driver sees. Scoring is one pass over the texts with no exchange.

Defined results: a null or blank text holds no feature and is scored by the thresholds alone; labels that
are null or belong to no document are not used, an id that is labelled both ways is toxic, and of documents that
repeat a labelled id one is learnt from (the one whose text has the smallest hash); where no labelled document is toxic, nothing is; a
null id and repeated rows are scored like any other; an empty table gives an empty result; other
columns are ignored (``drop_toxic`` hands them on).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import checkpoint, text_batches, text_or_empty

SAMPLE, FEATURES, GRADES = 3000, 4096, 3
PREFIXES = (4, 5, 6)
#: Far above the 5 % point of one test, as hundreds of thousands of features are tested at once.
CHI_SQUARE = 20.0
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The word, and its beginnings (marked by ``*``)."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n]]


def text_features(text: str) -> set[str]:
    return {f for w in set(_LETTERS.findall(text.lower())) for f in word_features(w)}


@dataclass
class OrdinalModel:
    """Weights by feature, shared by all thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (math.inf,)
    _seen: dict[str, tuple] = field(default_factory=dict, repr=False, compare=False)

    def at_least(self, text: str) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        seen, found = self._seen, {}
        for w in set(_LETTERS.findall(text.lower())):
            own = seen.get(w)
            if own is None:
                own = tuple((f, self.weights[f]) for f in word_features(w) if f in self.weights)
                if len(seen) < 500_000 and len(w) <= 64:
                    seen[w] = own
            if own:
                found.update(own)
        score = math.fsum(found.values())
        return [1 / (1 + math.exp(min(700.0, max(-700.0, t - score)))) for t in self.thresholds]

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds, "_seen": {}}


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_features: int, n_grades: int, l2: float = 0.02, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with an L2 penalty by Adam; rows are the indices of present features.

    Thresholds are the first one plus exponentials, so they stay ordered.
    """
    lengths = np.array([len(r) for r in rows])
    cols, owner = (np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)), np.repeat(np.arange(len(rows)), lengths)
    weights, cuts = np.zeros(n_features), np.concatenate(([1.0], np.zeros(n_grades - 1)))
    state = [np.zeros(n_features + n_grades) for _ in range(2)]
    per_grade = np.bincount(grades, minlength=n_grades + 1)
    balance = len(grades) / np.maximum(1, (per_grade > 0).sum() * per_grade)
    case = balance[grades] / len(grades)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate((cuts[:1], np.exp(cuts[1:]))))
        score = np.bincount(owner, weights[cols], len(rows))
        upper = np.column_stack((np.ones(len(rows)), sigmoid(score[:, None] - t), np.zeros(len(rows))))  # P(grade >= 0..K+1)
        at = np.arange(len(rows))
        high, low = upper[at, grades], upper[at, grades + 1]
        p = np.maximum(high - low, 1e-12)
        slope = np.zeros((len(rows), n_grades))  # of -log p by each z_k = score - t_k
        d = upper * (1 - upper)
        up, down = grades > 0, grades < n_grades
        slope[at[up], grades[up] - 1] -= (d[at[up], grades[up]] / p[up])
        slope[at[down], grades[down]] += d[at[down], grades[down] + 1] / p[down]
        slope *= case[:, None]
        by_score = slope.sum(1)
        g_w = np.bincount(cols, by_score[owner], n_features) + l2 * weights / len(rows)
        g_t = -slope.sum(0)
        tail = np.cumsum(g_t[::-1])[::-1]
        g_c = tail * np.concatenate(([1.0], np.exp(cuts[1:])))
        g = np.concatenate((g_w, g_c))
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.999 * state[1] + 0.001 * g * g
        move = 0.05 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        weights, cuts = weights - move[:n_features], cuts - move[n_features:]
    return weights, np.cumsum(np.concatenate((cuts[:1], np.exp(cuts[1:]))))


def severity_grades(toxic: np.ndarray, markers: np.ndarray, n_grades: int) -> np.ndarray:
    """0 for clean; toxic documents by rank of their number of markers, in equal parts, ties together."""
    grades = np.zeros(len(toxic), np.int64)
    if toxic.any():
        own = markers[toxic]
        cuts = np.quantile(own, [k / n_grades for k in range(1, n_grades)])
        grades[toxic] = 1 + (own[:, None] > cuts).sum(1)
    return grades


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, n_grades: int = GRADES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> OrdinalModel:
    """Fits the model on at most ``sample`` labelled documents of each class."""
    known = labels.select(F.col(id_col).alias("_of"), (F.col(label_col) > 0).alias("_toxic")).where("_of IS NOT NULL AND _toxic IS NOT NULL")
    known = known.groupBy("_of").agg(F.max("_toxic").alias("_toxic"))
    order = [F.xxhash64("_of"), F.col("_of")]
    chosen = known.where("_toxic").orderBy(*order).limit(sample).union(known.where("NOT _toxic").orderBy(*order).limit(sample))
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    texts = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_of"))  # at most 2 * sample ids
    texts = texts.groupBy("_id", "_toxic").agg(F.min(F.struct(F.xxhash64("_text"), "_text"))["_text"].alias("_text"))  # a row for each

    def extract(batches):
        for b in text_batches(batches):
            found = [sorted(text_features(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))], ["_id", "_toxic", "_found"])

    held = checkpoint(texts.mapInArrow(extract, f"_id {rows.schema['_id'].dataType.simpleString()}, _toxic boolean, _found array<string>"))
    totals = held.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_toxic"), 1)).alias("p")).first()
    n, p = totals["n"], totals["p"]
    if not p or p == n:
        return OrdinalModel() if not p else OrdinalModel({}, (-math.inf,))
    per = held.select("_toxic", F.explode("_found").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("_toxic"), 1)).alias("a"))
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    chi = n * F.pow(a * (n - p) - (c - a) * p, 2) / (c * (n - c + 0.5) * p * (n - p))
    best = per.where("c >= 3").select("f", (a / p > (c - a) / (n - p)).alias("toxic_side"), ((a + 0.5) / (p + 1) / ((c - a + 0.5) / (n - p + 1))).alias("odds"), chi.alias("chi"))
    best = best.where(F.col("chi") > CHI_SQUARE).orderBy(F.desc("chi"), "f").limit(features).collect()  # bounded by ``features``
    place = {r["f"]: i for i, r in enumerate(best)}
    marker = np.array([r["odds"] > 8 for r in best])

    def pick(batches):
        for b in batches:
            cols = [[place[f] for f in own if f in place] for own in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols, pa.list_(pa.int32()))], ["_id", "_toxic", "_cols"])

    got = held.mapInArrow(pick, f"_id {rows.schema['_id'].dataType.simpleString()}, _toxic boolean, _cols array<int>").orderBy(F.xxhash64("_id"), "_id").collect()  # at most 2 * sample rows
    toxic, cols = np.array([r["_toxic"] for r in got]), [np.array(r["_cols"], np.int64) for r in got]
    grades = severity_grades(toxic, np.array([int(marker[c].sum()) if len(c) else 0 for c in cols]), n_grades)
    weights, cuts = fit_ordinal(cols, grades, len(best), n_grades)
    return OrdinalModel({f: float(weights[i]) for f, i in place.items() if abs(weights[i]) > 1e-6}, tuple(map(float, cuts)))


def score(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: ``id_col, p_toxic, severity, grade, toxic``."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches):
        for b in text_batches(batches):
            p = [sent.value.at_least(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([x[0] for x in p], pa.float64()), pa.array([math.fsum(x) for x in p], pa.float64()), pa.array([sum(v >= 0.5 for v in x) for x in p], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["_id", "p_toxic", "severity", "grade"])

    out = rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, p_toxic double, severity double, grade int")
    return out.select(F.col("_id").alias(id_col), "p_toxic", "severity", "grade", (F.col("p_toxic") >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose text is toxic; one pass, no exchange."""
    place, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in text_batches(batches):
            keep = [sent.value.at_least(t or "")[0] < threshold for t in b.column(place).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
