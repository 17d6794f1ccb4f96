"""The learning history as state of a stream: weights follow how earlier, similar queries went, and successes come back as they are known.

Events are rows of one stream: a query with its features, or the feedback on one. A query asks every similar pattern for its latest
entries and adds an entry to its own; feedback finds the entry of its query. State is kept for each (scope, pattern): the ten latest entries, so
scopes (tenants, languages, sessions) share nothing and are spread over tasks. Within a batch events count in the order of ``seq``;
batches are taken as they come. Answers of a query to all patterns fall into one batch, where ``weights`` adds them up.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.learning import ALIKE, FLAGS, GROUP_LENGTH, KEPT, MEAN_LENGTH, alike_flags, closeness

#: What a stream of events must have; ``mrf`` and ``emb`` (0 or 1, null: not known) are those of feedback.
EVENTS = "scope string, seq long, kind string, query_id long, pattern string, n_words int, mean_length double, has_medical boolean, has_question boolean, has_technical boolean, mrf int, emb int"
_ASK, _ADD, _TELL = 0, 1, 2
_ANSWERS = "scope string, query_id long, n int, mrf int, emb int"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def similar(patterns: list[tuple]) -> Column:
    """Names of the patterns ``(name, group, flags...)`` that a row's features are similar to."""

    def score(group: str, flags: tuple) -> Column:
        same = sum(((F.col(c) == F.lit(v)).cast("int") for c, v in zip(FLAGS, flags)), F.lit(0))
        return 0.4 * closeness(F.col("n_words"), F.lit(GROUP_LENGTH[group])) + alike_flags(same) + 0.2 * closeness(F.col("mean_length"), F.lit(MEAN_LENGTH))

    each = [F.struct(F.lit(name).alias("pattern"), score(group, tuple(flags)).alias("similarity")) for name, group, *flags in patterns]
    return F.transform(F.filter(F.array(*each), lambda p: p.similarity > ALIKE), lambda p: p.pattern)


def messages(events: DataFrame, patterns: list[tuple]) -> DataFrame:
    """``scope, pattern, seq, kind, query_id, mrf, emb``: what each pattern's state is told or asked, in one pass over the events."""
    one = lambda pattern, kind: F.struct(pattern.alias("pattern"), F.lit(kind).alias("what"))
    query = F.concat(F.transform(similar(patterns), lambda p: one(p, _ASK)), F.array(one(F.col("pattern"), _ADD)))
    sent = F.when(F.col("kind") == "query", query).otherwise(F.array(one(F.col("pattern"), _TELL)))
    return events.select("scope", "seq", "query_id", "mrf", "emb", F.explode(sent).alias("m")).select("scope", F.col("m.pattern").alias("pattern"), "seq", F.col("m.what").alias("kind"), "query_id", "mrf", "emb")


class PatternHistory(StatefulProcessor):
    """State of one pattern: the latest entries, oldest first, as ``[query, mrf, emb]``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getValueState("entries", "entries string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.entries.get()[0]) if self.entries.exists() else []
        told = pd.concat(list(rows)).sort_values(["seq", "kind"], kind="stable")
        out = []
        for r in told.itertuples(index=False):
            query = int(r.query_id)
            if r.kind == _ASK:
                out.append((key[0], query, len(held), sum(e[1] for e in held), sum(e[2] for e in held)))
            elif r.kind == _ADD:
                held = [*held, [query, 0, 0]][-KEPT:]
                out.append((key[0], query, 0, 0, 0))  # each query is answered, though nothing be similar
            else:
                for e in held:
                    if e[0] == query:
                        e[1] = e[1] if pd.isna(r.mrf) else int(r.mrf)
                        e[2] = e[2] if pd.isna(r.emb) else int(r.emb)
        self.entries.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["scope", "query_id", "n", "mrf", "emb"]).astype({"query_id": "int64", "n": "int32", "mrf": "int32", "emb": "int32"})

    def close(self) -> None:
        pass


def answers(events: DataFrame, patterns: list[tuple]) -> DataFrame:
    """``scope, query_id, n, mrf, emb``: entries and successes that each similar pattern holds when a query comes."""
    told = messages(events, patterns)
    return told.groupBy("scope", "pattern").transformWithStateInPandas(PatternHistory(), _ANSWERS, "Append", "None")


def weights(batch: DataFrame) -> DataFrame:
    """``scope, query_id, n_similar, mrf_weight, emb_weight`` of a batch's answers: shares of success within .2 and .8, even without any."""
    found = batch.groupBy("scope", "query_id").agg(*[F.sum(c).alias(c) for c in ("n", "mrf", "emb")])
    held = lambda c: F.least(F.lit(0.8), F.greatest(F.lit(0.2), F.coalesce(F.try_divide(F.col(c), F.col("mrf") + F.col("emb")), F.lit(0.5))))
    total = held("mrf") + held("emb")
    return found.select("scope", "query_id", F.col("n").alias("n_similar"), (held("mrf") / total).alias("mrf_weight"), (held("emb") / total).alias("emb_weight"))


def run(events: DataFrame, patterns: list[tuple], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts the stream over all that is there; ``sink`` gets the weights of each batch. State and progress are kept in ``checkpoint``."""
    events.sparkSession.conf.set(*STORE)
    made = answers(events, patterns).writeStream.foreachBatch(lambda batch, i: sink(weights(batch), i))
    return made.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
