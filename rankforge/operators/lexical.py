"""Lexical relevance: many queries against all chunks at once, by inverted-index joins.

``Index`` holds what the scorers share: query terms, the chunks' tokens (stored once), the counts of query terms in
chunks, lengths and corpus statistics. A scorer is a few sums over what a query and a chunk have in common, by term or
by pair of terms; ``gather`` brings all sums that a score needs together with the pairs themselves in one exchange.
What a pair without a common term scores follows from lengths and constants. Scorers return ``query_id, chunk_id, score``
for all pairs: the stated query set against all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bigrams_ordered, bigrams_unordered
from . import stats
from .keep import stored

#: Query tables up to this many rows are sent to every task; larger ones are joined by exchange.
SMALL_ROWS = 200_000


@dataclass
class Index:
    queries: DataFrame  # query_id, tokens
    source: DataFrame  # chunk_id, tokens

    @cached_property
    def chunks(self) -> DataFrame:
        """Stored once; the work on pairs has a task for each file, so ``source`` should have as many parts as there are cores."""
        return stored(self.source, "tokens")

    @cached_property
    def query_terms(self) -> DataFrame:
        return stats.chunk_term_freqs(self.queries, "query_id").withColumnRenamed("tf", "qn")

    @cached_property
    def n_query_rows(self) -> int:
        return self.query_terms.count()

    @cached_property
    def query_length(self) -> DataFrame:
        return self.queries.select("query_id", F.size("tokens").alias("n"))

    def sent(self, df: DataFrame, times: int = 1) -> DataFrame:
        """Broadcast, if the queries (``df`` has up to ``times`` rows for each of theirs) are few enough."""
        return F.broadcast(df) if times * self.n_query_rows <= SMALL_ROWS else df

    @cached_property
    def tf(self) -> DataFrame:
        """``chunk_id, term, tf`` of the queries' terms."""
        terms = self.sent(self.query_terms.select("term").distinct())
        hits = stats.postings(self.chunks).join(terms, "term", "left_semi")
        return stored(hits.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf")), "tf")

    @cached_property
    def lengths(self) -> DataFrame:
        return stats.chunk_lengths(self.chunks)

    @cached_property
    def corpus(self) -> DataFrame:
        return self.lengths.agg(F.greatest(F.sum("dl"), F.lit(1)).alias("total"), F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avg_dl"))

    @cached_property
    def cf(self) -> DataFrame:
        return self.tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))

    def pairs(self) -> DataFrame:
        """``chunk_id, dl, query_id, n``: every query with every chunk."""
        return self.lengths.crossJoin(self.sent(self.query_length))

    def matches(self) -> DataFrame:
        """``query_id, chunk_id, term, qn, tf, cf, df`` of the terms a query and a chunk share."""
        return self.tf.join(self.sent(self.query_terms.join(self.cf, "term")), "term")

    def with_p(self) -> DataFrame:
        """Query terms with their corpus probability."""
        return self.query_terms.join(self.cf, "term").crossJoin(F.broadcast(self.corpus)).withColumn("p", F.col("cf") / F.col("total"))

    def gather(self, *parts: DataFrame, most: tuple[str, ...] = ()) -> DataFrame:
        """``query_id, chunk_id, n, dl`` of every pair with the sums of all other columns of ``parts`` (0 where nothing is added; the largest for those in ``most``)."""
        names = [c for p in parts for c in p.columns if c not in ("query_id", "chunk_id")]
        rows = self.pairs().select("query_id", "chunk_id", "n", "dl")
        for p in parts:
            rows = rows.unionByName(p, allowMissingColumns=True)
        sums = [(F.max if c in most else F.sum)(c) for c in names]
        return rows.groupBy("query_id", "chunk_id").agg(F.max("n").alias("n"), F.max("dl").alias("dl"), *[F.coalesce(x, F.lit(0)).alias(c) for x, c in zip(sums, names)])


FLOOR = 1e-6


def _ask(index: Index, base: DataFrame) -> DataFrame:
    """One row a query, for the join with pairs."""
    return index.sent(base)


def likelihood(mu: float = 1500.0) -> Column:
    """The score from ``dl, c, known, gain, lift``."""
    return F.when((F.col("dl") == 0) | F.col("c").isNull(), F.lit(0.0)).otherwise(F.col("c") - F.col("known") * F.ln(F.col("dl") + mu) + F.col("gain") + F.col("lift"))


def qlm_dirichlet(index: Index, mu: float = 1500.0) -> DataFrame:
    """Sum of ln(max((tf + mu p) / (dl + mu), 1e-6)) over the query's tokens that the corpus knows; made where the chunks are, so no pair is exchanged."""
    from .retrieval import Retrieval

    return Retrieval(index.queries.withColumn("n_words", F.lit(0)), index.source, mu).likelihoods()


def qlm_jelinek_mercer(index: Index, lam: float = 0.5) -> DataFrame:
    """Sum of ln(max(lam tf/dl + (1 - lam) p, 1e-6)); what a chunk lacks depends on the query alone."""
    terms = index.with_p()
    alone = F.ln(F.greatest((1 - lam) * F.col("p"), F.lit(FLOOR)))
    base = terms.groupBy("query_id").agg(F.sum(F.col("qn") * alone).alias("c"))
    shared = index.tf.join(index.sent(terms.select("query_id", "term", "qn", "p")), "term").join(index.lengths, "chunk_id")
    both = F.ln(F.greatest(lam * F.col("tf") / F.col("dl") + (1 - lam) * F.col("p"), F.lit(FLOOR)))
    pairs = index.gather(shared.select("query_id", "chunk_id", (F.col("qn") * (both - alone)).alias("gain"))).join(_ask(index, base), "query_id", "left")
    return pairs.select("query_id", "chunk_id", F.when((F.col("dl") == 0) | F.col("c").isNull(), F.lit(0.0)).otherwise(F.col("c") + F.col("gain")).alias("score"))


def qlm_score(index: Index, method: str = "dirichlet", **options) -> DataFrame:
    made = {"dirichlet": qlm_dirichlet, "jelinek_mercer": qlm_jelinek_mercer, "jm": qlm_jelinek_mercer}
    if method not in made:
        raise ValueError(f"unknown smoothing: {method}")
    return made[method](index, **options)


def query_term_weights(index: Index, true_df: bool = False) -> DataFrame:
    """``query_id, term, weight``: max(0, ln((N - df + 0.5) / (df + 0.5))), with df = 0 unless ``true_df``."""
    terms = index.query_terms.join(index.cf.select("term", "df"), "term", "left").crossJoin(F.broadcast(index.corpus.select("n_chunks")))
    df = F.coalesce("df", F.lit(0)) if true_df else F.lit(0)
    return terms.select("query_id", "term", "qn", F.greatest(F.lit(0.0), F.ln((F.col("n_chunks") - df + 0.5) / (df + 0.5))).alias("weight"))


def qlm_weighted(index: Index, mu: float = 1500.0, true_df: bool = False) -> DataFrame:
    """Dirichlet log probabilities by term weight, without the floor; once for each distinct query term."""
    weights = query_term_weights(index, true_df).select("query_id", "term", "weight")
    terms = index.with_p().join(weights, ["query_id", "term"])
    base = terms.groupBy("query_id").agg(F.sum(F.col("weight") * F.ln(mu * F.col("p"))).alias("c"), F.sum("weight").alias("known"))
    shared = index.tf.join(index.sent(terms.select("query_id", "term", "weight", "p")), "term")
    gain = shared.select("query_id", "chunk_id", (F.col("weight") * (F.ln(F.col("tf") + mu * F.col("p")) - F.ln(mu * F.col("p")))).alias("gain"), F.lit(0.0).alias("lift"))
    return index.gather(gain).join(_ask(index, base), "query_id", "left").select("query_id", "chunk_id", likelihood(mu).alias("score"))


def bm25(index: Index, k1: float = 1.2, b: float = 0.75, compat: bool = False) -> DataFrame:
    """BM25 of the query's distinct terms. ``compat`` takes one document as the corpus, as a per-chunk caller would."""
    m = index.matches().join(index.lengths, "chunk_id").crossJoin(F.broadcast(index.corpus))
    n = F.lit(1.0) if compat else F.col("n_chunks").cast("double")
    ratio = (n - F.col("df") + 0.5) / (F.col("df") + 0.5)
    idf = F.when(ratio > 0, F.ln(F.when(ratio > 0, ratio)))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return index.gather(m.select("query_id", "chunk_id", part.alias("score"))).select("query_id", "chunk_id", F.col("score").cast("double").alias("score"))


def unigram_part(index: Index) -> DataFrame:
    return index.matches().select("query_id", "chunk_id", F.col("qn").alias("hit"), (F.col("tf") * F.col("qn")).alias("freq"))


def unigram() -> Column:
    """Share of query tokens that occur, plus min(0.1, ln(1 + all tf)/10), at most 1."""
    return F.when(F.col("n") > 0, F.least(F.lit(1.0), F.try_divide("hit", "n") + F.least(F.lit(0.1), F.ln(1 + F.col("freq")) / 10))).otherwise(F.lit(0.0))


def mrf_unigram(index: Index) -> DataFrame:
    return index.gather(unigram_part(index)).select("query_id", "chunk_id", unigram().alias("score"))


def _query_bigrams(index: Index) -> DataFrame:
    """``query_id, a, b, times``: adjacent pairs of the query, with duplicates counted."""
    each = index.queries.select("query_id", F.explode(bigrams_ordered(F.col("tokens"))).alias("g")).select("query_id", "g.a", "g.b")
    return each.groupBy("query_id", "a", "b").agg(F.count(F.lit(1)).alias("times"))


def ordered_part(index: Index, name: str = "ordered") -> DataFrame:
    """Of the query's adjacent pairs, in order, the share that each one adds where a chunk has it."""
    wanted = _query_bigrams(index)
    total = wanted.groupBy("query_id").agg(F.sum("times").alias("n_pairs"))
    wanted = wanted.join(total, "query_id").select("query_id", "a", "b", (F.col("times") / F.col("n_pairs")).alias(name))
    ahead = F.transform(F.slice("tokens", F.lit(2), F.size("tokens")), lambda y, i: F.struct(F.get("tokens", i).alias("a"), y.alias("b")))
    seen = index.chunks.select("chunk_id", F.explode(ahead).alias("g")).select("chunk_id", "g.a", "g.b")
    seen = seen.join(index.sent(wanted.select("a", "b").distinct()), ["a", "b"], "left_semi").distinct()
    return seen.join(index.sent(wanted), ["a", "b"]).select("query_id", "chunk_id", name)


def mrf_ordered(index: Index) -> DataFrame:
    """Share of the query's adjacent pairs that are adjacent, in order, in the chunk."""
    return index.gather(ordered_part(index)).select("query_id", "chunk_id", F.col("ordered").cast("double").alias("score"))


def query_pairs(index: Index, window: int) -> DataFrame:
    """``query_id, a, b``: the query's own distinct sorted pairs at most ``window`` apart."""
    return index.queries.select("query_id", F.explode(bigrams_unordered(F.col("tokens"), window)).alias("g")).select("query_id", "g.a", "g.b").distinct()


def min_gaps(index: Index, window: int) -> DataFrame:
    """``chunk_id, a, b, gap``: the least distance, up to ``window``, in a chunk of each sorted pair that some query asks for.

    Each token names the ``window`` after it, inside its own row; only pairs that are asked for are exchanged.
    """
    asked = index.sent(query_pairs(index, window).select("a", "b").distinct(), window)
    ahead = lambda x, i: F.transform(F.slice("tokens", i + 2, F.lit(window)), lambda y, j: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (j + 1).alias("gap")))
    near = index.chunks.select("chunk_id", F.explode(F.transform("tokens", ahead)).alias("g")).select("chunk_id", F.inline("g"))
    near = near.join(asked, ["a", "b"], "left_semi")
    return near.groupBy("chunk_id", "a", "b").agg(F.min("gap").alias("gap"))


def window_parts(index: Index, windows: tuple[int, ...], gaps: DataFrame | None = None) -> list[DataFrame]:
    """``w<size>``: for each window, what each pair of the query's own adds where it comes within it."""
    gaps = stored(min_gaps(index, max(windows)), "gaps") if gaps is None else gaps
    out = []
    for w in windows:
        wanted = query_pairs(index, w)
        total = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pairs"))
        share = wanted.join(total, "query_id").select("query_id", "a", "b", (1 / F.col("n_pairs")).alias(f"w{w}"))
        out.append(gaps.where(F.col("gap") <= w).join(index.sent(share, w), ["a", "b"]).select("query_id", "chunk_id", f"w{w}"))
    return out


def mrf_unordered(index: Index, window: int = 8) -> DataFrame:
    """Share of the query's windowed pairs that come within ``window`` in the chunk."""
    return index.gather(*window_parts(index, (window,))).select("query_id", "chunk_id", F.col(f"w{window}").cast("double").alias("score"))


def mrf_windows(index: Index, sizes: tuple[int, ...] = (4, 8, 16, 32)) -> DataFrame:
    """``query_id, chunk_id, window, score``: every size from one table of least distances."""
    return by_window(index.gather(*window_parts(index, sizes)), sizes)


def by_window(made: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"w{w}").cast("double").alias("score")) for w in sizes])).alias("x")
    return made.select("query_id", "chunk_id", each).select("query_id", "chunk_id", "x.score", "x.window")


def mrf_features(index: Index, windows: tuple[int, ...] = (8,), *more: DataFrame) -> DataFrame:
    """``query_id, chunk_id, n, dl, hit, unigram, ordered, w<size>...``: what every mixture of MRF features needs, once."""
    made = index.gather(unigram_part(index), ordered_part(index), *window_parts(index, windows), *more)
    return made.withColumn("unigram", unigram())


def mixed(weights: tuple[float, float, float] = (0.8, 0.1, 0.1), window: int = 8) -> Column:
    return weights[0] * F.col("unigram") + weights[1] * F.col("ordered") + weights[2] * F.col(f"w{window}")


def mrf_sd(index: Index, weights: tuple[float, float, float] = (0.8, 0.1, 0.1), window: int = 8) -> DataFrame:
    """Weighted sum of the three features."""
    return mrf_features(index, (window,)).select("query_id", "chunk_id", mixed(weights, window).alias("score"))


def position_part(index: Index, window: int = 8, gaps: DataFrame | None = None) -> DataFrame:
    """``position``: over the query's adjacent pairs, 1 / (1 + least distance) by their number; a pair (t, t) is at distance 0."""
    wanted = _query_bigrams(index)
    total = wanted.groupBy("query_id").agg(F.sum("times").alias("n_pairs"))
    sorted_ = wanted.join(total, "query_id").select("query_id", (F.col("times") / F.col("n_pairs")).alias("share"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    gaps = min_gaps(index, window) if gaps is None else gaps
    gaps = gaps.where("a <> b").where(F.col("gap") <= window).unionByName(index.tf.select("chunk_id", F.col("term").alias("a"), F.col("term").alias("b"), F.lit(0).alias("gap")))
    return gaps.join(index.sent(sorted_), ["a", "b"]).select("query_id", "chunk_id", (F.col("share") / (1 + F.col("gap"))).alias("position"))


def mrf_position(index: Index, window: int = 8) -> DataFrame:
    """Mean over the query's adjacent pairs of 1 / (1 + least distance), 0 beyond the window."""
    return index.gather(position_part(index, window)).select("query_id", "chunk_id", F.col("position").cast("double").alias("score"))


def adaptive_feature_weights(n: Column, coverage: Column, base: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> list[Column]:
    """Feature weights by query length (one token has no pairs, two are a pair); low coverage shifts them to single tokens."""
    low = coverage < 0.5
    by_length = lambda one, two, more: F.when(n == 1, F.lit(one)).when(n == 2, F.lit(two)).otherwise(F.lit(more))
    u = by_length(1.0, 0.3, base[0]) * F.when(low, 1.5).otherwise(1.0)
    o = by_length(0.0, 0.6, base[1]) * F.when(low, 0.5).otherwise(1.0)
    w = by_length(0.0, 0.1, base[2]) * F.when(low, 0.5).otherwise(1.0)
    total = u + o + w
    return [u / total, o / total, w / total]


def keyword_part(index: Index, words: DataFrame, min_chars: int = 3) -> DataFrame:
    """``matches, unique, frequencies, coverage`` by the query's words of ``min_chars`` and more.

    ``words(chunk_id, n_words)`` has the white-space words of each chunk, by which frequencies are taken.
    """
    wanted = index.query_terms.where(F.length("term") >= min_chars)
    total = wanted.groupBy("query_id").agg(F.sum("qn").alias("n_wanted"))
    wanted = wanted.join(total, "query_id").select("query_id", "term", (1 / F.col("n_wanted")).alias("coverage"))
    m = index.tf.join(index.sent(wanted), "term").join(words, "chunk_id")
    return m.select("query_id", "chunk_id", F.col("tf").alias("matches"), F.lit(1).cast("long").alias("unique"), (F.col("tf") / F.col("n_words")).alias("frequencies"), "coverage")


def keyword_frequency() -> Column:
    return F.coalesce(F.try_divide("frequencies", "unique"), F.lit(0.0))


def keyword() -> Column:
    """0.4 matches + 0.4 distinct words + 20 times the mean frequency."""
    return 0.4 * F.col("matches") + 0.4 * F.col("unique") + 20 * keyword_frequency()


def keyword_match(index: Index, words: DataFrame, min_chars: int = 3) -> DataFrame:
    """``query_id, chunk_id, matches, unique, frequency, coverage``."""
    k = index.gather(keyword_part(index, words, min_chars))
    return k.select("query_id", "chunk_id", "matches", "unique", keyword_frequency().alias("frequency"), F.col("coverage").cast("double").alias("coverage"))


def keyword_score(index: Index, words: DataFrame) -> DataFrame:
    return index.gather(keyword_part(index, words)).select("query_id", "chunk_id", keyword().alias("score"))


def mrf_coverage(index: Index) -> DataFrame:
    """Share of query tokens that the chunk has."""
    return index.gather(unigram_part(index)).select("query_id", "chunk_id", "n", F.coalesce(F.try_divide("hit", "n"), F.lit(0.0)).alias("score"))


def mrf_enhanced(index: Index, window: int = 8) -> DataFrame:
    """Adaptive feature weights, plus a tenth of the position score."""
    gaps = stored(min_gaps(index, window), "gaps")
    parts = index.gather(unigram_part(index), ordered_part(index), *window_parts(index, (window,), gaps), position_part(index, window, gaps))
    parts = parts.withColumn("unigram", unigram())
    return parts.select("query_id", "chunk_id", enhanced(window).alias("score"))


def enhanced(window: int = 8) -> Column:
    weight = adaptive_feature_weights(F.col("n"), F.coalesce(F.try_divide("hit", "n"), F.lit(0.0)))
    return weight[0] * F.col("unigram") + weight[1] * F.col("ordered") + weight[2] * F.col(f"w{window}") + 0.1 * F.col("position")


#: Windows by query length with their weights, and the mixtures of the ensemble.
WINDOWS_BY_LENGTH = ((3, (3, 4, 5)), (6, (5, 6, 7)), (None, (7, 8, 9)))
WINDOW_WEIGHTS = (0.3, 0.5, 0.2)
ENSEMBLE = ((0.8, 0.1, 0.1, 8), (0.3, 0.6, 0.1, 6), (0.2, 0.1, 0.7, 10), (0.5, 0.3, 0.2, 4), (0.4, 0.3, 0.3, 12))
ENSEMBLE_WEIGHTS = ((3, (0.4, 0.3, 0.1, 0.15, 0.05)), (6, (0.25, 0.25, 0.2, 0.15, 0.15)), (None, (0.15, 0.2, 0.3, 0.2, 0.15)))


def _by_length(length: Column, table, make) -> Column:
    out = None
    for most, value in table[:-1]:
        out = F.when(length <= most, make(value)) if out is None else out.when(length <= most, make(value))
    return out.otherwise(make(table[-1][1]))


OPTIMIZED_SIZES = tuple(sorted({w for _, own in WINDOWS_BY_LENGTH for w in own}))
ENSEMBLE_SIZES = tuple(sorted({w for *_, w in ENSEMBLE}))


def optimized() -> Column:
    """Three windows around a size that follows the query's length, the middle one weighing most."""
    made = lambda own: sum(c * mixed(window=w) for c, w in zip(WINDOW_WEIGHTS, own))
    return _by_length(F.col("n"), WINDOWS_BY_LENGTH, made)


def mrf_optimized_windows(index: Index) -> DataFrame:
    return mrf_features(index, OPTIMIZED_SIZES).select("query_id", "chunk_id", optimized().alias("score"))


def ensemble() -> Column:
    """Five mixtures, weighed by the query's white-space words, ``n_words``."""
    each = [mixed((u, o, w), size) for u, o, w, size in ENSEMBLE]
    made = lambda weights: sum(c * e for c, e in zip(weights, each))
    return _by_length(F.col("n_words"), ENSEMBLE_WEIGHTS, made)


def mrf_ensemble(index: Index, query_words: DataFrame) -> DataFrame:
    """``query_words(query_id, n_words)`` has each query's white-space words."""
    f = mrf_features(index, ENSEMBLE_SIZES).join(index.sent(query_words), "query_id")
    return f.select("query_id", "chunk_id", ensemble().alias("score"))
