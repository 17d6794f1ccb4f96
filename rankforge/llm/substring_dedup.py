"""Substring deduplication by recompression.

Words get 64-bit names, and a few rounds name maximal runs of one symbol (first round) and pairs of adjacent
symbols (each round; a hash of the symbol and the round says whether it may stand left or right in a
pair, so pairs never overlap). A name is a hash of what it stands for, so all documents give equal
content equal names without a dictionary having to travel. Beside each symbol stands its context: the
interval of words that its making looked at. Whatever text has these same words has the symbol there.

1. Every window of ``width`` words picks, among the symbols whose context (of at most ``REACH`` words) lies inside
   it, the one of the widest context and then of the highest hash (if there is none, itself). Equal windows
   pick equal symbols. Documents give their distinct picks, and an aggregate finds those of at least two.
2. A Bloom filter of the shared picks goes to every worker while it stays below ``FILTER_BYTES`` (it can only let
   too much through); beyond that, each text is joined with its own shared picks by exchange. Windows
   whose pick is shared give a 96-bit hash of their words with their place, and one exchange brings equal ones
   together: a window whose words start in a document of a smaller id covers its words. Where very many
   documents share the pick, equal windows are dealt to salts; each salt settles all but its first document,
   and only the salts' firsts meet in a second, small exchange.
3. Covered places travel to their document, which drops the words.

Defined results: a null or blank text has no words; a null id neither removes nor loses anything; rows that
repeat an id are documents of equal rank, each judged by its own text; texts shorter than the window
are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._base import checkpoint, join_by_size, release, stored, text_batches, text_or_empty
from .bloom import Bloom, bloom_bytes, build_bloom

ROUNDS = 3
#: Widest context of a symbol that windows pick.
REACH = 8
#: Bound of the filter that goes to every worker.
FILTER_BYTES = 64 << 20
#: A pick of more documents than this is counted as frequent.
FREQUENT = 500
SALTS = 64
_BATCH = 1_000_000
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ _U((0xD6E8FEB86659FD93 * (salt + 1)) & (2**64 - 1))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(32))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(29))


class _Spans:
    """Hashes of any interval of the words, from prefix sums modulo 2**64."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        up, down = np.full(n + 1, base, _U), np.full(n + 1, pow(base, -1, 2**64), _U)
        up[0] = down[0] = 1
        self.down = np.cumprod(down, dtype=_U)
        self.sums = np.concatenate((np.zeros(1, _U), np.cumsum(words * np.cumprod(up, dtype=_U)[:n], dtype=_U)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


class _Symbols:
    """Symbols of several documents one after another; ``left``/``right`` bound the context of each."""

    def __init__(self, names: np.ndarray, doc: np.ndarray):
        self.names, self.doc = names, doc
        self.left = np.arange(len(names), dtype=np.int64)
        self.right = self.left + 1

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        """The context bounds of the symbol before and after; out of all windows' reach at a document's ends."""
        far = np.int64(1 << 40)
        first = np.concatenate(([True], self.doc[1:] != self.doc[:-1]))
        last = np.concatenate((first[1:], [True]))
        return np.where(first, -far, np.roll(self.left, 1)), np.where(last, far, np.roll(self.right, -1))

    def _take(self, heads: np.ndarray, names, left, right) -> None:
        self.names, self.left, self.right, self.doc = names[heads], left[heads], right[heads], self.doc[heads]

    def runs(self, salt: int) -> None:
        """Each maximal run of one symbol becomes a symbol; every symbol has looked at its neighbours."""
        if not len(self.names):
            return
        before, after = self._beside()
        heads = np.flatnonzero(np.concatenate(([True], (self.names[1:] != self.names[:-1]) | (self.doc[1:] != self.doc[:-1]))))
        ends = np.concatenate((heads[1:], [len(self.names)]))
        length, tails = ends - heads, ends - 1
        names = np.where(length > 1, _mix(self.names[heads] + _U(1) * length.astype(_U), salt), self.names[heads])
        self.left, self.right = np.minimum(before[heads], self.left[heads]), np.maximum(after[tails], self.right[tails])
        self.names, self.doc = names, self.doc[heads]

    def pairs(self, salt: int) -> None:
        """A left symbol and a right one after it become one; what stays alone has looked at one neighbour."""
        if not len(self.names):
            return
        is_left = (_mix(self.names, salt) & _U(1)).astype(bool)
        joins = np.concatenate((is_left[:-1] & ~is_left[1:] & (self.doc[:-1] == self.doc[1:]), [False]))
        second = np.concatenate(([False], joins[:-1]))
        before, after = self._beside()
        follow = np.roll(self.names, -1)
        names = np.where(joins, _mix(self.names * _U(3) + _mix(follow, salt), salt + 1), self.names)
        left = np.where(joins | is_left, self.left, np.minimum(self.left, before))
        right = np.where(joins, np.roll(self.right, -1), np.where(is_left, np.maximum(self.right, after), self.right))
        self._take(~second, names, left, right)


def words_of(text: str) -> list[bytes]:
    return text.encode().split()


class Windows:
    """The windows of a batch of texts: ``start`` (place in the document), ``doc`` (row), and picks."""

    def __init__(self, texts: list[str], width: int, rounds: int = ROUNDS):
        split = [words_of(t) for t in texts]
        count = np.array([len(w) for w in split], np.int64)
        digest = xxhash.xxh64_intdigest
        names = np.fromiter((digest(w) for own in split for w in own), _U, int(count.sum()))
        doc = np.repeat(np.arange(len(texts)), count)
        first = np.concatenate(([0], np.cumsum(count)))
        has = np.zeros(len(names), bool)
        for a, n in zip(first.tolist(), count.tolist()):
            if n >= width:
                has[a : a + n - width + 1] = True
        self.width, self.at = width, np.flatnonzero(has)
        self.doc, self.start = doc[self.at], self.at - first[doc[self.at]]
        self.names, self.spans = names, _Spans(names, _BASES[0])
        self.picks = self._picks(names, doc, has, rounds)[self.at]

    def _picks(self, names: np.ndarray, doc: np.ndarray, has: np.ndarray, rounds: int) -> np.ndarray:
        """Each symbol bids at the left end of its context; a window takes the best bid of its first places.

        Contexts are at most ``reach`` wide, so one that begins in the first ``width - reach + 1`` places of a
        window lies inside it. Wider contexts are rarer, so they win; then the hash decides.
        """
        symbols, bids = _Symbols(names, doc), np.zeros(len(names) + self.width, _U)
        reach = max(1, min(REACH, self.width - 1))
        for r in range(rounds):
            if r == 0:
                symbols.runs(100)
            symbols.pairs(10 * r + 1)
            size = symbols.right - symbols.left
            fits = np.flatnonzero(size <= reach)
            if not len(fits):
                break
            left, right = symbols.left[fits], symbols.right[fits]  # both rise
            bid = (_mix(self.spans.of(left, right) ^ symbols.names[fits], 7) >> _U(4)) | (size[fits].astype(_U) << _U(60))
            heads = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
            at = left[heads]
            bids[at] = np.maximum(bids[at], np.maximum.reduceat(bid, heads))
        best, seen, places = bids, 1, self.width - reach + 1
        while seen < places:
            step = min(seen, places - seen)
            best = np.maximum(best[:-step], best[step:])
            seen += step
        best = best[: len(names)].copy()
        alone = np.flatnonzero(has & (best == 0))
        best[alone] = _mix(self.spans.of(alone, alone + self.width), 7) >> _U(4)
        return best

    def hashes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the chosen windows' words."""
        at = self.at[chosen]
        other = _Spans(_mix(self.names, 5), _BASES[1])
        return _mix(self.spans.of(at, at + self.width), 3), (_mix(other.of(at, at + self.width), 4) >> _U(32)).astype(np.uint32)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))


def _parts(batches, size: int = _BATCH):
    for b in batches:
        step = max(1, b.num_rows if b.nbytes <= size else b.num_rows * size // b.nbytes)
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _own_picks(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of the picks of a batch, each once a row."""
    doc, key = w.doc, w.picks
    moved = lambda d, k: np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])))
    fresh = moved(doc, key)  # neighbours mostly share their pick
    doc, key = doc[fresh], key[fresh]
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    fresh = moved(doc, key)
    return doc[fresh], key[fresh].view(np.int64)


def _picks(rows: DataFrame, width: int, sums: bool = False) -> DataFrame:
    """``key, _id``, and with ``sums`` the text's ``_crc``: the picks of each document."""

    def run(batches):
        for b in _parts(batches):
            texts = b.column(1).to_pylist()
            w = Windows(texts, width)
            if not len(w.at):
                continue
            doc, key = _own_picks(w)
            cols = [pa.array(key), b.column(0).take(pa.array(doc))]
            if sums:
                cols.append(pa.array(np.array([zlib.crc32(t.encode()) for t in texts], np.int64)[doc]))
            yield pa.RecordBatch.from_arrays(cols, ["key", "_id", "_crc"][: len(cols)])

    return rows.mapInArrow(run, "key long, _id long" + ", _crc long" * sums)


def _shared_picks(rows: DataFrame, width: int) -> DataFrame:
    """``key, _n``: picks of at least two documents, and of how many (a document may count once a task)."""
    counted = _picks(rows, width).groupBy("key").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b"), F.count(F.lit(1)).alias("_n"))
    return counted.where("_a <> _b").select("key", "_n")


def _with_shared(rows: DataFrame, shared: DataFrame, width: int, frequent: int) -> DataFrame:
    """``_id, _text, _keys, _crowd``: texts with those of their own picks that are shared, and that are frequent.

    For shared picks too many for a filter: the picks meet their counts by exchange (what a pick of very many
    documents would send to one task is joined by broadcast), and each text gets its own.
    """
    picks = stored(_picks(rows, width, sums=True), "picks")
    met = join_by_size(picks, shared, ["key"], "_n")
    often = F.collect_set(F.when(F.col("_n") > frequent, F.col("key")))
    own = met.groupBy(F.col("_id").alias("_of"), F.col("_crc").alias("_sum")).agg(F.collect_set("key").alias("_keys"), often.alias("_crowd"))  # a text's own
    own = stored(own, "shared")
    release(rows.sparkSession)
    return rows.join(own, (F.col("_id") == F.col("_of")) & (F.crc32("_text") == F.col("_sum"))).select("_id", "_text", "_keys", "_crowd")


def _windows(rows: DataFrame, width: int, frequent: int, filter_bytes: int) -> DataFrame:
    """``_a, _c, _salt, _id, _at``: 96-bit hashes of the windows whose pick is shared, with their place; a salt above 0 where the pick is frequent."""
    spark = rows.sparkSession
    shared = checkpoint(_shared_picks(rows, width))
    release(spark)
    n, sent = shared.count(), None
    if bloom_bytes(n) <= filter_bytes:
        often = shared.where(F.col("_n") > frequent)
        sent = spark.sparkContext.broadcast([build_bloom(shared.select("key"), n), build_bloom(often.select("key"), often.count())])
    source = rows if sent else _with_shared(rows, shared, width, frequent)

    def run(batches):
        known, crowd = (Bloom(*x) for x in sent.value) if sent else (None, None)
        for b in _parts(batches):
            texts = b.column(1).to_pylist()
            w = Windows(texts, width)
            if known:
                is_shared, is_often = known.holds, crowd.holds
            else:  # keys of any row of the batch: a superset of each row's own that is as exact
                is_shared, is_often = (lambda k, c=b.column(i).flatten().to_numpy().view(_U): np.isin(k, c) for i in (2, 3))
            chosen = np.flatnonzero(is_shared(w.picks))
            if not len(chosen):
                continue
            a, c = w.hashes(chosen)
            doc = w.doc[chosen]
            crc = np.array([zlib.crc32(t.encode()) for t in texts], np.int64)[doc]
            ids = b.column(0).take(pa.array(doc))
            salt = 1 + (_mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(_U), 9) % _U(SALTS)).astype(np.int32)
            salt = np.where(is_often(w.picks[chosen]), salt, 0).astype(np.int32)
            cols = [pa.array(a.view(np.int64)), pa.array(c.view(np.int32)), pa.array(salt), ids, pa.array((crc << 32) | w.start[chosen])]
            yield pa.RecordBatch.from_arrays(cols, ["_a", "_c", "_salt", "_id", "_at"])

    return source.mapInArrow(run, "_a long, _c int, _salt int, _id long, _at long")


def covered_starts(rows: DataFrame, width: int, frequent: int = FREQUENT, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``_id, _crc, _starts``: starts of the windows whose words also start in a document of a smaller id."""
    windows = _windows(rows.where(F.col("_id").isNotNull()), width, frequent, filter_bytes)
    met = windows.withColumn("_first", F.min("_id").over(Window.partitionBy("_a", "_c", "_salt")))
    # Whoever isn't the first of its salt isn't the first of all; of a frequent window's salts the firsts are left to compare.
    open_ = F.col("_id") == F.col("_first")
    met = met.where((F.col("_id") > F.col("_first")) | (F.col("_salt") > 0))
    place = [F.shiftrightunsigned("_at", 32).alias("_crc"), F.col("_at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("_start")]
    split = met.select("_id", *place, F.when(open_, F.col("_a")).alias("_fa"), F.when(open_, F.col("_c")).alias("_fc"))
    lists = stored(split.groupBy("_id", "_crc", "_fa", "_fc").agg(F.collect_list("_start").alias("_starts")), "covered")  # a document's own
    least = F.min("_id").over(Window.partitionBy("_fa", "_fc"))
    late = lists.where("_fa IS NOT NULL").withColumn("_least", least).where("_id > _least")
    both = lists.where("_fa IS NULL").select("_id", "_crc", "_starts").union(late.select("_id", "_crc", "_starts"))
    return both.groupBy("_id", "_crc").agg(F.flatten(F.collect_list("_starts")).alias("_starts"))


def dedup_substrings(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """A row per input row: ``id_col, n_words, n_removed, kept_text`` (kept words joined by one blank)."""
    rows = _rows(docs, id_col, text_col)
    starts = stored(covered_starts(rows, width, frequent, filter_bytes), "starts").select(F.col("_id").alias("_of"), F.col("_crc").alias("_sum"), "_starts")
    release(docs.sparkSession)
    joined = rows.join(starts, (F.col("_id") == F.col("_of")) & (F.crc32("_text") == F.col("_sum")), "left").select("_id", "_text", "_starts")

    def run(batches):
        for b in text_batches(batches):
            n_words, n_removed, kept = [], [], []
            starts = b.column(2)
            for i, text in enumerate(b.column(1).to_pylist()):
                words, own = words_of(text), starts[i].values if starts[i].is_valid else None
                n_words.append(len(words))
                if own is not None:
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = own.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    words = [words[k] for k in stay.tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["_id", "n_words", "n_removed", "_kept"])

    out = joined.mapInArrow(run, "_id long, n_words long, n_removed long, _kept binary")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", F.col("_kept").cast("string").alias("kept_text"))


def substring_digest(docs: DataFrame, **options) -> DataFrame:
    """``dedup_substrings`` with the text that stays as its SHA-256."""
    out = dedup_substrings(docs, **options)
    return out.select(options.get("id_col", "doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
