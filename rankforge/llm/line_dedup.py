"""Line deduplication with a sharded minimal perfect hash.

1. Each text gives its distinct line keys as 128-bit hashes (map side, one row per key and text), and an
   aggregate that is partial on the map side gives each key's number of documents (distinct ids) and largest id.
2. Keys of enough documents are dealt to shards of bounded size. A shard's minimal perfect hash is built
   in levels: at each level keys that fall alone on a bit of a bitmap keep it, the others go on to the
   next, and a key's index is the rank of its bit. Beside it lie arrays by index: all 128 bits of the
   key's hash, so that no other key is taken for it, and the largest document id with the count.
3. Texts are read once more; their keys probe the arrays and the lines to drop are left out. While the
   arrays are below a stated size, every worker gets all of them; beyond it the probes (hash and
   id, no text) travel to the shards, by as many salts as keep a task's probes bounded, so that a frequent line spreads.

Defined results: a null or empty text is one empty line; rows that repeat an id are one document when documents are
counted, and all keep what the largest id keeps when that id is theirs; rows without an id don't count as documents
and keep nothing of a frequent key; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import checkpoint, text_batches, text_or_empty

#: Keys in a shard on average.
SHARD_KEYS = 100_000
#: Arrays up to this size (by their number of keys) go to every worker.
BROADCAST_BYTES = 48 << 20
BYTES_PER_KEY = 40
#: Probes of a shard's task, where they travel.
TASK_PROBES = 500_000
_NULL_ID = np.iinfo(np.int64).min


def line_key(line: bytes) -> bytes:
    """Stripped of white space at both ends, A-Z lower-cased."""
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key) >= 4 * least or len(key.decode()) >= least)


def line_hashes(text: str, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines, and the 128-bit hash of each key that is long enough (else None)."""
    lines = text.encode().split(b"\n")
    digest = xxhash.xxh3_128_digest
    return lines, [digest(k) if _long_enough(k := line_key(x), least) else None for x in lines]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash of ``h`` for each level (multiply and shift, modulo 2**64)."""
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash over distinct pairs of 64-bit halves; built from arrays, kept as arrays."""

    def __init__(self, levels: list[np.ndarray], left: np.ndarray):
        self.levels = levels  # a bit per place, as booleans
        self.ranks = [np.concatenate(([0], np.cumsum(x))) for x in levels]
        self.offsets = np.concatenate(([0], np.cumsum([int(r[-1]) for r in self.ranks]))).astype(np.int64)
        self.left = left  # keys that no level placed, sorted (hardly ever any)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, gamma: float = 1.6, most: int = 40) -> PerfectHash:
        keys, levels = a ^ _mix(b, 63), []
        while len(keys) and len(levels) < most:
            size = max(64, int(gamma * len(keys)))
            at = (_mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """An index for each probe; for one that isn't a key, -1 or that of some key."""
        keys = a ^ _mix(b, 63)
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, alone in enumerate(self.levels):
            at = (_mix(keys[rest], i) % np.uint64(len(alone))).astype(np.int64)
            hit = alone[at]
            out[rest[hit]] = self.offsets[i] + self.ranks[i][at[hit]]
            rest = rest[~hit]
        if len(rest) and len(self.left):
            at = np.minimum(np.searchsorted(self.left, keys[rest]), len(self.left) - 1)
            hit = self.left[at] == keys[rest]
            out[rest[hit]] = self.offsets[-1] + at[hit]
        return out


class Shard:
    """Perfect hash with the arrays it indexes: fingerprints, counts and largest ids."""

    def __init__(self, blob: dict):
        self.hash = PerfectHash([np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(bool) for x, n in zip(blob["levels"], blob["sizes"])], np.frombuffer(blob["left"], np.uint64))
        self.a, self.b = np.frombuffer(blob["a"], np.uint64), np.frombuffer(blob["b"], np.uint64)
        self.counts, self.largest = np.frombuffer(blob["counts"], np.int64), np.frombuffer(blob["largest"], np.int64)

    @staticmethod
    def blob(a: np.ndarray, b: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> dict:
        made = PerfectHash.build(a, b)
        order = np.empty(len(a), np.int64)
        order[made.index(a, b)] = np.arange(len(a))
        return {
            "levels": [np.packbits(x).tobytes() for x in made.levels],
            "sizes": [len(x) for x in made.levels],
            "left": made.left.tobytes(),
            "a": a[order].tobytes(),
            "b": b[order].tobytes(),
            "counts": counts[order].tobytes(),
            "largest": largest[order].tobytes(),
        }

    def holder(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each probe: whether it is a key, and the largest id that holds it."""
        at = self.hash.index(a, b)
        if not len(self.a):
            return np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        safe = np.maximum(at, 0)
        return (at >= 0) & (self.a[safe] == a) & (self.b[safe] == b), self.largest[safe]


_BLOB = "shard int, levels array<binary>, sizes array<int>, left binary, a binary, b binary, counts binary, largest binary"


def _keys_of(rows: DataFrame, least: int) -> DataFrame:
    """``a, b, _id, _text_hash``: distinct line hashes of each text."""

    def run(batches):
        for batch in text_batches(batches):
            digests, ids, texts = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {h for h in line_hashes(text, least)[1] if h is not None}
                digests += own
                ids += [i] * len(own)
                texts += [xxhash.xxh64_intdigest(text.encode(), 42) if i is None else 0] * len(own)
            a, b = _halves(digests)
            of = np.array(texts, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(ids, pa.int64()), pa.array(of)], ["a", "b", "_id", "_text_hash"])

    return rows.mapInArrow(run, "a long, b long, _id long, _text_hash long")


def _shards(frequent: DataFrame, n: int) -> DataFrame:
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["a"].to_numpy().view(np.uint64), pdf["b"].to_numpy().view(np.uint64)
        made = Shard.blob(a, b, pdf["_n"].to_numpy(np.int64), pdf["_largest"].to_numpy(np.int64))
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), **made}])

    return frequent.withColumn("shard", F.pmod("a", F.lit(n)).cast("int")).groupBy("shard").applyInPandas(build, _BLOB)


def _rewritten(batch, drops) -> pa.RecordBatch:
    n_lines, n_dropped, digests = [], [], []
    for lines, drop in drops:
        kept = [x for x, d in zip(lines, drop) if not d] if any(drop) else lines
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(kept))
        digests.append(b"\n".join(kept))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.binary())], ["_id", "n_lines", "n_dropped", "_kept"])


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per input row: ``id_col, n_lines, n_dropped, kept_text`` (the lines that stay, joined by line feeds)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("_text"))
    counts = _keys_of(rows, least_chars).groupBy("a", "b").agg(F.count_distinct("_id").alias("_n"), F.coalesce(F.max("_id"), F.lit(int(_NULL_ID))).alias("_largest"))
    frequent = checkpoint(counts.where(F.col("_n") >= least_docs))
    n_keys = frequent.count()
    n_shards = -(-n_keys // SHARD_KEYS) or 1
    shards = checkpoint(_shards(frequent, n_shards))
    schema = "_id long, n_lines long, n_dropped long, _kept binary"
    if n_keys * BYTES_PER_KEY <= broadcast_bytes:
        blobs = spark.sparkContext.broadcast([r.asDict() for r in shards.collect()])  # bounded by broadcast_bytes

        def probe(batches):
            own = {x["shard"]: Shard(x) for x in blobs.value}
            for batch in text_batches(batches):
                yield _rewritten(batch, _decide(batch, own, n_shards, least_chars))

        out = rows.mapInArrow(probe, schema)
    else:
        held = frequent.agg(F.sum("_n")).first()[0] or 0
        out = _probe_by_shard(rows, shards, n_shards, least_chars, schema, salts=int(min(4096, max(1, -(-held // (n_shards * TASK_PROBES))))))
    return out.select(F.col("_id").alias(id_col), "n_lines", "n_dropped", F.col("_kept").cast("string").alias("kept_text"))


def _decide(batch, own: dict[int, Shard], n_shards: int, least: int):
    """The lines of each text, with a flag for each that drops; a batch's keys probe together."""
    texts = [line_hashes(t, least) for t in batch.column(1).to_pylist()]
    digests = [h for _, hashes in texts for h in hashes if h is not None]
    ids = np.array([_NULL_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
    owner = np.repeat(ids, [sum(h is not None for h in hashes) for _, hashes in texts])
    a, b = _halves(digests)
    where = a.view(np.int64) % n_shards  # as pmod
    drop = np.zeros(len(a), bool)
    for s in np.unique(where):
        if int(s) in own:
            at = np.flatnonzero(where == s)
            found, largest = own[int(s)].holder(a[at], b[at])
            drop[at] = found & (largest != owner[at])
    flags = iter(drop.tolist())
    for lines, hashes in texts:
        yield lines, [h is not None and next(flags) for h in hashes]


def _probe_by_shard(rows: DataFrame, shards: DataFrame, n_shards: int, least: int, schema: str, salts: int) -> DataFrame:
    """Probes go to the shards by (shard, salt); what drops comes back as line hashes of each id.

    Whether a key drops depends on it and the id alone, so rows of one id may share their drops. Rows without an id go by
    their text as well, or all would meet in one group.
    """
    probes = _keys_of(rows, least).withColumn("shard", F.pmod("a", F.lit(n_shards)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("_id", "b"), F.lit(salts)).cast("int"))
    copies = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"_id": pd.Series([], dtype="Int64"), "_text_hash": pd.Series([], dtype="int64"), "a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})
        a, b = left["a"].to_numpy().view(np.uint64), left["b"].to_numpy().view(np.uint64)
        found, largest = Shard(right.iloc[0].to_dict()).holder(a, b)
        owner = left["_id"].astype("Int64").fillna(int(_NULL_ID)).to_numpy(np.int64)
        hit = found & (largest != owner)
        return pd.DataFrame({"_id": left["_id"].astype("Int64")[hit], "_text_hash": left["_text_hash"][hit], "a": left["a"][hit], "b": left["b"][hit]})

    drops = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, "_id long, _text_hash long, a long, b long")
    per_doc = drops.groupBy("_id", "_text_hash").agg(F.collect_set(F.struct("a", "b")).alias("_drops"))  # at most a text's own lines
    per_doc = per_doc.withColumnsRenamed({"_id": "_of", "_text_hash": "_of_text"})
    joined = rows.withColumn("_h", F.when(F.col("_id").isNull(), F.xxhash64("_text")).otherwise(F.lit(0).cast("long")))
    joined = joined.join(per_doc, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_h") == F.col("_of_text")), "left").select("_id", "_text", "_drops")

    def rewrite(batches):
        for batch in text_batches(batches):
            made = []
            for text, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone = {np.array([x["a"], x["b"]], ">i8").tobytes() for x in drops or ()}
                lines, hashes = line_hashes(text, least)
                made.append((lines, [h in gone for h in hashes]))
            yield _rewritten(batch, made)

    return joined.mapInArrow(rewrite, schema)


def line_dedup_digest(docs: DataFrame, **options) -> DataFrame:
    """``dedup_lines`` with the text that stays as its SHA-256."""
    id_col = options.get("id_col", "doc_id")
    out = dedup_lines(docs, **options)
    return out.select(id_col, "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
