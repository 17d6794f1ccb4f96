"""Exact deduplication: group by 128-bit content hash, keep the smallest id, compare bytes inside groups.

1. One pass over the texts gives each row's id, two hashes of its raw text (which name the row) and the MD5 and
   SHA-256 of its normalised text; these few bytes a row are stored, and grouped by MD5.
2. Only rows whose MD5 repeats bring their text: they are grouped by (MD5, normalised text), so texts whose
   hashes collide still form two groups. That aggregate is partial on the map side; a text that a third of
   the corpus repeats reaches the exchange once per task. Rows are picked out by a broadcast of the raw hashes that
   repeat while these are at most ``BROADCAST_ROWS``; beyond that every text takes part in the same aggregate,
   with the same result.
3. The decision returns to the stored rows; groups that hold more than a ten-thousandth of all rows are joined
   by broadcast, so no hot group meets in one task.

Defined results: a null text counts as empty; a null id never wins against another id (its row is not kept where
another id holds the text); in a group whose ids are all null every row is kept; rows that repeat the
smallest id of their group are all kept, as one id names one document; an empty table gives an empty result;
other columns are ignored, whatever their names. ``drop_exact_copies`` drops exactly the rows that
``exact_dedup`` calls not kept, each by its own id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import SPACE_CLASS, join_by_size, stored, text_or_empty

#: Rows of two 64-bit hashes that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: A losing row (by id and text) that holds more than this share of all losing rows is dropped by broadcast.
_HEAVY = 10_000


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), f"{SPACE_CLASS}+", " ")


def _raw(text_col: str) -> list[Column]:
    text = text_or_empty(text_col)
    return [F.xxhash64(text).alias("_r1"), F.xxhash64(F.lit("raw"), text).alias("_r2")]


def _hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _r1, _r2, _md5, _sha`` of each row."""
    rows = docs.select(F.col(id_col).alias("_id"), *_raw(text_col), normalised(text_col).cast("binary").alias("_text"))
    return stored(rows.select("_id", "_r1", "_r2", F.unhex(F.md5("_text")).alias("_md5"), F.unhex(F.sha2("_text", 256)).alias("_sha")), "hashes")


def _classes(docs: DataFrame, hashes: DataFrame, text_col: str, id_col: str, broadcast_rows: int) -> DataFrame:
    """One row per distinct normalised text: ``_md5, _sha, keep_id, group_size``."""
    per_hash = stored(hashes.groupBy("_md5").agg(F.count(F.lit(1)).alias("group_size"), F.min("_id").alias("keep_id"), F.max("_sha").alias("_sha")), "groups")
    raws = join_by_size(hashes, per_hash.where("group_size > 1").select("_md5", "group_size"), ["_md5"], "group_size").groupBy("_r1", "_r2").agg(F.lit(1).alias("_one"))
    raws = stored(raws.select("_r1", "_r2"), "raws")
    rows = docs.select(F.col(id_col).alias("_id"), *_raw(text_col), normalised(text_col).alias("_text"))
    if raws.count() <= broadcast_rows:
        rows = rows.join(F.broadcast(raws), ["_r1", "_r2"], "left_semi")
    keyed = rows.select("_id", F.unhex(F.md5(F.col("_text").cast("binary"))).alias("_md5"), "_text")
    same = keyed.groupBy("_md5", "_text").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    same = same.select("_md5", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha"), "keep_id", "group_size")
    if raws.count() > broadcast_rows:
        return same
    return same.unionByName(per_hash.where("group_size = 1"))


def _decided(docs: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """``_id, _r1, _r2, _sha, keep_id, group_size, kept`` of each row."""
    hashes = _hashes(docs, id_col, text_col)
    classes = stored(_classes(docs, hashes, text_col, id_col, broadcast_rows), "classes")
    joined = join_by_size(hashes, classes, ["_md5", "_sha"], "group_size")
    return joined.withColumn("kept", F.col("_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row per input row: ``id_col, keep_id, group_size, kept, text_sha256`` (of the normalised text)."""
    made = _decided(docs, id_col, text_col, broadcast_rows)
    return made.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` doesn't keep: an anti join on their id and raw text."""
    lost = _decided(docs, id_col, text_col, broadcast_rows).where(~F.col("kept"))
    lost = stored(lost.groupBy(F.col("_id").alias("_lost"), "_r1", "_r2").agg(F.count(F.lit(1)).alias("_n")), "lost")
    total = lost.agg(F.sum("_n")).first()[0] or 0
    r1, r2 = _raw(text_col)
    for part in (F.broadcast(lost.where(F.col("_n") * _HEAVY > total)), lost.where(F.col("_n") * _HEAVY <= total)):
        docs = docs.join(part, docs[id_col].eqNullSafe(part["_lost"]) & (r1 == part["_r1"]) & (r2 == part["_r2"]), "left_anti")
    return docs
