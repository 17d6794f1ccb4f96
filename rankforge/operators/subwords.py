"""Places of words and sub-words in raw text, by character.

``Trie`` cuts a word by longest match: from the word's start among the pieces that begin words, then among those that go on. Each
Python worker holds the trie and a bounded cache of words, so a text costs a look-up for each of its words; windows over the pieces
are built-in functions on arrays of offsets.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, and other characters one by one; white space stands between them.
_WORDS = re.compile(r"\w+|[^\w\s]")
CACHE_WORDS, CACHE_CHARS = 300_000, 64
_END = object()


class Trie:
    """``start``: pieces that begin a word; ``rest``: pieces that go on. A character that no piece matches is a piece."""

    def __init__(self, start: Iterable[str], rest: Iterable[str]):
        self.start, self.rest = self._tree(start), self._tree(rest)
        self._known: dict[str, list[int]] = {}

    @staticmethod
    def _tree(pieces: Iterable[str]) -> dict:
        root: dict = {}
        for p in pieces:
            node = root
            for c in p:
                node = node.setdefault(c, {})
            node[_END] = True
        return root

    def lengths(self, word: str) -> list[int]:
        """Characters of each piece of ``word``."""
        if (made := self._known.get(word)) is not None:
            return made
        made, at, tree = [], 0, self.start
        while at < len(word):
            node, best = tree, 1
            for i in range(at, len(word)):
                if (node := node.get(word[i])) is None:
                    break
                if _END in node:
                    best = i + 1 - at
            made.append(best)
            at, tree = at + best, self.rest
        if len(self._known) < CACHE_WORDS and len(word) <= CACHE_CHARS:
            self._known[word] = made
        return made

    def offsets(self, text: str) -> tuple[list[int], list[int]]:
        """First character and one past the last of each piece of ``text``."""
        begins, ends = [], []
        for m in _WORDS.finditer(text):
            at = m.start()
            for n in self.lengths(m.group()):
                begins.append(at)
                at += n
                ends.append(at)
        return begins, ends


@lru_cache(maxsize=2)
def byte_level_trie(path: str) -> Trie:
    """The pieces of a byte-level vocabulary file that are whole characters; those with a blank in front begin words."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from U+0100
    byte = {chr(b): b for b in keep} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
    start, rest = [], []
    for piece in vocabulary:
        try:
            text = bytes(byte[c] for c in piece).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        (start if text.startswith(" ") else rest).append(text.removeprefix(" "))
    return Trie([p for p in start if p], rest)


def piece_offsets(chunks: DataFrame, vocabulary_path: str, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``id_col, text, begins, ends``: offsets of each text's sub-words, in characters from 0; a null text has none."""
    rows = chunks.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(frames):
        trie = byte_level_trie(vocabulary_path)
        for b in frames:
            made = [trie.offsets(t) for t in b.column(1).to_pylist()]
            numbers = lambda i: pa.array([m[i] for m in made], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), numbers(0), numbers(1)], ["_id", "text", "begins", "ends"])

    return rows.mapInArrow(run, f"_id {kind}, text string, begins array<int>, ends array<int>").withColumnRenamed("_id", id_col)


def subword_windows(pieces: DataFrame, size: int = 384, shared: int = 128, least: int = 20, id_col: str = "chunk_id") -> DataFrame:
    """``id_col, chunk_index, total_chunks, rel_position, length, begin, end, text``: windows of ``size`` pieces that share ``shared`` with the next.

    A text of fewer than ``least`` pieces, or of no more than it would share, gives none; nor does a window of fewer than ``least`` pieces or
    words. Places are characters of the raw text, so a window's text is a part of it as it is.
    """
    step, n = max(1, size - shared), F.size("begins")
    last = F.floor((n - shared - 1) / step)
    index = F.when((n >= least) & (n > shared), F.sequence(F.lit(0), last.cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = pieces.select(id_col, "text", "begins", "ends", n.alias("_n"), F.explode(index).alias("chunk_index"))
    first = F.col("chunk_index") * step
    to = F.least(first + size, F.col("_n"))
    rows = rows.select(
        id_col, "chunk_index", F.greatest(F.lit(1), F.floor((F.col("_n") - shared) / step)).cast("int").alias("total_chunks"), (first / F.col("_n")).alias("rel_position"),
        (to - first).alias("length"), F.get("begins", first).alias("begin"), F.get("ends", to - 1).alias("end"), "text",
    )
    rows = rows.withColumn("text", F.substring(F.col("text"), F.col("begin") + 1, F.col("end") - F.col("begin")))
    return rows.where((F.col("length") >= least) & (F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= least))


def word_places(chunks: DataFrame, words: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``id_col, word, places, n_words``: where each of ``words(word)`` stands as a whole word in the lower-cased text, in characters from 0.

    Runs of word characters are found by built-in functions; only those that are asked for leave their text.
    """
    runs = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"))
    n_words = F.size(F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda w: w != ""))
    cut = chunks.select(F.col(id_col).alias("_id"), n_words.alias("n_words"), runs.alias("_runs"))
    kind = cut.schema["_id"].dataType.simpleString()

    def run(frames):
        for b in frames:
            ids, sizes, at, word, place = [], [], [], [], []
            for i, n, parts in zip(*(c.to_pylist() for c in b.columns)):
                where = 0
                for p in parts:
                    if p[0].isalnum() or p[0] == "_":
                        ids.append(i), sizes.append(n), word.append(p), place.append(where)
                    where += len(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(sizes, pa.int32()), pa.array(word, pa.string()), pa.array(place, pa.int32())], ["_id", "n_words", "word", "place"])

    found = cut.mapInArrow(run, f"_id {kind}, n_words int, word string, place int").join(words.select("word").distinct(), "word", "left_semi")
    return found.groupBy("_id", "word", "n_words").agg(F.sort_array(F.collect_list("place")).alias("places")).withColumnRenamed("_id", id_col)


def keyword_places(queries: DataFrame, places: DataFrame, words: Column) -> DataFrame:
    """``query_id, chunk_id, word, count, frequency, places`` of each distinct word of more than two characters that a query and a text share."""
    asked = queries.select("query_id", F.explode(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))).alias("word"))
    both = places.join(asked, "word")
    return both.select("query_id", "chunk_id", "word", F.size("places").alias("count"), (F.size("places") / F.col("n_words")).alias("frequency"), "places")
