"""Text functions: Column -> Column, all inside code generation or higher-order functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of anything that is no letter, number or underscore separate tokens.
SEPARATORS = r"[^\p{L}\p{N}_]+"


def tokenize(text: Column, lowercase: bool = True) -> Column:
    """Tokens of ``text`` in order; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.filter(F.split(F.lower(text) if lowercase else text, SEPARATORS), lambda x: x != "")


def strip_accents(text: Column) -> Column:
    """Letters without their marks (canonical decomposition of the Latin letters that carry them)."""
    made = {}
    for code in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFKD", chr(code))[0]
        if plain != chr(code) and plain.isalpha():
            made[chr(code)] = plain
    return F.translate(F.regexp_replace(text, "[\u0300-\u036f]", ""), "".join(made), "".join(made.values()))


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def preprocess_text(text: Column) -> Column:
    """White space collapsed and trimmed, NUL and BOM removed, dashes and ellipsis made plain."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "[\u0000﻿]", "")
    plain = F.replace(F.replace(F.replace(clean, F.lit("–"), F.lit("-")), F.lit("—"), F.lit("-")), F.lit("…"), F.lit("..."))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def bigrams_ordered(tokens: Column) -> Column:
    """Adjacent pairs ``(a, b)``, duplicates kept."""
    n = F.size(tokens)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at(tokens, i).alias("a"), F.element_at(tokens, i + 1).alias("b")))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def bigrams_unordered(tokens: Column, window: int = 8) -> Column:
    """Distinct sorted pairs of tokens at most ``window`` places apart."""
    n = F.size(tokens)

    def ahead(x, i):
        rest = F.slice(tokens, i + 2, F.lit(window))
        return F.transform(rest, lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))

    pairs = F.array_distinct(F.flatten(F.transform(tokens, ahead)))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def windows(items: Column, size: int, stride: int, cover_all: bool = True) -> Column:
    """Structs ``(position, items)`` of windows; ``cover_all=False`` starts none in the last ``size - stride``."""
    last = F.size(items) - 1 if cover_all else F.size(items) - (size - stride) - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("position"), F.slice(items, i + 1, F.lit(size)).alias("items")))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def pack_sentences(parts: Column, limit: int = 300) -> Column:
    """Greedy packs: a sentence that would take a pack over ``limit`` words starts the next one."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("words"))

    def add(acc, s):
        n = F.size(F.split(s, " "))
        full = (acc["words"] + n > limit) & (acc["words"] > 0)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["words"] == 0), s).otherwise(F.concat(acc["open"], F.lit(". "), s)).alias("open"),
            F.when(full, n).otherwise(acc["words"] + n).alias("words"),
        )

    return F.aggregate(parts, empty, add, lambda acc: F.when(acc["words"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def normalize_doc_name(name: Column) -> Column:
    """The stem before a variant suffix: ``x_limpio.txt (Contexto 2)`` -> ``x_limpio``."""
    return F.substring_index(F.replace(name, F.lit("_limpio.txt"), F.lit("_limpio")), " (", 1)


def text_preview(text: Column, n: int = 100) -> Column:
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def is_sentence(text: Column) -> Column:
    """20 to 500 characters, not digits alone, at least three words."""
    return F.length(text).between(20, 500) & ~text.rlike("^[0-9]+$") & (F.size(whitespace_words(text)) >= 3)
