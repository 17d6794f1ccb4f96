"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made.

One pass over the texts, no exchange: each Python worker keeps bounded caches of the counts of units and
of pre-tokens, which the rest of its texts then look up.

Defined results: a null text counts as empty (0 bytes, 0 tokens); strings of added tokens inside a text
count as one token each, as the library does by default; a null id is passed through; repeated rows each
give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import text_batches, text_or_empty
from .bpe import PRE_TOKEN, Known, UnitValues, byte_symbols, count_symbols, spec

class TokenCounter:
    """Counts the tokens of a text for a byte-level BPE file as its library gives them."""

    def __init__(self, path: str):
        made = spec(path)
        ranks, vocab, shortcut, names = made["ranks"], made["vocab"], made["ignore_merges"], byte_symbols()
        pattern = regex.compile(PRE_TOKEN)
        special = regex.compile("|".join(regex.escape(s) for s in sorted(made["special"], key=len, reverse=True))) if made["special"] else None

        def word(piece: str) -> int:
            symbols = [names[b] for b in piece.encode()]
            return 1 if shortcut and "".join(symbols) in vocab else count_symbols(symbols, ranks)

        words = Known(word)
        plain = lambda s: sum(map(words.__getitem__, pattern.findall(s)))

        def unit(piece: str) -> int:
            if special is None or not special.search(piece):
                return plain(piece)
            parts = special.split(piece)
            return sum(map(plain, parts)) + len(parts) - 1

        self.special, self.values = special, UnitValues(unit)

    def count(self, text: str) -> int:
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return sum(sum(self.values.of(p)) for p in parts) + len(parts) - 1
        return sum(self.values.of(text))


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One per Python worker, so that its caches outlive a task."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: ``id_col, n_bytes, n_tokens, over_limit``."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType

    def run(batches):
        count = counter(tokenizer_path).count
        for b in text_batches(batches):
            texts = b.column(1).to_pylist()
            n = [count(t) for t in texts]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, f"_id {kind.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
