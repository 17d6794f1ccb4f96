"""SentencePiece encoding with byte spans, and decoding, in one pass over the texts and without an exchange.

Each Python worker holds the model and bounded caches of parts of texts, which start at blanks; where a model's
pieces or character map don't allow that, whole texts are encoded. A batch's parts are joined as packed integers, so no list
of a text's ids is made in Python.

Defined results: a null text counts as empty (an end id alone, empty decoded text); a null id is passed through; repeated rows
each give a row; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import text_batches, text_or_empty
from .piece_model import Unit, piece_model


def _joined(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype="<i4")


def encode_pieces(docs: DataFrame, model_path: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: ``id_col, ids, begins, ends, decoded``.

    ``begins`` and ``ends`` are the bytes of the original text that each id stands for (the end id, if asked for: none at
    its end; of a character given as bytes the last one has the span); ``decoded`` is what the ids decode to.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType

    def run(batches):
        model = piece_model(model_path)
        last = [Unit(np.int32(model.end).tobytes(), bytes(4), 1, 0, "")] if end else []
        for b in text_batches(batches):
            units, parts, decoded = [], [], []
            for text in b.column(1).to_pylist():
                own = model.units(text) + last
                units += own
                parts.append(len(own))
                decoded.append("".join([u.decoded for u in own]))
            stops = np.cumsum([0, *parts])
            stops = np.cumsum([0, *[u.count for u in units]])[stops]  # of each text's ids
            ids, lengths = _joined([u.ids for u in units]), _joined([u.lengths for u in units])
            ends = np.cumsum(np.concatenate([[0], lengths]))
            lead = [sum(u.lead for u in units[a : a + n]) for a, n in zip(np.cumsum([0, *parts]).tolist(), parts)] if not model.apart else 0
            shift = np.repeat(ends[stops[:-1]] - lead, np.diff(stops))  # to the start of each id's own text
            of = lambda values: pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), of(ids), of(ends[:-1] - shift), of(ends[1:] - shift), pa.array(decoded, pa.string())], ["_id", "ids", "begins", "ends", "decoded"])

    out = rows.mapInArrow(run, f"_id {kind.simpleString()}, ids array<int>, begins array<int>, ends array<int>, decoded string")
    return out.withColumnRenamed("_id", id_col)


def piece_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``, and ``span_bytes``: how many bytes of the text the spans cover."""
    made = encode_pieces(docs, model_path, True, id_col, text_col)
    covered = F.aggregate(F.zip_with("begins", "ends", lambda b, e: (e - b).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return made.select(id_col, F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), covered.alias("span_bytes"))
