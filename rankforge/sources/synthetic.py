"""Synthetic chunks and relevance, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sample sentences of the synthetic chunks.
TEXTS = (
    "El paciente mejora tras ajustar la presión positiva.", "La dosis inhalada se reparte en tres tomas al día.", "El equipo revisa el protocolo de higiene de manos.",
    "La consulta integra enfermería, cirugía y radiología.", "El informe recoge constantes cada cuatro horas.", "La vía venosa se cura con técnica estéril.",
    "El traslado se hace con monitor y oxígeno.", "La nutrición se adapta a la función renal.", "El alta incluye pauta escrita y teléfono.", "La alarma avisa cuando baja la saturación.",
)
DIMS = 384


def chunks(spark: SparkSession, n: int, dims: int = DIMS, seed: str = "chunk") -> DataFrame:
    """``id, text, doc_id, position, embedding, meta``: ten chunks a document, five categories."""
    i = F.col("id")
    unit = lambda k: F.pmod(F.xxhash64(F.lit(seed), i, k), F.lit(1 << 32)) / float(1 << 32)
    text = F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (i % len(TEXTS) + 1).cast("int"))
    return spark.range(n).select(
        F.format_string("chunk_%03d", i).alias("id"), text.alias("text"), F.format_string("doc_%02d", F.floor(i / 10)).alias("doc_id"), (i % 10).cast("int").alias("position"),
        F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), unit).alias("embedding"), F.create_map(F.lit("category"), F.concat(F.lit("category_"), (i % 5).cast("string"))).alias("meta"),
    )


def qrels(made: DataFrame, queries: int = 5, share: float = 0.2, seed: str = "qrel") -> DataFrame:
    """``query, id``: for each query about ``share`` of the chunks, by a hash."""
    asked = made.select("id", F.explode(F.sequence(F.lit(1), F.lit(queries))).alias("q"))
    return asked.where(F.pmod(F.xxhash64(F.lit(seed), "q", "id"), F.lit(1000)) < int(1000 * share)).select(F.concat(F.lit("query "), F.col("q").cast("string")).alias("query"), "id")
