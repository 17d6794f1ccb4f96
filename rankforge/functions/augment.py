"""Variations of texts. Choices follow a hash of the key, so a rerun makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and what may stand for them; openings; ways to ask.
TERMS = {
    "paciente": ["usuario", "individuo", "persona"],
    "medicamento": ["fármaco", "medicina", "droga", "tratamiento"],
    "hospitalización": ["ingreso", "internamiento", "estancia hospitalaria"],
    "domicilio": ["casa", "hogar", "residencia", "vivienda"],
    "tratamiento": ["terapia", "cuidado", "intervención", "procedimiento"],
    "enfermedad": ["patología", "afección", "condición", "síndrome"],
    "síntoma": ["manifestación", "signo", "indicador", "señal"],
    "diagnóstico": ["evaluación", "valoración", "análisis", "determinación"],
    "medicina": ["farmacología", "terapéutica", "clínica", "asistencial"],
    "cuidado": ["atención", "asistencia", "vigilancia", "supervisión"],
}
QUESTION_WORDS = {
    "cómo": ["de qué manera", "de qué forma", "cuál es la forma"],
    "qué": ["cuál", "qué tipo de", "qué clase de"],
    "cuándo": ["en qué momento", "en qué instante", "a qué hora"],
    "dónde": ["en qué lugar", "en qué sitio", "en qué ubicación"],
    "quién": ["qué persona", "qué profesional", "qué individuo"],
}
OPENINGS = ["En el contexto médico, ", "Desde la perspectiva clínica, ", "En términos de asistencia sanitaria, ", "Considerando la práctica médica, ", "En el ámbito de la salud, "]
INDIRECT = ["Necesito saber ", "Me gustaría conocer ", "Quisiera que me expliques "]
DIRECT = [("¿", "?"), ("¿Podrías explicarme ", "?"), ("¿Cuál es la información sobre ", "?")]


def _draw(options: list[str], *key) -> Column:
    """One of ``options`` by the MD5 of the key."""
    number = F.conv(F.substring(F.md5(F.concat_ws("/", *[k if isinstance(k, Column) else F.lit(str(k)) for k in key])), 1, 6), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, options)), (number % len(options) + 1).cast("int"))


def _replaced(text: Column, key: Column, table: dict[str, list[str]], label: str) -> Column:
    for word, options in table.items():
        other = _draw(options, key, label, word)
        text = F.replace(F.replace(text, F.lit(word), other), F.lit(word.capitalize()), F.concat(F.upper(F.substring(other, 1, 1)), F.substring(other, F.lit(2), F.length(other))))
    return text


def _reordered(text: Column, key: Column, label: str) -> Column:
    dealt = F.transform(F.split(text, "\\. "), lambda s, i: F.struct(F.md5(F.concat_ws("/", key, F.lit(label), i.cast("string"))).alias("h"), s.alias("s")))
    return F.array_join(F.transform(F.array_sort(dealt), lambda x: x["s"]), ". ")


def paraphrases(text: Column, key: Column, n: int = 3) -> Column:
    """The text and at most ``n`` different variations: terms replaced, sentences in another order, question words replaced."""
    made = [_replaced(text, key, TERMS, f"term{i}") for i in range(n)] + [_reordered(text, key, f"order{i}") for i in range(min(2, n))] + [_replaced(text, key, QUESTION_WORDS, f"word{i}") for i in range(min(2, n))]
    return F.slice(F.array_distinct(F.array(text, *made)), 1, n + 1)


def contexts(text: Column, key: Column, n: int = 2) -> Column:
    """The text and at most ``n`` different ways to lead into it or to ask it."""
    opened = [F.concat(_draw(OPENINGS, key, f"context{i}"), text) for i in range(min(2, n))]
    indirect = [F.concat(F.lit(x), F.lower(text)) for x in INDIRECT]
    direct = [F.concat(F.lit(a), text if k == 0 else F.lower(text), F.lit(b)) for k, (a, b) in enumerate(DIRECT)]
    asked = F.when(F.endswith(text, F.lit("?")), F.array(*indirect)).otherwise(F.array(*direct))
    return F.slice(F.array_distinct(F.concat(F.array(text, *opened), asked)), 1, n + 1)
