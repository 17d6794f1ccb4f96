"""Every registered query of the retrieval operators, with its DuckDB oracle.

Results are made comparable in one place: doubles are rounded to six digits (and -0.0 made 0.0), whole
numbers are widened to 64 bits; ``floats`` names the columns to round in the oracle.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: Keeps exact binary fractions off the rounding boundary, where two engines may differ.
EPSILON = 1e-10
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("text", "corpus", "lexical", "vectors", "fusion", "graphs", "evaluation", "ensembles", "experiments", "preparation", "objectives", "learning", "files", "augmentation")


def comparable(df: DataFrame) -> DataFrame:
    made = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            made.append((F.round(c.cast("double") + EPSILON, 6) + F.lit(0.0)).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            made.append(c.cast("long").alias(name))
        else:
            made.append(c)
    return df.select(*made)


def query(name: str, oracle: str | None = None, floats: str = ""):
    """Registers ``f(spark, sf_dir)`` under ``name``."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(f(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        _QUERIES[name] = run
        if oracle is not None:
            rounded = ", ".join(f"round({c}::DOUBLE + {EPSILON}, 6) + 0.0 AS {c}" for c in floats.split())
            _ORACLES[name] = f"SELECT * REPLACE ({rounded}) FROM ({oracle}) AS result" if rounded else oracle
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"rankforge.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["rerank"](spark, sf_dir)
