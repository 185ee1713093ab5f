"""Registry of checkable plans: name -> (Spark plan builder, DuckDB oracle SQL or None).

Every plan reads the given tables (or data Spark derives from them) in full; the work grows
with the tables. Plans are grouped by topic in sibling modules that call :func:`register`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table

_PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _PLANS[name] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def plans() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from . import q_text, q_pipeline, q_metrics, q_reports, q_learning, q_lookup, q_evaluation  # noqa: F401  (registration)
    return dict(_PLANS)
