"""The queries of this subpackage: one for each operator, over the whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _PLANS[name] = (fn, sql)
        return fn
    return deco


def plans() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from . import queries  # noqa: F401  (registration)
    return dict(_PLANS)
