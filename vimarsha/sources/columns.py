"""Choosing the text column of an arbitrary table (schema only, no data read)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import fixed_values as FV


def resolve_text_column(df: DataFrame, name: str) -> str:
    """The column must exist; the error lists what does."""
    if name not in df.columns:
        raise ValueError(missing_column(name, df.columns))
    return name


def missing_column(name: str, columns: list[str]) -> str:
    return f"Column '{name}' not found in DataFrame. Available columns: {list(columns)}"


def guess_text_column(df: DataFrame) -> str:
    """Exact (case-insensitive) known name, else first column containing one, else first column."""
    cols = list(df.columns)
    for c in cols:                      # the table's column order decides, not that of the names
        if c.lower() in FV.TEXT_COLUMN_CANDIDATES:
            return c
    for c in cols:
        if any(cand in c.lower() for cand in FV.TEXT_COLUMN_CANDIDATES):
            return c
    return cols[0]
