"""Dictionaries as data: fixed values, map literals, and dictionary tables.

A dictionary is small and bounded (hundreds of entries), so the default path inlines it as a
literal map inside the expression: no join, no shuffle, one hash-set probe per token. A user
dictionary that is a table goes through joins instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as FV


def roman_pairs() -> list[tuple[str, str]]:
    """Pairs in order (duplicates kept)."""
    return FV.ROMAN_TO_NATIVE


def native_pairs() -> list[tuple[str, str]]:
    return FV.NATIVE_TO_ENGLISH


def as_lookup(pairs, lower_keys: bool) -> dict[str, str]:
    """dict semantics: a repeated key keeps its first position and its last value."""
    out: dict[str, str] = {}
    for k, v in pairs:
        out[k.lower() if lower_keys else k] = v
    return out


def roman_lookup(extra: dict[str, str] | None = None) -> dict[str, str]:
    """Default romanized dictionary with optional overrides, keys lower-cased (165 entries)."""
    base = dict(as_lookup(roman_pairs(), lower_keys=False))
    if extra:
        base.update(extra)
    return {k.lower(): v for k, v in base.items()}


def native_lookup(extra: dict[str, str] | None = None) -> dict[str, str]:
    base = as_lookup(native_pairs(), lower_keys=False)
    if extra:
        base.update(extra)
    return base


def map_literal(lookup: dict[str, str]) -> Column:
    args = []
    for k, v in lookup.items():
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def lookup_expr(key: Column, lookup: dict[str, str]) -> Column:
    """Value for ``key`` or NULL. The ``isin`` guard is a hash-set probe, so misses stay O(1)."""
    return F.when(key.isin(list(lookup)), F.try_element_at(map_literal(lookup), key))


# ---------------------------------------------------------------------------
# dictionary tables
# ---------------------------------------------------------------------------
def dictionary_table(spark: SparkSession, lookup: dict[str, str]) -> DataFrame:
    rows = [(i, k, v) for i, (k, v) in enumerate(lookup.items())]
    return spark.createDataFrame(rows, "priority long, src string, dst string")


def merge_dictionary(base: DataFrame, added: DataFrame, lower_keys: bool = True) -> DataFrame:
    """Added entries override base entries; keys lower-cased; last entry per key wins.

    Both inputs: (src, dst[, priority]). Output: (src, dst), one row per distinct key.
    """
    def prep(df, layer):
        pr = F.col("priority") if "priority" in df.columns else F.monotonically_increasing_id()
        key = F.lower("src") if lower_keys else F.col("src")
        return df.select(key.alias("src"), "dst", F.lit(layer).alias("layer"), pr.alias("priority"))

    both = prep(base, 0).unionByName(prep(added, 1))
    # one hash aggregate (partial on the map side), no per-key sort
    return both.groupBy("src").agg(F.max_by("dst", F.struct("layer", "priority")).alias("dst"))
