"""Values of distinct items brought back to the rows that hold them.

A row holds many items (words, segments), most of which have no value. Items travel by a hash of the row's text, each
once per distinct text; the table of values is joined to them, and each text gets what its items are worth: a map
(``with_hits``), or an array beside its items (``with_values``), as a map's keys are read one after another and a long
text asks for each of its words. Rows of equal texts share it, a hash that two texts share merges two tables of values,
and both are harmless: these only say what an item's value is. Repeated texts and hot items are counted once before the shuffle; AQE splits what is left of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialize

_HASH = "_vm_text_hash"


def with_hits(df: DataFrame, text: str, items: Column, table: DataFrame, out: str) -> DataFrame:
    """Adds ``out``, the map of a row's items to their values, NULL without a hit. ``table``: (item, value), one row an
    item; ``items`` depends on the text alone."""
    return _attached(df, text, _held(df, text, items), table, out)


def with_values(df: DataFrame, text: str, items: Column, values: Callable[[DataFrame], DataFrame], out: str,
                items_out: str = "_vm_items", asked: Callable[[Column], Column] | None = None,
                key: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds the row's ``items`` as ``items_out`` and ``out``, an array as long: the value of the item at each place, NULL where
    it has none or is not ``asked`` for. ``values`` gets (item), the distinct items that occur, or their ``key``s, and returns
    (item, value), one row an item. What the texts hold is written once, as both need it."""
    def wanted(of):
        named = key or (lambda t: t)
        return F.transform(of, lambda t: F.when(asked(t), named(t)) if asked else named(t)) if asked or key else of
    held = materialize(_held(df, text, wanted(items)), "held-items")
    known = held.join(values(held.select("item").distinct()), "item", "left")
    known = known.groupBy(_HASH).agg(F.sort_array(F.collect_list(F.struct("item", "value"))).alias("_vm_known"))
    # the items are cut again behind the join: they would be larger to send than the text
    rows = df.withColumn(_HASH, F.xxhash64(text)).join(known, _HASH, "left").drop(_HASH).withColumn(items_out, items)
    return rows.withColumn(out, _beside(wanted(F.col(items_out)), F.col("_vm_known"))).drop("_vm_known")


def _beside(items: Column, known: Column) -> Column:
    """The values of ``known``, (item, value) in order of the items, each beside its items. Both sides are sorted and met once;
    only where two texts share a hash, so that not the same items are on both sides, each item is looked up."""
    def merged(found, order, starts):
        ends = F.concat(F.slice(starts, 2, F.size(order)), F.array(F.size(order)))
        spread = F.flatten(F.zip_with(found, F.zip_with(starts, ends, lambda a, b: b - a), lambda k, n: F.array_repeat(k["value"], n)))
        # items of NULL come first in the order and have no values
        placed = F.zip_with(F.slice(order, F.get(starts, F.lit(0)) + 1, F.size(order)), spread,
                            lambda x, v: F.struct(x["place"].alias("place"), v.alias("value")))
        absent = F.transform(F.filter(order, lambda x: x["item"].isNull()), lambda x: F.struct(
            x["place"].alias("place"), F.get(found, F.lit(-1))["value"].alias("value")))
        return F.transform(F.sort_array(F.concat(placed, absent)), lambda x: x["value"])

    def met(found, order):
        first = lambda x, i: x["item"].isNotNull() & ~x["item"].eqNullSafe(F.get(order, i - 1)["item"])
        starts = F.filter(F.transform(order, lambda x, i: F.when(first(x, i), i)), lambda i: i.isNotNull())
        return X.let(starts, lambda s: F.when(F.size(s) == F.size(found), merged(found, order, s)).otherwise(
            X.let(F.map_from_entries(found), lambda m: F.transform(F.sort_array(F.transform(order, lambda x: F.struct(
                x["place"].alias("place"), x["item"].alias("item")))), lambda x: F.try_element_at(m, x["item"])))))
    ordered = F.sort_array(F.transform(items, lambda t, i: F.struct(t.alias("item"), i.alias("place"))))
    return F.when(known.isNull(), F.transform(items, lambda t: F.get(known, F.lit(0))["value"])).otherwise(
        X.let(ordered, lambda order: met(known, order)))


def _held(df: DataFrame, text: str, items: Column) -> DataFrame:
    tagged = df.select(F.xxhash64(text).alias(_HASH), items.alias("_vm_held"))
    return X.explode_rows(tagged, F.array_distinct("_vm_held"), "item", _HASH).distinct()


def _attached(df: DataFrame, text: str, held: DataFrame, table: DataFrame, out: str) -> DataFrame:
    hits = held.join(table, "item").groupBy(_HASH).agg(F.map_from_entries(F.collect_list(F.struct("item", "value"))).alias(out))
    return df.withColumn(_HASH, F.xxhash64(text)).join(hits, _HASH, "left").drop(_HASH)


def valued(df: DataFrame, value: Column) -> DataFrame:
    """(item, value) of the rows whose value is not NULL, the value computed once: a filter on it would be pushed below."""
    return df.select("item", F.explode_outer(F.array(value)).alias("value")).filter(F.col("value").isNotNull())
