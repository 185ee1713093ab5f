"""T4/T5/T7 romanized -> Kannada transliteration, word by word, whitespace preserved.

Per token (runs of whitespace pass through untouched and are not recorded):

* contains a Kannada character, or has no letter -> unchanged
* dictionary, case-insensitive exact key; else the key with trailing ``.,!?;:`` removed, the
  removed part re-attached -> ``fallback``
* else unchanged

Overall method: fallback when any word was found, else unchanged.

A dictionary given as entries goes to the tasks; one given as a table does so if it is small (counted), else it is
joined on the *distinct* vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions import lexicon as LX
from ..functions import text as X

RESULT_TYPE = ("struct<original:string,transliterated:string,"
               "word_mappings:array<struct<src:string,dst:string>>,method:string,success:boolean>")


def _result(c: Column, rewritten: Column, mappings: Column) -> Column:
    """Result struct from struct(text, method) and the word mappings."""
    return F.struct(c.alias("original"), rewritten["text"].alias("transliterated"), mappings.alias("word_mappings"),
                    rewritten["method"].alias("method"), F.lit(True).alias("success"))


def _method(blank: Column, kinds: Column, words: Column) -> Column:
    """T5. A model's words beside any others -> mixed, alone -> model; scheme and fallback -> mixed; scheme; fallback;
    else unchanged. ``words``: which of the tokens are words, asked for only where a model took part."""
    has = lambda k: F.coalesce(F.exists(kinds, lambda x: x == k), F.lit(False))
    others = F.exists(F.zip_with(kinds, words, lambda k, w: w & ~k.eqNullSafe("model")), lambda x: x)
    return (F.when(blank, "unchanged").when(has("model") & others, "mixed").when(has("model"), "model")
            .when(has("scheme") & has("fallback"), "mixed").when(has("scheme"), "scheme")
            .when(has("fallback"), "fallback").otherwise("unchanged"))


def spelled_parts(toks: Column, found: Column) -> Column:
    """Per token struct(src, text, kind); ``found`` holds each token's struct(text, kind), NULL where it stays."""
    return F.zip_with(toks, found, lambda t, hit: F.struct(t.alias("src"), hit["text"].alias("text"), hit["kind"].alias("kind")))


def parts_text(c: Column, parts: Column) -> Column:
    return F.when(X.is_blank(c), c).otherwise(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], p["src"])), ""))


def parts_method(c: Column, parts: Column) -> Column:
    return _method(X.is_blank(c), F.transform(parts, lambda p: p["kind"]), F.transform(parts, lambda p: p["src"].rlike(X.FAST_NON_WS)))


def parts_mappings(c: Column, parts: Column) -> Column:
    """The words among the parts beside their spellings."""
    words = F.filter(parts, lambda p: p["src"].rlike(X.FAST_NON_WS))
    pairs = F.transform(words, lambda p: F.struct(p["src"].alias("src"), F.coalesce(p["text"], p["src"]).alias("dst")))
    return F.when(X.is_blank(c), F.array().cast("array<struct<src:string,dst:string>>")).otherwise(pairs)


def transliterated_text(c, lookup: dict[str, str] | None = None) -> Column:
    """Only the transliterated string (no mappings): what routing needs."""
    return B.transliterated(X.col_(c), lookup if lookup is not None else LX.roman_lookup())


def transliterate(df: DataFrame, col: str = "text", out: str = "transliteration",
                  dictionary: dict[str, str] | DataFrame | None = None, key: str | None = None,
                  scheme: bool = False, words: DataFrame | None = None) -> DataFrame:
    """Append the T4/T5 result struct. ``dictionary`` adds/overrides entries (T6): a dict is
    inlined; a DataFrame (src, dst) is merged over the defaults and applied through joins.
    ``words`` (src, dst) is a model's output and comes before the dictionary. ``scheme=True`` spells words
    missing from both with the ITRANS rules (T7), once per distinct word, through the same join path.
    ``key`` is not needed any more.
    """
    lookup = LX.roman_lookup()
    if isinstance(dictionary, dict):
        lookup = LX.roman_lookup(dictionary)
    if isinstance(dictionary, DataFrame) or scheme or words is not None:
        from .wordjoin import dictionary_rewrite
        merged = lookup
        if isinstance(dictionary, DataFrame):
            merged = LX.merge_dictionary(LX.dictionary_table(df.sparkSession, lookup), dictionary)
        return dictionary_rewrite(df, col, out, merged, scheme=scheme, words=words)
    tmp = df.withColumns({"_vm_new": B.rewritten(F.col(col), lookup), "_vm_maps": B.word_mappings(F.col(col), lookup)})
    return tmp.withColumn(out, _result(F.col(col), F.col("_vm_new"), F.col("_vm_maps"))).drop("_vm_new", "_vm_maps")


def dictionary_join(df: DataFrame, col: str, dictionary: DataFrame, out: str = "native") -> DataFrame:
    """Left join each token to a dictionary table (src, dst); a miss keeps the token.

    Catalyst and AQE choose the join by the dictionary's size in bytes.
    """
    d = dictionary.select(F.col("src").alias("_vm_src"), F.col("dst").alias("_vm_dst"))
    j = df.join(d, df[col] == d["_vm_src"], "left")
    return j.withColumn(out, F.coalesce(F.col("_vm_dst"), F.col(col))).drop("_vm_src", "_vm_dst")


def translit_table(df: DataFrame, key: str, text: str = "text", dictionary: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """One row for each text: key, input, output, method and whether the output differs from the input."""
    t = transliterate(df, text, "_vm_t", dictionary, key)
    out = F.col("_vm_t.transliterated")
    return t.select(key, F.col(text).alias("input"), out.alias("output"), F.col("_vm_t.method").alias("method"),
                    (~out.eqNullSafe(F.col(text))).alias("changed"))
