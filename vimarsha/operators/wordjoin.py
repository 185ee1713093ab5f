"""Spellings of words from tables and rules: user dictionaries too large to inline, a model's output, the rule scheme.

Tables of few and short entries, counted, are sent to the tasks, which look up (and spell) the distinct words of their texts;
nothing is shuffled. Else the distinct words of all texts are looked up (and spelled) once; each text gets the spellings
beside its words and is rewritten in place (see ``lookup``). Blank runs and words that stay never travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions import lexicon as LX
from ..functions import text as X
from ..session import materialize
from .lookup import valued, with_values

#: Entries, and bytes of them, of the tables that tasks may hold.
TASK_ENTRIES, TASK_BYTES = 200_000, 16 << 20


def is_open(t: Column) -> Column:
    """Whether a spelling may change the token: one with a letter and no native character."""
    return t.rlike(r"\p{L}") & ~X.has_native(t)


def spellings(items: DataFrame, dictionary: DataFrame | None = None, words: DataFrame | None = None,
              scheme: bool = False) -> DataFrame:
    """(item, value struct(text, kind)) of the distinct words (item) that change: by a model's ``words`` (src, dst; exact
    word), then by the ``dictionary`` (src, dst; lower-cased word, else without trailing marks), then by the scheme."""
    tries = []
    if words is not None:
        model = words.filter("dst is not null").groupBy(F.col("src").alias("item")).agg(F.min("dst").alias("_model"))
        items = items.join(model, "item", "left")
        tries.append(("_model", "model"))
    if dictionary is not None:
        d = dictionary.select(F.col("src").alias("_k"), F.col("dst").alias("_v"))
        items = items.withColumn("_low", F.lower("item")).withColumn("_stem", X.rstrip_punct("_low"))
        items = items.join(d.select(F.col("_k").alias("_low"), F.col("_v").alias("_exact")), "_low", "left")
        items = items.join(d.select(F.col("_k").alias("_stem"), F.col("_v").alias("_by_stem")), "_stem", "left")
        by_stem = F.concat(F.col("_by_stem"), F.substr(F.col("_low"), F.length("_stem") + 1))
        items = items.withColumn("_dict", F.coalesce("_exact", by_stem))
        tries.append(("_dict", "fallback"))
    if scheme:
        from .scheme import scheme_spelling
        known = [F.col(c).isNull() for c, _ in tries]
        spelled = scheme_spelling("item")
        items = items.withColumn("_scheme", F.when(_all(known), spelled) if known else spelled)
        tries.append(("_scheme", "scheme"))
    value = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("text"), F.lit(kind).alias("kind"))) for c, kind in tries])
    return valued(items, value)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def with_spellings(df: DataFrame, text: str, source: Column, out: str, mappings: str, dictionary: dict[str, str] | DataFrame,
                   words: DataFrame | None = None, scheme: bool = False) -> DataFrame:
    """Adds ``out``, struct(text, method) of ``source``, the text or NULL: each word spelled by ``words``, then by the ``dictionary``
    (as in ``spellings``), then by the scheme; and ``mappings``, its words beside their spellings."""
    def entries(table: DataFrame) -> DataFrame:
        kept = table.select("src", "dst").filter("src is not null and dst is not null")
        return kept.groupBy("src").agg(F.min("dst").alias("dst"))

    def held(table: DataFrame) -> dict[str, str] | None:
        size = table.agg(F.count("*").alias("n"), F.sum(F.octet_length("src") + F.octet_length("dst")).alias("bytes")).first()
        return {r.src: r.dst for r in table.collect()} if size.n <= TASK_ENTRIES and (size.bytes or 0) <= TASK_BYTES else None
    if words is not None:
        words = materialize(entries(words), "model-words")
    if isinstance(dictionary, DataFrame):
        dictionary = materialize(entries(dictionary), "dictionary")
    model = {} if words is None else held(words)
    known = held(dictionary) if model is not None and isinstance(dictionary, DataFrame) else dictionary
    if model is not None and isinstance(known, dict):
        from .scheme import spelling
        sent, rule = df.sparkSession.sparkContext.broadcast((known, model)), spelling if scheme else None
        return df.withColumns({out: B.rewritten(source, sent, rule), mappings: B.word_mappings(source, sent, rule)})
    from .translit import parts_mappings, parts_method, parts_text, spelled_parts
    table = dictionary if isinstance(dictionary, DataFrame) else LX.dictionary_table(df.sparkSession, dictionary).select("src", "dst")
    tmp = with_values(df, text, X.tokens_ws(source), lambda w: spellings(w, table, words, scheme), "_vm_found", "_vm_toks", is_open)
    parts = F.col("_vm_parts")
    tmp = tmp.withColumn("_vm_parts", spelled_parts(F.col("_vm_toks"), F.col("_vm_found"))).drop("_vm_toks", "_vm_found")
    return tmp.withColumns({out: F.struct(parts_text(source, parts).alias("text"), parts_method(source, parts).alias("method")),
                            mappings: parts_mappings(source, parts)}).drop("_vm_parts")


def dictionary_rewrite(df: DataFrame, col: str, out: str, dictionary: dict[str, str] | DataFrame, key: str | None = None,
                       scheme: bool = False, words: DataFrame | None = None) -> DataFrame:
    """Same result struct as the inline transliteration, with words from tables. Rows need no key."""
    from .translit import _result
    tmp = with_spellings(df, col, F.col(col), "_vm_new", "_vm_maps", dictionary, words, scheme)
    return tmp.withColumn(out, _result(F.col(col), F.col("_vm_new"), F.col("_vm_maps"))).drop("_vm_new", "_vm_maps")
