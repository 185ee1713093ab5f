"""T8-T10 dictionary translation Kannada -> English, segment aware.

T8, per whitespace-separated word: strip ``.,!?;:`` from both ends, look the rest up, and on a
hit append ``word[len(clean):]`` (exactly what the reference appends, which for a word with a
leading mark is not its trailing punctuation); misses stay as they are; words joined by one blank.

T9: a blank text is returned as is; otherwise the stripped text is segmented (X7) and every
segment is translated. The translated string equals translating the words of the text with
sentence delimiters removed when the text is longer than the segment limit, so the string is
built without the packing fold; the fold runs only when segment pairs are asked for.

T10: precomputed translation tables (translation memories, e.g. output of a neural system) are
tried in order, for whole texts (``translate_with``) or for every segment by itself
(``translate_by_segments``); the dictionary is the last resort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions import fixed_values as FV
from ..functions import lexicon as LX
from ..functions import text as X


def translated_text(c, lookup: dict[str, str] | None = None, max_len: int = FV.MAX_SEGMENT_LEN) -> Column:
    """T9 string result: blank -> as is; else segment-equivalent word translation."""
    return B.translated(X.col_(c), lookup if lookup is not None else LX.native_lookup(), max_len)


def translate(df: DataFrame, col: str = "text", out: str = "translated",
              dictionary: dict[str, str] | None = None) -> DataFrame:
    """T8 on a column (no segmentation)."""
    lookup = LX.native_lookup(dictionary)
    c = F.col(col)
    return df.withColumn(out, F.when(X.is_blank(c), c).otherwise(F.get(B.translated_items(F.array(X.py_strip(c)), lookup), F.lit(0))))


def translate_segments(df: DataFrame, col: str = "text", out: str = "translation",
                       dictionary: dict[str, str] | None = None,
                       max_len: int = FV.MAX_SEGMENT_LEN) -> DataFrame:
    """T9 full result: struct(original, translated, source_lang, target_lang, backend, segments,
    success, error). ``segments`` is an array of (src, dst) per segment."""
    lookup = LX.native_lookup(dictionary)
    c = F.col(col)
    blank = X.is_blank(c)
    tmp = df.withColumn("_vm_segs", F.when(blank, F.array().cast("array<string>"))
                        .otherwise(X.segment_text(X.py_strip(c), max_len)))
    tmp = tmp.withColumn("_vm_dst", B.translated_items(F.col("_vm_segs"), lookup))
    tmp = tmp.withColumn("_vm_pairs", F.zip_with("_vm_segs", "_vm_dst", lambda s, d: F.struct(s.alias("src"), d.alias("dst")))).drop("_vm_dst")
    res = F.struct(
        c.alias("original"),
        F.when(blank, c).otherwise(F.array_join(F.transform("_vm_pairs", lambda p: p["dst"]), " ")).alias("translated"),
        F.lit("kn").alias("source_lang"),
        F.lit("en").alias("target_lang"),
        F.lit("fallback").alias("backend"),
        F.col("_vm_pairs").alias("segments"),
        F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error"),
    )
    return tmp.withColumn(out, res).drop("_vm_segs", "_vm_pairs")


def translate_with(df: DataFrame, col: str, sources: list[tuple[str, DataFrame]],
                   out: str = "translated", used: str = "backend",
                   dictionary: dict[str, str] | None = None) -> DataFrame:
    """Try translation tables (name, DataFrame(source_text, translated_text)) in order.

    Each table is joined on the stripped source text; the first hit wins, the dictionary is the
    last resort and is named ``fallback``. A memory with one row per distinct source text never
    multiplies rows; duplicates in a memory are reduced to one (first by text order) beforehand.
    Join strategy is Catalyst's: a memory is as large as the corpus in the worst case, so no
    broadcast is forced here (AQE converts it when its runtime size is small).
    """
    lookup = LX.native_lookup(dictionary)
    key = X.py_strip(F.col(col))
    # texts are compared by a number first: sorting whole texts against one another is what grows
    cur = df.withColumn("_vm_key", key).withColumn("_vm_hash", F.xxhash64("_vm_key"))
    names = []
    for i, (name, mem) in enumerate(sources):
        m = (mem.select(X.py_strip(F.col("source_text")).alias("_vm_key"), F.col("translated_text").alias(f"_vm_t{i}"))
             .groupBy(F.xxhash64("_vm_key").alias("_vm_hash"), "_vm_key").agg(F.min(f"_vm_t{i}").alias(f"_vm_t{i}")))
        cur = cur.join(m, ["_vm_hash", "_vm_key"], "left")
        names.append((name, f"_vm_t{i}"))
    fallback = translated_text(F.col(col), lookup)
    translated = F.coalesce(*[F.col(t) for _, t in names], fallback)
    backend = None
    for name, t in names:
        backend = F.when(F.col(t).isNotNull(), F.lit(name)) if backend is None else backend.when(F.col(t).isNotNull(), F.lit(name))
    backend = backend.otherwise(F.lit("fallback")) if backend is not None else F.lit("fallback")
    cur = cur.withColumn(out, F.when(X.is_blank(F.col(col)), F.col(col)).otherwise(translated))
    cur = cur.withColumn(used, backend)
    return cur.drop("_vm_key", "_vm_hash", *[t for _, t in names])


def memory_table(memories: list[tuple[str, DataFrame]]) -> DataFrame:
    """(item, value struct(text, source)): one row per stripped source text of the memories (name, DataFrame(source_text,
    translated_text)), from the first memory that holds it; its least translation where it holds several."""
    layers = [mem.select(X.py_strip(F.col("source_text")).alias("item"), F.lit(i).alias("layer"),
                         F.col("translated_text").alias("text"), F.lit(name).alias("source")) for i, (name, mem) in enumerate(memories)]
    both = layers[0]
    for layer in layers[1:]:
        both = both.unionByName(layer)
    both = both.filter((F.col("item") != "") & F.col("text").isNotNull())
    return both.groupBy("item").agg(F.min(F.struct("layer", "text", "source")).alias("_b")).select(
        "item", F.struct(F.col("_b.text").alias("text"), F.col("_b.source").alias("source")).alias("value"))


def segments_of(c, max_len: int = FV.MAX_SEGMENT_LEN) -> Column:
    """X7 of the stripped text; a blank text has none."""
    c = X.col_(c)
    return F.when(X.is_blank(c), F.array().cast("array<string>")).otherwise(X.segment_text(X.py_strip(c), max_len))


def with_segment_memory(df: DataFrame, text: str, memory: DataFrame, out: str, segments: str,
                        max_len: int = FV.MAX_SEGMENT_LEN) -> DataFrame:
    """Adds the text's ``segments`` and ``out``, beside each what the memory holds of it. ``memory`` (item, value) as made by
    ``memory_table``; the distinct segments are looked up in it once."""
    from .lookup import with_values

    def key(s):                 # a segment may be long: it travels as a digest
        return F.unhex(F.md5(s.cast("binary")))
    keyed = memory.select(key(F.col("item")).alias("item"), "value")
    return with_values(df, text, segments_of(text, max_len), lambda s: s.join(keyed, "item"), out, segments, key=key)


def segment_pairs(segments: Column, hits: Column, lookup: dict[str, str]) -> Column:
    """Per segment struct(src, dst, source): the memory's translation, else the dictionary's as ``fallback``."""
    missed = B.translated_items(F.zip_with(segments, hits, lambda s, hit: F.when(hit["text"].isNull(), s)), lookup)
    known = F.zip_with(segments, hits, lambda s, hit: F.struct(s.alias("src"), hit.alias("hit")))
    return F.zip_with(known, missed, lambda p, own: F.struct(
        p["src"].alias("src"), F.coalesce(p["hit"]["text"], own).alias("dst"),
        F.coalesce(p["hit"]["source"], F.lit("fallback")).alias("source")))


def joined_pairs(c: Column, pairs: Column) -> Column:
    """The translated text; a blank text as it is."""
    return F.when(X.is_blank(c), c).otherwise(F.array_join(F.transform(pairs, lambda p: p["dst"]), " "))


def used_backend(names: list[str], sources: Column) -> Column:
    """The least preferred source that a text needed, as a translator that falls back for one segment stays there; the
    first one for a text without segments."""
    order = F.array(*[F.lit(n) for n in names])
    last = F.aggregate(sources, F.lit(1), lambda a, s: F.greatest(a, F.array_position(order, s).cast("int")))
    return F.element_at(order, last)


def translate_by_segments(df: DataFrame, col: str, memories: list[tuple[str, DataFrame]] | None = None, out: str = "translation",
                          dictionary: dict[str, str] | None = None, max_len: int = FV.MAX_SEGMENT_LEN,
                          auto_fallback: bool = True) -> DataFrame:
    """T9 with T10: every segment is tried in the memories in order, the dictionary is the last resort of that segment
    alone. Appends struct(original, translated, source_lang, target_lang, backend, segments (src, dst, source), sources,
    success, error). Without ``auto_fallback`` a text with a segment that no memory holds fails: it stays as it is, without
    segments, and the error says how many were missing."""
    memories = memories or []
    lookup = LX.native_lookup(dictionary)
    c = F.col(col)
    blank = X.is_blank(c)
    if memories:
        tmp = with_segment_memory(df, col, memory_table(memories), "_vm_hits", "_vm_segs", max_len)
    else:
        tmp = df.withColumn("_vm_segs", segments_of(col, max_len)).withColumn(
            "_vm_hits", F.array().cast("array<struct<text:string,source:string>>"))
    tmp = tmp.withColumn("_vm_pairs", segment_pairs(F.col("_vm_segs"), F.col("_vm_hits"), lookup))
    missing = F.size(F.filter("_vm_pairs", lambda p: p["source"] == "fallback")) if not auto_fallback else F.lit(0)
    tmp = tmp.withColumn("_vm_missing", missing)
    failed = F.col("_vm_missing") > 0
    sources = F.array_distinct(F.transform("_vm_pairs", lambda p: p["source"]))
    names = [n for n, _ in memories] + ["fallback"]
    none = F.array().cast("array<struct<src:string,dst:string,source:string>>")
    res = F.struct(
        F.when(blank, c).otherwise(X.py_strip(c)).alias("original"),
        F.when(failed, X.py_strip(c)).otherwise(joined_pairs(c, F.col("_vm_pairs"))).alias("translated"),
        F.lit("kn").alias("source_lang"), F.lit("en").alias("target_lang"),
        F.when(failed, F.lit(names[0])).otherwise(used_backend(names, sources)).alias("backend"),
        F.when(failed, none).otherwise(F.col("_vm_pairs")).alias("segments"),
        F.when(failed, F.array().cast("array<string>")).otherwise(sources).alias("sources"),
        (~failed).alias("success"),
        F.when(failed, F.concat(F.lit("Translation failed: segments in no memory: "), F.col("_vm_missing").cast("string"))).alias("error"))
    return tmp.withColumn(out, res).drop("_vm_segs", "_vm_hits", "_vm_pairs", "_vm_missing")


def score_translations(df: DataFrame, key: str, text: str, category: str, native: str | None = None, width: int = 35,
                       memories: list[tuple[str, DataFrame]] | None = None, auto_fallback: bool = True) -> DataFrame:
    """Translations scored against their texts: key, category, backend, score (0 to 5), success, display.

    Without a ``native`` column the text is romanized: it goes through the dictionary into native script first. With
    ``memories`` (and without a fallback) backend and success are those of each row; a failed row has no score.
    """
    from .translit import transliterated_text
    src = "_vm_native"
    t = df.withColumn(src, F.col(native) if native else transliterated_text(text))
    if memories or not auto_fallback:
        t = translate_by_segments(t, src, memories, "_vm_res", auto_fallback=auto_fallback).withColumn("_vm_out", F.col("_vm_res.translated"))
        backend, success = F.col("_vm_res.backend"), F.col("_vm_res.success")
    else:
        t, backend, success = t.withColumn("_vm_out", translated_text(src)), F.lit("fallback"), F.lit(True)
    t = t.withColumn("_vm_score", X.similarity_score("_vm_out", text))
    return t.select(key, F.col(category).alias("category"), backend.alias("backend"), F.when(success, F.col("_vm_score")).alias("score"),
                    success.alias("success"), X.truncate_text(text, width).alias("display"))
