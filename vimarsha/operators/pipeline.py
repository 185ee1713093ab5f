"""Route, score and flatten a whole table in one narrow stage.

``analyze(df, text_col)`` returns one row per input row with the 11 result columns
(``RESULT_COLUMNS``), plus any ``keep`` columns (carry the row key to re-attach anything).
Nothing is collected and, unless words or segments are looked up in tables, nothing shuffles: detection,
transliteration, translation and the default scorer are columns, their words gone through on Arrow batches inside the
tasks; a row of another route hands NULL to a step, so English rows never pay for translation.

Routing per detected language:

* kannada_script -> translate -> score
* romanized_kannada -> transliterate -> translate -> score
* english -> score as is
* mixed / unknown -> score as is, with the warning ``Language is '<x>'; attempting direct ...``

NULL input is skipped with ``Expected str, got NoneType``; blank input with
``Empty or whitespace-only string``. Row status: skipped / ok_with_warnings (any message) / ok.
Per-row wall-clock timings have no meaning inside a fused stage: ``processing_time_s`` is NULL
for processed rows and 0.0 for skipped rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions import fixed_values as FV
from ..functions import lexicon as LX
from ..functions import text as X
from ..sources.columns import resolve_text_column
from .detect import detect_language
from .score import LexiconScorer
from .translate import joined_pairs, memory_table, segment_pairs, translated_text, with_segment_memory
from .translit import transliterated_text
from .wordjoin import with_spellings

RESULT_COLUMNS = [
    "original_text", "detected_language", "detection_confidence", "transliterated_text",
    "translated_text", "sentiment_label", "confidence_score", "pipeline_steps", "errors",
    "processing_time_s", "status",
]


def route(df: DataFrame, text_col: str, lang_col: str = "_vm_lang",
          roman_dictionary: dict[str, str] | None = None,
          native_dictionary: dict[str, str] | None = None, words: DataFrame | None = None, scheme: bool = False,
          memory: DataFrame | None = None) -> DataFrame:
    """Add ``_vm_translit``, ``_vm_translated``, ``_vm_tfs`` (text for scoring), ``_vm_route_err``, and how they were
    made: ``_vm_method``, ``_vm_sources``.

    ``words`` (src, dst) and ``scheme`` spell words beside the dictionary, ``memory`` (item, value) translates segments. Both
    are looked up for the distinct words and segments of the rows that need them.
    """
    rl = LX.roman_lookup(roman_dictionary)
    nl = LX.native_lookup(native_dictionary)
    c, lang = F.col(text_col), F.col(lang_col)
    is_rom = lang == "romanized_kannada"
    is_kn = lang == "kannada_script"
    none = F.lit(None).cast("string")
    if words is not None or scheme:
        out = with_spellings(df, text_col, F.when(is_rom, c), "_vm_new", "_vm_maps", rl, words, scheme)
        out = out.withColumns({"_vm_translit": F.when(is_rom, F.col("_vm_new.text")),
                               "_vm_method": F.when(is_rom, F.col("_vm_new.method"))}).drop("_vm_new", "_vm_maps")
    elif memory is not None:
        out = df.withColumns({"_vm_translit": transliterated_text(F.when(is_rom, c), rl), "_vm_method": none})
    else:                       # both steps in one evaluation: each has Python workers of its own
        out = df.withColumn("_vm_both", B.routed(F.when(is_rom, c), F.when(is_kn, c), rl, nl, FV.MAX_SEGMENT_LEN))
        out = out.withColumns({"_vm_translit": F.col("_vm_both.translit"), "_vm_method": none})
    if memory is not None:
        src = F.when(is_kn, c).when(is_rom, F.col("_vm_translit"))
        out = with_segment_memory(out.withColumn("_vm_native", src), "_vm_native", memory, "_vm_hits", "_vm_segs")
        out = out.withColumn("_vm_pairs", F.when(is_kn | is_rom, segment_pairs(F.col("_vm_segs"), F.col("_vm_hits"), nl)))
        out = out.withColumns({"_vm_translated": F.when(is_kn | is_rom, joined_pairs(F.col("_vm_native"), F.col("_vm_pairs"))),
                               "_vm_sources": F.array_distinct(F.transform("_vm_pairs", lambda p: p["source"]))})
        out = out.drop("_vm_native", "_vm_segs", "_vm_hits", "_vm_pairs")
    else:
        # NULL for the rows of other routes, which cost nothing
        if "_vm_both" in out.columns:
            translated = F.col("_vm_both.translated")
        else:
            translated = translated_text(F.when(is_kn, c).when(is_rom, F.col("_vm_translit")), nl)
        out = out.withColumns({"_vm_translated": translated, "_vm_sources": F.lit(None).cast("array<string>")}).drop("_vm_both")
    return out.withColumns({
        "_vm_tfs": F.when(is_kn | is_rom, F.col("_vm_translated")).otherwise(c),
        "_vm_route_err": F.when(~lang.isin("kannada_script", "romanized_kannada", "english"),
                                F.concat(F.lit("Language is '"), lang,
                                         F.lit("'; attempting direct sentiment classification."))),
    })


def pipeline_steps(lang: Column, classified: Column) -> Column:
    """Executed steps in order."""
    steps = F.array(
        F.lit(FV.STEP_DETECT),
        F.when(lang == "romanized_kannada", F.lit(FV.STEP_TRANSLIT)),
        F.when(lang.isin("kannada_script", "romanized_kannada"), F.lit(FV.STEP_TRANSLATE)),
        F.when(classified, F.lit(FV.STEP_SENTIMENT)),
    )
    return F.filter(steps, lambda s: s.isNotNull())


def analyze(df: DataFrame, text_col: str = "text", scorer=None, keep: list[str] | None = None,
            nested: bool = False, langid: tuple[str, str] | None = None,
            roman_dictionary: dict[str, str] | None = None,
            native_dictionary: dict[str, str] | None = None, scheme: bool = False, words: DataFrame | None = None,
            memories: list[tuple[str, DataFrame]] | DataFrame | None = None, details: bool = False, **thresholds) -> DataFrame:
    """T14. ``nested=True`` keeps ``pipeline_steps`` and ``errors`` as arrays (per-text result).

    ``scheme=True`` spells unknown words of romanized texts by the rules (T7), ``words`` (src, dst) are a model's spellings
    and come first; ``memories``, an ordered list (name, DataFrame(source_text, translated_text)) or a table made of it by
    ``translate.memory_table``, translate segments before the dictionary does (T10). Distinct words and segments are looked
    up once and joined back; without these three the plan stays one narrow stage. ``details`` adds
    ``transliteration_method`` and ``translation_sources`` (in order of use, joined by ", ").
    """
    text_col = resolve_text_column(df, text_col)
    keep = list(keep or [])
    scorer = scorer or LexiconScorer()
    c = F.col(text_col)
    base = df.select(*keep, *([] if text_col in keep else [text_col]),
                     *([F.col(x) for x in langid] if langid else []))
    base = base.withColumn("_vm_skip", F.when(c.isNull(), F.lit(FV.MSG_NOT_STRING))
                           .when(X.is_blank(c), F.lit(FV.MSG_BLANK)))
    det = detect_language(base, text_col, "_vm_det", langid=langid, **thresholds)
    det = det.withColumn("_vm_lang", F.col("_vm_det.language"))
    memory = memories if isinstance(memories, DataFrame) else memory_table(memories) if memories else None
    routed = route(det, text_col, "_vm_lang", roman_dictionary, native_dictionary, words, scheme, memory)
    routed = routed.withColumn("_vm_has_text", F.coalesce(F.length("_vm_tfs") > 0, F.lit(False)))
    scored = scorer.score(routed.withColumn("_vm_score_in", F.when(F.col("_vm_has_text"), F.col("_vm_tfs"))
                                            .otherwise(F.lit(""))), "_vm_score_in", "_vm_sent")
    skip = F.col("_vm_skip")
    ok = skip.isNull()
    lang = F.col("_vm_lang")
    classified = F.col("_vm_has_text")
    errors = F.filter(F.array(F.col("_vm_route_err"),
                              F.when(~classified, F.lit(FV.MSG_NO_TEXT))), lambda e: e.isNotNull())
    steps = pipeline_steps(lang, classified)
    if nested:
        steps_out = F.when(ok, steps).otherwise(F.array().cast("array<string>"))
        errors_out = F.when(ok, errors).otherwise(F.array(skip))
    else:
        steps_out = F.when(ok, F.array_join(steps, ", ")).otherwise(F.lit(""))
        errors_out = F.when(ok, F.array_join(errors, "; ")).otherwise(skip)
    result = scored.select(
        *keep,
        c.alias("original_text"),
        F.when(ok, lang).otherwise(F.lit("unknown")).alias("detected_language"),
        F.when(ok, F.round(F.col("_vm_det.confidence"), 4)).otherwise(F.lit(0.0)).alias("detection_confidence"),
        F.when(ok, F.col("_vm_translit")).alias("transliterated_text"),
        F.when(ok, F.col("_vm_translated")).alias("translated_text"),
        F.when(ok & classified, F.col("_vm_sent.label")).otherwise(F.lit("Neutral")).alias("sentiment_label"),
        F.when(ok & classified, F.round(F.col("_vm_sent.confidence"), 4)).otherwise(F.lit(0.0)).alias("confidence_score"),
        steps_out.alias("pipeline_steps"),
        errors_out.alias("errors"),
        F.when(ok, F.lit(None).cast("double")).otherwise(F.lit(0.0)).alias("processing_time_s"),
        F.when(~ok, F.lit("skipped")).when(F.size(errors) > 0, F.lit("ok_with_warnings"))
         .otherwise(F.lit("ok")).alias("status"),
        *([F.when(ok, F.col("_vm_method")).alias("transliteration_method"),
           F.when(ok, F.array_join("_vm_sources", ", ")).alias("translation_sources")] if details else []),
    )
    return result


# ---------------------------------------------------------------------------
# P3-P5 helpers on result tables
# ---------------------------------------------------------------------------
def validate_text(df: DataFrame, col: str = "text", out: str = "skip_reason") -> DataFrame:
    """Reason a row is skipped (NULL -> not a string; blank -> empty), else NULL."""
    c = F.col(col)
    return df.withColumn(out, F.when(c.isNull(), F.lit(FV.MSG_NOT_STRING))
                         .when(X.is_blank(c), F.lit(FV.MSG_BLANK)))


def row_status(errors: Column, skipped: Column | None = None, failed: Column | None = None) -> Column:
    """Error / skipped / ok_with_warnings (any message in the flat ``errors`` text) / ok."""
    branches = [(failed, "error"), (skipped, "skipped"),
                (F.coalesce(F.length(errors), F.lit(0)) > 0, "ok_with_warnings")]
    expr = None
    for cond, value in branches:
        if cond is None:
            continue
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit("ok"))


def flatten_result(df: DataFrame, steps: str = "pipeline_steps", errors: str = "errors") -> DataFrame:
    """P5: arrays to the flat text form (steps joined by ", ", errors by "; ")."""
    return df.withColumns({steps: F.array_join(F.col(steps), ", "), errors: F.array_join(F.col(errors), "; ")})


# FIXED VALUES -- the columns of a result table that are shown, in this order
DISPLAY_COLUMNS = [
    "original_text", "sentiment_label", "confidence_score", "detected_language", "transliterated_text",
    "translated_text", "errors", "status", "processing_time_s",
]


def processed(df: DataFrame, status: str = "status") -> DataFrame:
    """P10: rows that went through, warnings included."""
    return df.filter(F.col(status).isin("ok", "ok_with_warnings"))


def errors_only(df: DataFrame, correct: str = "correct", errors: str = "errors") -> DataFrame:
    """P10: wrong predictions that left a message."""
    return df.filter(~F.col(correct) & (F.length(errors) > 0))


def select_result_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns of a result table to show, in the given order; those that it lacks are left out."""
    return df.select(*[c for c in (columns or DISPLAY_COLUMNS) if c in df.columns])
