"""T1/T2 language and script detection as one narrow projection.

The cascade (thresholds configurable):

* blank -> unknown, 0.0
* Kannada share >= kannada -> kannada_script, confidence = share
* ASCII-letter share >= mixed:
    - lexicon hits >= 1 -> romanized_kannada, confidence = min(0.7*min(hits/3, 1) + boost, 1)
      where boost = 0.3*p when a language-ID signal names a top language other than "en"
    - signal says "en": english, confidence p (share >= english) or p*share
    - share >= english and no Kannada -> english, confidence = share
* either share >= mixed -> mixed, confidence = max share
* else unknown, 0.0

Without a language-ID signal (``langid=None``) the signal path is the "detector failed" path:
no boost and never "en". With ``langid=(lang_col, prob_col)`` the columns act as the signal;
:mod:`vimarsha.operators.langid` fits such a signal from a labelled table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions import text as X

DETECTION_TYPE = ("struct<language:string,confidence:double,"
                  "script_proportions:struct<kannada:double,english:double,numeric:double,other:double>,"
                  "details:string>")


def _pct(x: Column) -> Column:
    return F.format_string("%.1f", x * 100.0)


def _fill(template: str, value: Column) -> Column:
    """Put ``value`` where the template's single ``{...}`` placeholder is."""
    head, rest = template.split("{", 1)
    tail = rest.split("}", 1)[1]
    return F.concat(F.lit(head), value, F.lit(tail))


def detection_from_parts(blank: Column, props: Column, hits: Column,
                         lang: Column | None = None, prob: Column | None = None,
                         kannada: float = FV.KANNADA_THRESHOLD, english: float = FV.ENGLISH_THRESHOLD,
                         mixed: float = FV.MIXED_THRESHOLD) -> Column:
    kn, en = props["kannada"], props["english"]
    has_signal = lang is not None
    lang = lang if has_signal else F.lit(None).cast("string")
    prob = prob if has_signal else F.lit(0.0)
    is_en = F.coalesce(lang == "en", F.lit(False))
    boost = F.when(lang.isNotNull() & (lang != "en"), prob * FV.LANGID_BOOST).otherwise(F.lit(0.0))
    roman_conf = F.least(F.least(hits / FV.HIT_SATURATION, F.lit(1.0)) * FV.HIT_WEIGHT + boost, F.lit(1.0))

    latin = en >= mixed
    language = (
        F.when(blank, "unknown")
        .when(kn >= kannada, "kannada_script")
        .when(latin & (hits >= 1), "romanized_kannada")
        .when(latin & is_en, "english")
        .when(latin & (en >= english) & (kn == 0), "english")
        .when((kn >= mixed) | (en >= mixed), "mixed")
        .otherwise("unknown")
    )
    confidence = (
        F.when(blank, F.lit(0.0))
        .when(kn >= kannada, kn)
        .when(latin & (hits >= 1), roman_conf)
        .when(latin & is_en & (en >= english), prob)
        .when(latin & is_en, prob * en)
        .when(latin & (en >= english) & (kn == 0), en)
        .when((kn >= mixed) | (en >= mixed), F.greatest(kn, en))
        .otherwise(F.lit(0.0))
    )
    details = (
        F.when(blank, F.lit(FV.DETAIL_EMPTY))
        .when(kn >= kannada, _fill(FV.DETAIL_KANNADA, _pct(kn)))
        .when(latin & (hits >= 1), F.lit(FV.DETAIL_ROMANIZED))
        .when(latin & is_en & (en >= english),
              _fill(FV.DETAIL_ENGLISH_LANGID, _pct(prob)))
        .when(latin & is_en, _fill(FV.DETAIL_ENGLISH_LIKELY, _pct(en)))
        .when(latin & (en >= english) & (kn == 0),
              _fill(FV.DETAIL_ENGLISH_SHARE, _pct(en)))
        .when((kn >= mixed) | (en >= mixed),
              _fill(FV.DETAIL_MIXED, F.when(kn > en, "kannada").otherwise("english")))
        .otherwise(F.lit(FV.DETAIL_UNKNOWN))
    )
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("kannada", "english", "numeric", "other")))
    return F.struct(
        language.alias("language"),
        confidence.cast("double").alias("confidence"),
        F.when(blank, zero).otherwise(props).alias("script_proportions"),
        details.alias("details"),
    )


def detect_language(df: DataFrame, col: str = "text", out: str = "detection",
                    langid: tuple[str, str] | None = None, **thresholds) -> DataFrame:
    """Append ``out`` (struct language/confidence/script_proportions/details) to ``df``.

    Shares and hits are materialised as helper columns first so the cascade reuses them
    (Spark keeps an expensive expression from being inlined into several branches).
    """
    df2 = df.withColumns({
        "_vm_blank": X.is_blank(col),
        "_vm_props": X.script_proportions(col),
        "_vm_hits": X.lexicon_hits(col),
    })
    lang, prob = (F.col(langid[0]), F.col(langid[1])) if langid else (None, None)
    det = detection_from_parts(F.col("_vm_blank"), F.col("_vm_props"), F.col("_vm_hits"), lang, prob,
                               **thresholds)
    return df2.withColumn(out, det).drop("_vm_blank", "_vm_props", "_vm_hits")


def detect_simple(df: DataFrame, col: str = "text", out: str = "language", **kw) -> DataFrame:
    """Language column only."""
    return detect_language(df, col, "_vm_det", **kw).withColumn(out, F.col("_vm_det.language")).drop("_vm_det")


def is_kannada(language: Column) -> Column:
    """Kannada in either script."""
    return language.isin("kannada_script", "romanized_kannada")
