"""Label and value recoding as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as FV
from .text import col_, py_strip


def rating_to_sentiment(rating) -> Column:
    """>=4 Positive, <=2 Negative, else Neutral."""
    r = col_(rating)
    return F.when(r >= 4, "Positive").when(r <= 2, "Negative").otherwise("Neutral")


def normalize_label(label, strict: bool = False) -> Column:
    """Trim, known spelling -> canonical, else title case; unknown -> error (strict) or NULL."""
    s = py_strip(col_(label))
    known = F.create_map(*[F.lit(x) for kv in FV.LABEL_ALIASES.items() for x in kv])
    canon = F.coalesce(F.try_element_at(known, s), F.when(s.isin(FV.LABELS), s), F.initcap(s))
    ok = canon.isin(FV.LABELS)
    bad = F.raise_error(F.concat(F.lit("Unknown IndicSentiment label: "), F.coalesce(col_(label), F.lit("None"))))
    return F.when(ok, canon).otherwise(bad.cast("string") if strict else F.lit(None).cast("string"))


def recode(c, mapping: dict, default=None, keep_unmapped: bool = False) -> Column:
    """Literal mapping; unmapped -> ``default`` (or the value itself when ``keep_unmapped``)."""
    c = col_(c)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    hit = F.try_element_at(m, c)
    fallback = c if keep_unmapped else F.lit(default)
    return F.coalesce(hit, fallback)
