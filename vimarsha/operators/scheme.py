"""Rule-based spelling of out-of-vocabulary romanized words (ITRANS -> Kannada).

A word is cut into ITRANS units by one greedy longest-first regex; what a unit becomes follows from it
and the unit before it: a consonant followed by another consonant (or by nothing) takes the virama,
a vowel after a consonant becomes its vowel sign, otherwise the independent letter. Characters
outside the scheme pass through. A spelling equal to the word or still pure ASCII is rejected.

It is done once per *distinct* unknown word (see ``wordjoin``), never per occurrence: of all texts, or of those that
a task holds (``spelling``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions import text as X


def _units_pattern() -> str:
    units = list(FV.ITRANS_CONSONANTS) + list(FV.ITRANS_VOWELS) + list(FV.ITRANS_SIGNS)
    units.sort(key=len, reverse=True)
    esc = ["".join("\\" + ch if ch in ".^~" else ch for ch in u) for u in units]
    return "(?s)(" + "|".join(esc) + "|.)"


def scheme_spelling(word) -> Column:
    """ITRANS spelling of one word, or NULL when rejected."""
    w = X.col_(word)
    # one lookup per unit: what it is as a consonant, as an independent vowel, as a vowel sign, as another sign
    kinds = ([(k, (v, None, None, None)) for k, v in FV.ITRANS_CONSONANTS.items()]
             + [(k, (None, v[0], v[1], None)) for k, v in FV.ITRANS_VOWELS.items()]
             + [(k, (None, None, None, v)) for k, v in FV.ITRANS_SIGNS.items()])
    parts = ("cons", "vowel", "sign", "mark")
    table = F.create_map(*[x for k, v in kinds for x in (
        F.lit(k), F.struct(*[F.lit(y).cast("string").alias(n) for n, y in zip(parts, v)]))])
    units = F.transform(F.regexp_extract_all(w, F.lit(_units_pattern()), 1),
                        lambda u: F.struct(u.alias("u"), F.try_element_at(table, u).alias("e")))
    after = F.concat(F.array(F.lit(False)), F.transform(units, lambda x: x["e"]["cons"].isNotNull()))
    virama = F.lit(FV.VIRAMA)

    def letters(x, follows):
        e = x["e"]
        pending = F.when(follows, virama).otherwise(F.lit(""))
        return (F.when(x["u"].isNull(), pending)              # behind the last unit
                .when(e["cons"].isNotNull(), F.concat(pending, e["cons"]))
                .when(e["vowel"].isNotNull(), F.when(follows, e["sign"]).otherwise(e["vowel"]))
                .when(e["mark"].isNotNull(), e["mark"]).otherwise(F.concat(pending, x["u"])))
    spelled = F.array_join(F.zip_with(units, after, letters), "")
    rejected = X.py_strip(spelled) == w
    ascii_only = spelled.rlike("^[\\x00-\\x7F]*$")
    return F.when(~rejected & ~ascii_only, spelled)


#: What a unit is as a consonant, as an independent vowel, as a vowel sign, as another sign.
_KINDS = ({k: (v, None, None, None) for k, v in FV.ITRANS_CONSONANTS.items()} | {k: (None, *v, None) for k, v in FV.ITRANS_VOWELS.items()}
          | {k: (None, None, None, v) for k, v in FV.ITRANS_SIGNS.items()})
_UNITS = re.compile(_units_pattern())


def spelling(word: str) -> str | None:
    """``scheme_spelling`` of one word inside a task."""
    out, follows = [], False
    for u in _UNITS.findall(word):
        pending = FV.VIRAMA if follows else ""
        cons, vowel, sign, mark = _KINDS.get(u, (None,) * 4)
        if cons is not None:
            out.append(pending + cons)
        elif vowel is not None:
            out.append((sign or "") if follows else vowel)
        else:
            out.append(mark if mark is not None else pending + u)
        follows = cons is not None
    spelled = "".join(out) + (FV.VIRAMA if follows else "")
    return None if spelled.strip() == word or spelled.isascii() else spelled
