"""Column expressions for text.

Everything here returns a ``Column`` that runs row-local (no shuffle). It is built from built-in functions and stays in
the JVM, but for what ``batches`` computes from a text's words on Arrow batches. Plain functions are compiled by whole-stage codegen; higher-order functions
(transform, filter, aggregate) evaluate their lambdas by interpretation inside the same stage. Regexes are written so that the same
pattern text is valid for Java regex and for RE2; the notes say where the two differ.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import batches as B
from . import fixed_values as FV

# Python's str.isspace() set, spelled out (Java ``(?U)\s`` lacks U+001C-U+001F, RE2 ``\s`` is ASCII).
WS_BODY = (r"\t\n\x0B\f\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}"
           r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = f"[{WS_BODY}]"
NON_WS = f"[^{WS_BODY}]"
# The same set for Java's matcher, which asks a class's ranges one after another: single characters below U+0100 are one
# bit set, and one range keeps all others but a few from asking for the rest. SQL engines keep the plain spelling above.
_FAST_BODY = (r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x20\x85\xA0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}"
              r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]")
_WS_CHARS = "".join(c for c in map(chr, range(0x3100)) if c.isspace())
FAST_WS = f"[{_FAST_BODY}]"
FAST_NON_WS = f"[^{_FAST_BODY}]"
KANNADA = r"[\x{0C80}-\x{0CFF}]"
ASCII_LETTER = "[A-Za-z]"
# Decimal digits outside the Kannada block (Kannada digits count as Kannada).
OTHER_DIGIT = r"[\p{Nd}&&[^\x{0C80}-\x{0CFF}]]"
# Word characters as Python's ``\w`` sees them: letters, numbers, underscore.
NON_WORD = r"[^\p{L}\p{N}_]+"
PUNCT_CLASS = "[" + "".join("\\" + c for c in FV.TRAILING_PUNCT) + "]"
SENTENCE_END = "[" + "".join("\\" + c if c in ".!?" else c for c in FV.SENTENCE_END_CHARS) + "]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---------------------------------------------------------------------------
# whitespace
# ---------------------------------------------------------------------------
def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace (``trim`` only removes U+0020)."""
    return F.btrim(col_(c), F.lit(_WS_CHARS))


def is_blank(c) -> Column:
    """NULL, empty or whitespace-only."""
    c = col_(c)
    return c.isNull() | ~c.rlike(FAST_NON_WS)


def remove_ws(c) -> Column:
    return F.regexp_replace(col_(c), f"{FAST_WS}+", "")


def split_ws(c) -> Column:
    """``str.split()`` on an already stripped, non-blank string."""
    return F.split(col_(c), f"{FAST_WS}+")


# ---------------------------------------------------------------------------
# X1/X2 script shares
# ---------------------------------------------------------------------------
def script_counts(c) -> Column:
    """struct<total,kannada,english,numeric,other: int> over non-whitespace characters."""
    return B.script_counts(col_(c))


def shares_from_counts(counts: Column) -> Column:
    """struct<kannada,english,numeric,other: double>; all 0.0 when there is no visible character."""
    def share(n, name):
        return F.when(n["total"] > 0, n[name].cast("double") / n["total"]).otherwise(F.lit(0.0)).alias(name)

    return let(counts, lambda n: F.struct(*(share(n, name) for name in ("kannada", "english", "numeric", "other"))))


def script_proportions(c) -> Column:
    return shares_from_counts(script_counts(c))


def native_char_count(c) -> Column:
    return F.regexp_count(F.coalesce(col_(c), F.lit("")), F.lit(KANNADA))


def has_native(c) -> Column:
    return col_(c).rlike(KANNADA)


# ---------------------------------------------------------------------------
# X3 lexicon hits
# ---------------------------------------------------------------------------
def word_tokens(c) -> Column:
    """Lower-cased runs of word characters (the tokens a ``\\b...\\b`` match can land on)."""
    return F.split(F.lower(col_(c)), NON_WORD)


def _weights(groups) -> dict[int, list[str]]:
    counts = Counter(w for g in groups for w in g)
    by_weight: dict[int, list[str]] = {}
    for w, n in counts.items():
        by_weight.setdefault(n, []).append(w)
    return by_weight


def lexicon_hits(c, groups=None) -> Column:
    """Whole-word hits summed over the pattern groups (a word in k groups counts k times)."""
    by_weight = _weights(groups or FV.ROMANIZED_PATTERN_GROUPS)
    return B.word_weights(col_(c), {w: n for n, words in by_weight.items() for w in words})


# ---------------------------------------------------------------------------
# X5/X6 tokens
# ---------------------------------------------------------------------------
def tokens_ws(c) -> Column:
    """Alternating runs of whitespace and non-whitespace (``re.split(r'(\\s+)')`` minus empties)."""
    return F.regexp_extract_all(col_(c), F.lit(f"{FAST_WS}+|{FAST_NON_WS}+"), 0)


def is_ws_token(t: Column) -> Column:
    return ~t.rlike(FAST_NON_WS)


def rstrip_punct(c) -> Column:
    return F.regexp_replace(col_(c), f"{PUNCT_CLASS}+$", "")


def strip_punct(c) -> Column:
    return F.regexp_replace(col_(c), f"^{PUNCT_CLASS}+|{PUNCT_CLASS}+$", "")


def split_trailing_punct(c) -> Column:
    """struct<word, punct>: the word without trailing ``.,!?;:`` and the part removed."""
    c = col_(c)
    w = rstrip_punct(c)
    return F.struct(w.alias("word"), F.substr(c, F.length(w) + 1).alias("punct"))


# ---------------------------------------------------------------------------
# X7 segmentation
# ---------------------------------------------------------------------------
def segment_text(c, max_len: int = FV.MAX_SEGMENT_LEN) -> Column:
    """Sentence split + greedy packing to ``max_len`` chars; whole words never split.

    Input is expected stripped and non-blank. Texts within the limit come back as one segment.
    """
    return B.segments(col_(c), max_len)


def words_after_segmentation(c, max_len: int = FV.MAX_SEGMENT_LEN) -> Column:
    """The word list that segmentation + per-segment word split yields, without the fold.

    Segments only drop sentence delimiters and re-join words with one blank, so for a long text
    the words are those of the text with delimiters replaced by a blank.
    """
    return let(col_(c), lambda s: split_ws(F.when(F.length(s) <= max_len, s).otherwise(
        py_strip(F.regexp_replace(s, f"{SENTENCE_END}{FAST_WS}*", " ")))))


# ---------------------------------------------------------------------------
# X11/X13/U2 word sets and lengths
# ---------------------------------------------------------------------------
def lower_word_set(c) -> Column:
    """``set(text.lower().split())`` as a distinct array."""
    return let(py_strip(F.lower(col_(c))), lambda s: F.when(
        s == "", F.array().cast("array<string>")).otherwise(F.array_distinct(split_ws(s))))


def token_overlap(a, b) -> Column:
    return F.size(F.array_intersect(lower_word_set(a), lower_word_set(b)))


def similarity_score(translated, expected) -> Column:
    """overlap / |expected words| * 5 clamped to [1, 5]; 0.0 when expected has no words."""
    return B.similarity(col_(translated), col_(expected))


def word_count(c) -> Column:
    s = py_strip(col_(c))
    return F.when(s == "", F.lit(0)).otherwise(F.size(split_ws(s)))


def truncate_text(c, n: int = 35) -> Column:
    """At most ``n`` characters, the last three of a shortened text being dots."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, max(n - 3, 0)), F.lit("..."))).otherwise(c)


# ---------------------------------------------------------------------------
# X12 character n-grams inside word boundaries
# ---------------------------------------------------------------------------
def _window_pattern(n: int) -> str:
    """Lookahead capturing every n-char window that lies inside one blank-padded word.

    Words are separated by two blanks, so a window may hold a blank only as its first or last
    character: inside a word, the word start with its leading blank, the word end with its
    trailing blank, or (n >= 3) a whole padded word of n-2 letters.
    """
    if n == 1:
        return "(?s)(?=(.))"
    alts = [f" [^ ]{{{n - 1}}}", f"[^ ]{{{n}}}", f"[^ ]{{{n - 1}}} "]
    if n >= 3:
        alts.append(f" [^ ]{{{n - 2}}} ")
    return "(?s)(?=(" + "|".join(alts) + "))"


def char_wb_ngrams(c, n_min: int = 2, n_max: int = 4) -> Column:
    """n-grams of each blank-padded lower-cased word (the ``char_wb`` analyzer), as a bag.

    Words are split on runs of whitespace. A padded word of length L yields L-n+1 grams for each
    n <= L and nothing for n > L (a padded word is never shorter than 3, so the analyzer's
    short-word case cannot arise for n_min <= 3). The text is lower-cased, its words are joined
    by two blanks with one blank at each end, and each n is a single regex pass with a lookahead
    capture (see ``_window_pattern``) -- no per-gram expression evaluation. The grams come out
    grouped by n, not by word; every consumer (counts, document frequencies, CountVectorizer)
    treats them as a bag.
    """
    if n_min > 3:
        raise ValueError("n_min above 3 needs the analyzer's short-word rule")
    s = py_strip(F.lower(col_(c)))
    padded = F.concat(F.lit(" "), F.regexp_replace(s, f"{FAST_WS}+", "  "), F.lit(" "))
    return let(padded, lambda p: F.when(p == "  ", F.array().cast("array<string>")).otherwise(padded_ngrams(p, n_min, n_max)))


def padded_ngrams(padded: Column, n_min: int, n_max: int) -> Column:
    """n-grams of lower-cased words with a blank on either side."""
    return F.concat(*[F.regexp_extract_all(padded, F.lit(_window_pattern(n)), 1) for n in range(n_min, n_max + 1)])


def explode_rows(df, arr, alias: str, *keep):
    """``explode`` that keeps expensive array expressions from being computed twice.

    A plain ``explode`` makes Catalyst infer ``size(arr) > 0`` and push it below projections (and
    below a round-robin repartition), where the array is built a second time. ``explode_outer``
    infers nothing; the NULL row it yields for an empty array is dropped on the generated column.
    """
    return df.select(*keep, F.explode_outer(arr).alias(alias)).filter(F.col(alias).isNotNull())
