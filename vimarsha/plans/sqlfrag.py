"""DuckDB SQL text for the oracle side of the correctness check.

Each helper returns a SQL expression string that computes, in DuckDB, what the matching
column expression computes in Spark. RE2 has no class intersection and no look-behind, so
some patterns are phrased differently; the values are the same.
"""

from __future__ import annotations

from ..functions import fixed_values as FV
from ..functions import lexicon as LX
from ..functions import text as X
from ..functions.text import _weights

WS = X.WS
NON_WS = X.NON_WS
KANNADA = X.KANNADA


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR NOT regexp_matches({x}, '{NON_WS}'))"


def remove_ws(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', '', 'g')"


def count_of(x: str, pattern: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{pattern}', '', 'g')))"


def split_ws(x: str) -> str:
    return f"regexp_split_to_array({x}, '{WS}+')"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def script_counts_cte_cols(x: str) -> str:
    """Columns total, kn, en, num from text expression x (needs nows computed: pass it)."""
    return (f"length({x}) AS _total, {count_of(x, KANNADA)} AS _kn, "
            f"{count_of(x, '[A-Za-z]')} AS _en, "
            f"({count_of(x, r'\p{Nd}')} - {count_of(x, r'[\x{0CE6}-\x{0CEF}]')}) AS _num")


def share(n: str, total: str = "_total") -> str:
    return f"(CASE WHEN {total} > 0 THEN {n}::DOUBLE / {total} ELSE 0.0 END)"


def word_tokens(x: str) -> str:
    return f"regexp_split_to_array(lower({x}), '{X.NON_WORD}')"


def lexicon_hits(x: str, groups=None) -> str:
    by_weight = _weights(groups or FV.ROMANIZED_PATTERN_GROUPS)
    parts = [f"{w} * len(list_filter({word_tokens(x)}, lambda t: t IN {in_list(words)}))"
             for w, words in sorted(by_weight.items())]
    return "(" + " + ".join(parts) + ")"


def map_lit(lookup: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in lookup.items()) + "}"


def lookup(key: str, lookup_: dict[str, str]) -> str:
    return f"map_extract_value({map_lit(lookup_)}, {key})"


def tokens_ws(x: str) -> str:
    return f"regexp_extract_all({x}, '({WS}+|{NON_WS}+)', 1)"


def rstrip_punct(x: str) -> str:
    return f"regexp_replace({x}, '{X.PUNCT_CLASS}+$', '')"


def strip_punct(x: str) -> str:
    return f"regexp_replace({x}, '^{X.PUNCT_CLASS}+|{X.PUNCT_CLASS}+$', '', 'g')"


def translit_token(t: str, lk: dict[str, str]) -> str:
    """struct-free: returns the output token; method computed separately."""
    low = f"lower({t})"
    stem = rstrip_punct(low)
    exact = lookup(low, lk)
    by_stem = f"({lookup(stem, lk)} || substr({low}, length({stem}) + 1))"
    return (f"(CASE WHEN NOT regexp_matches({t}, '{NON_WS}') THEN {t} "
            f"WHEN regexp_matches({t}, '{KANNADA}') OR NOT regexp_matches({t}, '\\pL') THEN {t} "
            f"WHEN {exact} IS NOT NULL THEN {exact} "
            f"WHEN {by_stem} IS NOT NULL THEN {by_stem} ELSE {t} END)")


def translit_is_hit(t: str, lk: dict[str, str]) -> str:
    low = f"lower({t})"
    stem = rstrip_punct(low)
    return (f"(regexp_matches({t}, '{NON_WS}') AND NOT regexp_matches({t}, '{KANNADA}') "
            f"AND regexp_matches({t}, '\\pL') AND ({lookup(low, lk)} IS NOT NULL OR {lookup(stem, lk)} IS NOT NULL))")


def transliterated(x: str, lk: dict[str, str] | None = None) -> str:
    lk = lk if lk is not None else LX.roman_lookup()
    return (f"(CASE WHEN {is_blank(x)} THEN {x} ELSE "
            f"array_to_string(list_transform({tokens_ws(x)}, lambda t: {translit_token('t', lk)}), '') END)")


def translit_method(x: str, lk: dict[str, str] | None = None) -> str:
    lk = lk if lk is not None else LX.roman_lookup()
    hits = f"len(list_filter({tokens_ws(x)}, lambda t: {translit_is_hit('t', lk)}))"
    return f"(CASE WHEN {is_blank(x)} THEN 'unchanged' WHEN {hits} > 0 THEN 'fallback' ELSE 'unchanged' END)"


def translate_word(w: str, lk: dict[str, str]) -> str:
    clean = strip_punct(w)
    hit = lookup(clean, lk)
    return f"coalesce({hit} || substr({w}, length({clean}) + 1), {w})"


def words_after_segmentation(s: str, max_len: int = FV.MAX_SEGMENT_LEN) -> str:
    long_form = strip(f"regexp_replace({s}, '{X.SENTENCE_END}{WS}*', ' ', 'g')")
    return split_ws(f"(CASE WHEN length({s}) <= {max_len} THEN {s} ELSE {long_form} END)")


def translated_text(x: str, lk: dict[str, str] | None = None) -> str:
    lk = lk if lk is not None else LX.native_lookup()
    words = words_after_segmentation(strip(x))
    return (f"(CASE WHEN {is_blank(x)} THEN {x} ELSE "
            f"array_to_string(list_transform({words}, lambda w: {translate_word('w', lk)}), ' ') END)")


def lower_word_set(x: str) -> str:
    s = strip(f"lower({x})")
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE list_distinct({split_ws(s)}) END)"


# ---------------------------------------------------------------------------
# composite oracles: detection and the full analyze pipeline
# ---------------------------------------------------------------------------
def detection_ctes(src: str, key: str, text: str) -> str:
    """CTEs ``_d1.._d3`` over ``src`` giving key, _t, _blank, shares, _hits, _lang, _conf."""
    kt, et, mt = (f"{v}::DOUBLE" for v in (FV.KANNADA_THRESHOLD, FV.ENGLISH_THRESHOLD, FV.MIXED_THRESHOLD))
    latin = f"english >= {mt}"
    return f"""
_d1 AS (SELECT {key}, {text} AS _t, {is_blank(text)} AS _blank, {remove_ws(text)} AS _nows,
               {lexicon_hits(text)} AS _hits FROM {src}),
_d2 AS (SELECT *, {script_counts_cte_cols('_nows')} FROM _d1),
_d3p AS (SELECT *, {share('_kn')} AS kannada, {share('_en')} AS english, {share('_num')} AS numeric,
                {share('(_total - _kn - _en - _num)')} AS other FROM _d2),
_d3 AS (SELECT *,
  CASE WHEN _blank THEN 'unknown' WHEN kannada >= {kt} THEN 'kannada_script'
       WHEN {latin} AND _hits >= 1 THEN 'romanized_kannada'
       WHEN {latin} AND english >= {et} AND kannada = 0 THEN 'english'
       WHEN kannada >= {mt} OR english >= {mt} THEN 'mixed' ELSE 'unknown' END AS _lang,
  CASE WHEN _blank THEN 0.0::DOUBLE WHEN kannada >= {kt} THEN kannada
       WHEN {latin} AND _hits >= 1 THEN least(least(_hits::DOUBLE / 3.0::DOUBLE, 1.0::DOUBLE) * 0.7::DOUBLE
                                              + 0.0::DOUBLE, 1.0::DOUBLE)
       WHEN {latin} AND english >= {et} AND kannada = 0 THEN english
       WHEN kannada >= {mt} OR english >= {mt} THEN greatest(kannada, english) ELSE 0.0::DOUBLE END AS _conf
  FROM _d3p)"""


def lexicon_logits_cols(x: str) -> str:
    from ..operators.score import NEGATIVE_WORDS, NEUTRAL_BIAS, POSITIVE_WORDS
    toks = word_tokens(x)
    return (f"len(list_filter({toks}, lambda t: t IN {in_list(NEGATIVE_WORDS)}))::DOUBLE AS _l0, "
            f"{NEUTRAL_BIAS}::DOUBLE AS _l1, "
            f"len(list_filter({toks}, lambda t: t IN {in_list(POSITIVE_WORDS)}))::DOUBLE AS _l2")


def softmax_ctes(prev: str, name: str = "_sm") -> str:
    """Adds _p0.._p2, _label, _sconf to ``prev`` (which has _l0.._l2)."""
    return f"""
{name}1 AS (SELECT *, greatest(_l0, _l1, _l2) AS _lm FROM {prev}),
{name}2 AS (SELECT *, exp(_l0 - _lm) AS _e0, exp(_l1 - _lm) AS _e1, exp(_l2 - _lm) AS _e2 FROM {name}1),
{name}3 AS (SELECT *, _e0 / (0.0::DOUBLE + _e0 + _e1 + _e2) AS _p0, _e1 / (0.0::DOUBLE + _e0 + _e1 + _e2) AS _p1,
                 _e2 / (0.0::DOUBLE + _e0 + _e1 + _e2) AS _p2 FROM {name}2),
{name} AS (SELECT *, CASE WHEN _p0 >= _p1 AND _p0 >= _p2 THEN 'Negative' WHEN _p1 >= _p2 THEN 'Neutral'
                        ELSE 'Positive' END AS _label, greatest(_p0, _p1, _p2) AS _sconf FROM {name}3)"""


def scheme_spelling(t: str) -> str:
    """ITRANS spelling of a word or NULL: each unit's letters follow from it and the unit before it."""
    from ..operators.scheme import _units_pattern
    cons = lambda u: lookup(u, FV.ITRANS_CONSONANTS)
    vowel = lambda u, i: lookup(u, {k: v[i] for k, v in FV.ITRANS_VOWELS.items()})
    pending = f"(CASE WHEN {cons('z[2]')} IS NOT NULL THEN {q(FV.VIRAMA)} ELSE '' END)"
    units = f"regexp_extract_all({t}, {q(_units_pattern())}, 1)"
    spelled = (f"array_to_string(list_transform(list_zip({units}, list_prepend('', {units})), lambda z: CASE WHEN z[1] IS NULL THEN {pending} "
               f"WHEN {cons('z[1]')} IS NOT NULL THEN {pending} || {cons('z[1]')} "
               f"WHEN {vowel('z[1]', 0)} IS NOT NULL THEN CASE WHEN {cons('z[2]')} IS NOT NULL THEN {vowel('z[1]', 1)} ELSE {vowel('z[1]', 0)} END "
               f"ELSE coalesce({lookup('z[1]', FV.ITRANS_SIGNS)}, {pending} || z[1]) END), '')")
    return f"(SELECT CASE WHEN {strip('x')} <> {t} AND NOT regexp_matches(x, '^[\\x00-\\x7F]*$') THEN x END FROM (SELECT {spelled} AS x))"


def open_word(t: str) -> str:
    return f"(regexp_matches({t}, '\\pL') AND NOT regexp_matches({t}, '{KANNADA}'))"


def dictionary_hit(t: str, lk: dict[str, str]) -> str:
    stem = rstrip_punct(f"lower({t})")
    return f"coalesce({lookup(f'lower({t})', lk)}, {lookup(stem, lk)} || substr(lower({t}), length({stem}) + 1))"


def spelled_ctes(src: str, key: str, text: str, words: str | None, name: str = "_sp", lk: dict[str, str] | None = None) -> str:
    """CTE ``name`` (key, tl, method): texts of ``src`` spelled by a model's ``words`` (src, dst), the dictionary, the scheme."""
    lk = lk if lk is not None else LX.roman_lookup()
    model = f"LEFT JOIN {words} w ON w.src = v.t" if words else ""
    return f"""
{name}t AS (SELECT {key}, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM (SELECT {key}, {tokens_ws(text)} AS toks FROM {src})),
{name}v AS (SELECT t, {'CASE WHEN ' + open_word('v.t') + ' THEN w.dst END' if words else 'NULL::VARCHAR'} AS m,
  CASE WHEN {open_word('t')} THEN {dictionary_hit('t', lk)} END AS d, CASE WHEN {open_word('t')} THEN {scheme_spelling('t')} END AS s
  FROM (SELECT DISTINCT t FROM {name}t) v {model}),
{name}k AS (SELECT {key}, i, coalesce(m, d, s, t) AS o, CASE WHEN NOT regexp_matches(t, '{NON_WS}') THEN NULL WHEN m IS NOT NULL THEN 'model'
  WHEN d IS NOT NULL THEN 'fallback' WHEN s IS NOT NULL THEN 'scheme' ELSE 'unchanged' END AS kind FROM {name}t JOIN {name}v USING (t)),
{name} AS (SELECT {key}, string_agg(o, '' ORDER BY i) AS tl,
  CASE WHEN bool_or(kind = 'model') AND bool_or(kind <> 'model') THEN 'mixed' WHEN bool_or(kind = 'model') THEN 'model'
       WHEN bool_or(kind = 'scheme') AND bool_or(kind = 'fallback') THEN 'mixed' WHEN bool_or(kind = 'scheme') THEN 'scheme'
       WHEN bool_or(kind = 'fallback') THEN 'fallback' ELSE 'unchanged' END AS method FROM {name}k GROUP BY {key})"""


def translate_words(s: str, lk: dict[str, str] | None = None) -> str:
    lk = lk if lk is not None else LX.native_lookup()
    return f"array_to_string(list_transform({split_ws(s)}, lambda w: {translate_word('w', lk)}), ' ')"


def segmented_ctes(src: str, key: str, text: str, memory: str, names: list[str], name: str = "_sg") -> str:
    """CTE ``name`` (key, tr, sources, n, n_fallback, backend): non-blank texts of ``src``, each segment by ``memory`` (k, t, source), else
    by the dictionary. ``names``: the memories in order."""
    from .q_text import _segments_sql
    rank = " ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(names))
    back = " ".join(f"WHEN {i} THEN {q(n)}" for i, n in enumerate(names))
    return f"""
{name}s AS (SELECT {key}, unnest(segs) AS s, generate_subscripts(segs, 1) AS i
  FROM (SELECT {key}, {_segments_sql('_x')} AS segs FROM (SELECT {key}, {strip(text)} AS _x FROM {src} WHERE NOT {is_blank(text)}))),
{name}p AS (SELECT {key}, i, coalesce(m.t, {translate_words('s')}) AS dst, coalesce(m.source, 'fallback') AS source
  FROM {name}s LEFT JOIN {memory} m ON m.k = {name}s.s),
{name}o AS (SELECT {key}, string_agg(source, ', ' ORDER BY since) AS sources FROM (SELECT {key}, source, min(i) AS since FROM {name}p GROUP BY ALL) GROUP BY 1),
{name} AS (SELECT p.{key}, string_agg(dst, ' ' ORDER BY i) AS tr, any_value(o.sources) AS sources, count(*) AS n,
  count(*) FILTER (source = 'fallback') AS n_fallback,
  CASE max(CASE source {rank} ELSE {len(names)} END) {back} ELSE 'fallback' END AS backend
  FROM {name}p p JOIN {name}o o ON p.{key} = o.{key} GROUP BY 1)"""


def analyze_sql(src: str, key: str, text: str, words: str | None = None, memory: str | None = None, names: list[str] | None = None,
                before: str = "") -> str:
    """Full T14 oracle with the lexicon scorer: key + the 11 result columns. With a model's ``words`` and a segment ``memory``
    (CTEs made in ``before``) also how texts were spelled and translated."""
    rl, nl = LX.roman_lookup(), LX.native_lookup()
    route_langs = "('kannada_script', 'romanized_kannada', 'english')"
    if memory:
        routed = f"""{spelled_ctes("(SELECT * FROM _d3 WHERE _lang = 'romanized_kannada')", key, '_t', words)},
_r1 AS (SELECT _d3.*, _sp.tl AS _tl, _sp.method AS _method FROM _d3 LEFT JOIN _sp USING ({key})),
_rn AS (SELECT {key}, CASE _lang WHEN 'kannada_script' THEN _t ELSE _tl END AS _n FROM _r1 WHERE _lang IN ('kannada_script', 'romanized_kannada')),
{segmented_ctes('_rn', key, '_n', memory, names)},
_r2 AS (SELECT _r1.*, _sg.tr AS _tr, _sg.sources AS _sources FROM _r1 LEFT JOIN _sg USING ({key})),"""
        extra = ",\n  CASE WHEN NOT _blank THEN _method END AS transliteration_method, CASE WHEN NOT _blank THEN _sources END AS translation_sources"
    else:
        extra = ""
        routed = f"""
_r1 AS (SELECT *, CASE WHEN _lang = 'romanized_kannada' THEN {transliterated('_t', rl)} END AS _tl FROM _d3),
_r2 AS (SELECT *, CASE WHEN _lang = 'kannada_script' THEN {translated_text('_t', nl)}
                       WHEN _lang = 'romanized_kannada' THEN {translated_text('_tl', nl)} END AS _tr FROM _r1),"""
    return f"""WITH {before}{detection_ctes(src, key, text)},{routed}
_r3 AS (SELECT *, CASE WHEN _lang IN ('kannada_script', 'romanized_kannada') THEN _tr ELSE _t END AS _tfs,
               CASE WHEN _lang NOT IN {route_langs}
                    THEN 'Language is ''' || _lang || '''; attempting direct sentiment classification.' END AS _rerr
        FROM _r2),
_r4 AS (SELECT *, coalesce(length(_tfs) > 0, false) AS _has FROM _r3),
_r5 AS (SELECT *, {lexicon_logits_cols("CASE WHEN _has THEN _tfs ELSE '' END")} FROM _r4),
{softmax_ctes('_r5')}
SELECT {key},
  _t AS original_text,
  CASE WHEN _t IS NULL OR _blank THEN 'unknown' ELSE _lang END AS detected_language,
  CASE WHEN _t IS NULL OR _blank THEN 0.0 ELSE round(_conf, 4) END AS detection_confidence,
  CASE WHEN NOT _blank THEN _tl END AS transliterated_text,
  CASE WHEN NOT _blank THEN _tr END AS translated_text,
  CASE WHEN NOT _blank AND _has THEN _label ELSE 'Neutral' END AS sentiment_label,
  CASE WHEN NOT _blank AND _has THEN round(_sconf, 4) ELSE 0.0 END AS confidence_score,
  CASE WHEN _blank THEN '' ELSE array_to_string(list_filter(['language_detection',
       CASE WHEN _lang = 'romanized_kannada' THEN 'transliteration' END,
       CASE WHEN _lang IN ('kannada_script', 'romanized_kannada') THEN 'translation' END,
       CASE WHEN _has THEN 'sentiment_classification' END], lambda s: s IS NOT NULL), ', ') END AS pipeline_steps,
  CASE WHEN _t IS NULL THEN 'Expected str, got NoneType' WHEN _blank THEN 'Empty or whitespace-only string'
       ELSE array_to_string(list_filter([_rerr, CASE WHEN NOT _has THEN 'No text available for sentiment classification.' END],
                                        lambda e: e IS NOT NULL), '; ') END AS errors,
  CASE WHEN _blank THEN 0.0::DOUBLE END AS processing_time_s,
  CASE WHEN _blank THEN 'skipped' WHEN _rerr IS NOT NULL OR NOT _has THEN 'ok_with_warnings' ELSE 'ok' END AS status{extra}
FROM _sm"""
