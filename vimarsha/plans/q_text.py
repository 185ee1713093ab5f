"""Plans for the text expressions and detection (X1-X13, T1, T2, T4, T5, T8, T9) over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions import text as X
from ..operators.detect import detect_language, is_kannada
from ..operators.score import apply_neutral_threshold, from_logits
from ..operators.translate import translate_segments, translated_text
from ..operators.translit import transliterate
from . import sqlfrag as S
from .catalog import register, table
from .views import TEXTS_SQL, docs, texts


# --------------------------------------------------------------------------- X1
@register("script_proportions", f"""
WITH a AS (SELECT doc_id, {S.remove_ws('text')} AS _nows FROM documents),
b AS (SELECT doc_id, {S.script_counts_cte_cols('_nows')} FROM a)
SELECT doc_id, _total AS visible_chars, {S.share('_kn')} AS kannada, {S.share('_en')} AS english,
       {S.share('_num')} AS numeric, {S.share('(_total - _kn - _en - _num)')} AS other FROM b""")
def q_script_proportions(spark, sf):
    d = docs(spark, sf).withColumn("_c", X.script_counts("text"))
    return d.select("doc_id", F.col("_c.total").alias("visible_chars"),
                    X.shares_from_counts(F.col("_c")).alias("p")).select("doc_id", "visible_chars", "p.*")


# --------------------------------------------------------------------------- X2 (on transliterated text)
@register("native_char_count", f"""
WITH t AS (SELECT doc_id, {S.transliterated('text')} AS tl FROM documents)
SELECT doc_id, {S.count_of('tl', S.KANNADA)} AS native_chars, regexp_matches(tl, '{S.KANNADA}') AS has_native FROM t""")
def q_native_char_count(spark, sf):
    t = transliterate(docs(spark, sf)).select("doc_id", F.col("transliteration.transliterated").alias("tl"))
    return t.select("doc_id", X.native_char_count("tl").alias("native_chars"), X.has_native("tl").alias("has_native"))


# --------------------------------------------------------------------------- X3
@register("lexicon_hits", f"SELECT doc_id, {S.lexicon_hits('text')} AS hits FROM documents")
def q_lexicon_hits(spark, sf):
    return docs(spark, sf).select("doc_id", X.lexicon_hits("text").alias("hits"))


# --------------------------------------------------------------------------- T1
@register("detect_language", f"""
WITH {S.detection_ctes(TEXTS_SQL, 'doc_id', 'text')}
SELECT doc_id, _lang AS language, _conf AS confidence, kannada, english, numeric, other FROM _d3""")
def q_detect_language(spark, sf):
    d = detect_language(texts(spark, sf))
    return d.select("doc_id", "detection.language", "detection.confidence", "detection.script_proportions.*")


# --------------------------------------------------------------------------- T2
@register("is_kannada", f"""
WITH {S.detection_ctes(TEXTS_SQL, 'doc_id', 'text')}
SELECT _lang AS language, _lang IN ('kannada_script', 'romanized_kannada') AS is_kannada, count(*) AS n
FROM _d3 GROUP BY ALL""")
def q_is_kannada(spark, sf):
    d = detect_language(texts(spark, sf)).select(F.col("detection.language").alias("language"))
    return d.groupBy("language", is_kannada(F.col("language")).alias("is_kannada")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- X5
@register("tokens_ws", f"""
WITH t AS (SELECT doc_id, text, {S.tokens_ws('text')} AS toks FROM documents)
SELECT doc_id, len(toks) AS n_tokens,
       len(list_filter(toks, lambda x: NOT regexp_matches(x, '{S.NON_WS}'))) AS n_blank_runs,
       array_to_string(toks, '') = text AS lossless FROM t""")
def q_tokens_ws(spark, sf):
    t = docs(spark, sf).withColumn("toks", X.tokens_ws("text"))
    return t.select("doc_id", F.size("toks").alias("n_tokens"),
                    F.size(F.filter("toks", X.is_ws_token)).alias("n_blank_runs"),
                    (F.array_join("toks", "") == F.col("text")).alias("lossless"))


# --------------------------------------------------------------------------- X6
@register("split_trailing_punct", f"""
WITH w AS (SELECT unnest({S.split_ws(S.strip('text'))}) AS word FROM documents WHERE NOT {S.is_blank('text')}),
p AS (SELECT substr(word, length({S.rstrip_punct('word')}) + 1) AS punct FROM w)
SELECT punct, count(*) AS n FROM p GROUP BY punct""")
def q_split_trailing_punct(spark, sf):
    w = X.explode_rows(docs(spark, sf).filter(~X.is_blank("text")), X.split_ws(X.py_strip("text")), "word")
    return w.select(X.split_trailing_punct("word")["punct"].alias("punct")).groupBy("punct").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- X13
@register("text_lengths", f"""
SELECT doc_id, length(text) AS n_chars,
       CASE WHEN {S.strip('text')} = '' THEN 0 ELSE len({S.split_ws(S.strip('text'))}) END AS n_words
FROM documents""")
def q_text_lengths(spark, sf):
    return docs(spark, sf).select("doc_id", F.length("text").alias("n_chars"), X.word_count("text").alias("n_words"))


# --------------------------------------------------------------------------- P13
@register("truncate_text", """
SELECT doc_id, CASE WHEN length(text) > 35 THEN substr(text, 1, 32) || '...' ELSE text END AS short_text FROM documents""")
def q_truncate_text(spark, sf):
    return docs(spark, sf).select("doc_id", X.truncate_text("text", 35).alias("short_text"))


# --------------------------------------------------------------------------- U2 / X11 on reply pairs
_PAIRS_SQL = """pairs AS (SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS reply
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _reply_pairs(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)).select(
        F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"),
        F.col("a.text").alias("prompt"), F.col("b.text").alias("reply"))


@register("token_overlap", f"""
WITH {_PAIRS_SQL}
SELECT conv_id, turn, len(list_intersect({S.lower_word_set('reply')}, {S.lower_word_set('prompt')})) AS overlap
FROM pairs""")
def q_token_overlap(spark, sf):
    p = _reply_pairs(spark, sf)
    return p.select("conv_id", "turn", X.token_overlap("reply", "prompt").alias("overlap"))


@register("similarity_score", f"""
WITH {_PAIRS_SQL},
s AS (SELECT conv_id, turn, {S.lower_word_set('reply')} AS a, {S.lower_word_set('prompt')} AS e FROM pairs)
SELECT conv_id, turn, CASE WHEN len(e) = 0 THEN 0.0
  ELSE least(greatest(len(list_intersect(a, e))::DOUBLE / len(e) * 5.0::DOUBLE, 1.0::DOUBLE), 5.0::DOUBLE) END AS score
FROM s""")
def q_similarity_score(spark, sf):
    p = _reply_pairs(spark, sf)
    return p.select("conv_id", "turn", X.similarity_score("reply", "prompt").alias("score"))


# --------------------------------------------------------------------------- X12
def _wb_sql(x: str, n_min: int = 2, n_max: int = 4) -> str:
    s = S.strip(f"lower({x})")
    words = f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE {S.split_ws(s)} END)"
    per_n = []
    for n in range(n_min, n_max + 1):
        short = "[' ' || w || ' ']" if n == n_min else "[]::VARCHAR[]"
        per_n.append(f"(CASE WHEN length(w) + 2 < {n} THEN {short} ELSE "
                     f"list_transform(range(1, length(w) + 2 - {n} + 2), lambda i: substr(' ' || w || ' ', i, {n})) END)")
    return f"flatten(list_transform({words}, lambda w: flatten([{', '.join(per_n)}])))"


@register("char_wb_ngrams", f"SELECT doc_id, len({_wb_sql('text')}) AS n_grams FROM documents")
def q_char_wb_ngrams(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(X.char_wb_ngrams("text")).alias("n_grams"))


@register("ngram_df", f"""
WITH g AS (SELECT DISTINCT doc_id, unnest({_wb_sql('text')}) AS ngram FROM documents)
SELECT ngram, count(*) AS df FROM g GROUP BY ngram HAVING count(*) >= 2""")
def q_ngram_df(spark, sf):
    g = X.explode_rows(docs(spark, sf), F.array_distinct(X.char_wb_ngrams("text")), "ngram", "doc_id")
    return g.groupBy("ngram").agg(F.count("*").alias("df")).filter("df >= 2")


# --------------------------------------------------------------------------- T4/T5/T18
@register("transliterate", f"""
SELECT doc_id, {S.transliterated('text')} AS transliterated, {S.translit_method('text')} AS method,
       CASE WHEN {S.is_blank('text')} THEN 0 ELSE
         len(list_filter({S.tokens_ws('text')}, lambda t: regexp_matches(t, '{S.NON_WS}'))) END AS n_words
FROM documents""")
def q_transliterate(spark, sf):
    t = transliterate(docs(spark, sf))
    return t.select("doc_id", "transliteration.transliterated", "transliteration.method",
                    F.size("transliteration.word_mappings").alias("n_words"))


@register("translit_method", f"""
SELECT {S.translit_method('text')} AS method, count(*) AS n FROM documents GROUP BY 1""")
def q_translit_method(spark, sf):
    return transliterate(docs(spark, sf)).groupBy(F.col("transliteration.method").alias("method")).agg(
        F.count("*").alias("n"))


# --------------------------------------------------------------------------- T8/T9
@register("translate_dict", f"""
WITH t AS (SELECT doc_id, {S.transliterated('text')} AS tl FROM documents)
SELECT doc_id, {S.translated_text('tl')} AS translated FROM t""")
def q_translate_dict(spark, sf):
    t = transliterate(docs(spark, sf)).select("doc_id", F.col("transliteration.transliterated").alias("tl"))
    return t.select("doc_id", translated_text("tl").alias("translated"))


# --------------------------------------------------------------------------- X7 oracle: greedy packing as list_reduce
_ACC = "STRUCT(segs VARCHAR[], cur VARCHAR)"


def _app(arr: str, cur: str) -> str:
    return f"(CASE WHEN {cur} <> '' THEN list_append({arr}, {S.strip(cur)}) ELSE {arr} END)"


def _fold(items: str, body: str) -> str:
    """list_reduce over ``items`` wrapped as accumulator structs: an empty start state first and a
    flush marker (non-NULL ``segs``) last, so the result's ``segs`` is complete."""
    start = f"{{'segs': []::VARCHAR[], 'cur': ''}}::{_ACC}"
    flush = f"{{'segs': []::VARCHAR[], 'cur': ''}}::{_ACC}"
    wrapped = f"list_transform({items}, lambda it: {{'segs': NULL::VARCHAR[], 'cur': it}}::{_ACC})"
    guarded = (f"CASE WHEN x.segs IS NOT NULL THEN {{'segs': {_app('acc.segs', 'acc.cur')}, 'cur': ''}}::{_ACC} "
               f"ELSE {body} END")
    return f"list_reduce(list_append(list_prepend({start}, {wrapped}), {flush}), lambda acc, x: {guarded}).segs"


def _segments_sql(s: str, m: int = FV.MAX_SEGMENT_LEN) -> str:
    def mk(segs, cur):
        return f"{{'segs': {segs}, 'cur': {cur}}}::{_ACC}"
    words = _fold(S.split_ws("x.cur"), f"CASE WHEN length(acc.cur) + length(x.cur) + 1 > {m} "
                  f"THEN {mk(_app('acc.segs', 'acc.cur'), 'x.cur')} "
                  f"ELSE {mk('acc.segs', S.strip('acc.cur || chr(32) || x.cur'))} END")
    sentences = (f"list_filter(list_transform(regexp_split_to_array({s}, '{X.SENTENCE_END}{S.WS}*'), "
                 f"lambda z: {S.strip('z')}), lambda z: z <> '')")
    body = (f"CASE WHEN length(x.cur) > {m} THEN {mk('list_concat(' + _app('acc.segs', 'acc.cur') + ', ' + words + ')', chr(39) * 2)} "
            f"WHEN length(acc.cur) + length(x.cur) + 1 > {m} THEN {mk(_app('acc.segs', 'acc.cur'), 'x.cur')} "
            f"ELSE {mk('acc.segs', S.strip('acc.cur || chr(32) || x.cur'))} END")
    return f"(CASE WHEN length({s}) <= {m} THEN [{s}] ELSE {_fold(sentences, body)} END)"


@register("segment_text", f"""
WITH t AS (SELECT doc_id, {S.strip('text')} AS s FROM documents WHERE NOT {S.is_blank('text')}),
g AS (SELECT doc_id, {_segments_sql('s')} AS segs FROM t)
SELECT doc_id, len(segs) AS n_segments, array_to_string(segs, chr(31)) AS segments FROM g""")
def q_segment_text(spark, sf):
    d = docs(spark, sf).filter(~X.is_blank("text")).withColumn("segs", X.segment_text(X.py_strip("text")))
    return d.select("doc_id", F.size("segs").alias("n_segments"), F.array_join("segs", "\x1f").alias("segments"))


@register("translate_segments", f"""
WITH t AS (SELECT doc_id, {S.transliterated('text')} AS tl FROM documents),
g AS (SELECT doc_id, tl, CASE WHEN {S.is_blank('tl')} THEN []::VARCHAR[] ELSE {_segments_sql(S.strip('tl'))} END AS segs
      FROM t)
SELECT doc_id, len(segs) AS n_segments, {S.translated_text('tl')} AS translated, true AS same_as_flat FROM g""")
def q_translate_segments(spark, sf):
    t = transliterate(docs(spark, sf)).select("doc_id", F.col("transliteration.transliterated").alias("tl"))
    r = translate_segments(t, "tl", "tr")
    return r.select("doc_id", F.size("tr.segments").alias("n_segments"), F.col("tr.translated").alias("translated"),
                    (F.col("tr.translated") == translated_text("tl")).alias("same_as_flat"))


# --------------------------------------------------------------------------- X8-X10 on embedding logits
_DIM = 64


def _logits(spark, sf, k):
    """k logits of a whole vector: element i (from 0) adds to logit i mod k."""
    e = table(spark, sf, "embeddings")
    v = F.col("embedding").cast("array<double>")
    logit = lambda j: F.aggregate(F.filter(v, lambda _, i: i % k == j), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.array(*[logit(j) for j in range(k)]).alias("logits"))


def _softmax_sql(k: int) -> str:
    logits = ["(0.0::DOUBLE + " + " + ".join(f"embedding[{i + 1}]::DOUBLE" for i in range(j, _DIM, k)) + ")" for j in range(k)]
    m = "greatest(" + ", ".join(logits) + ")"
    exps = [f"exp({x} - {m})" for x in logits]
    total = "(0.0::DOUBLE + " + " + ".join(exps) + ")"
    return ", ".join(f"{e} / {total} AS p{i}" for i, e in enumerate(exps))


def _argmax_sql(k: int) -> str:
    ps = [f"p{i}" for i in range(k)]
    branches = []
    for i in range(k):
        cond = " AND ".join(f"p{i} >= {o}" for o in ps if o != f"p{i}") or "TRUE"
        branches.append(f"WHEN {cond} THEN {i}")
    return "CASE " + " ".join(branches) + " END"


@register("softmax_label", f"""
WITH p AS (SELECT vec_id, {_softmax_sql(3)} FROM embeddings),
a AS (SELECT vec_id, {_argmax_sql(3)} AS idx, greatest(p0, p1, p2) AS conf FROM p)
SELECT vec_id, ['Negative', 'Neutral', 'Positive'][idx + 1] AS label, round(conf, 6) AS confidence FROM a""")
def q_softmax_label(spark, sf):
    r = from_logits(_logits(spark, sf, 3), "logits", FV.MODEL_LABEL_MAPS[3])
    return r.select("vec_id", "sentiment.label", F.round("sentiment.confidence", 6).alias("confidence"))


@register("label_probabilities", f"""
WITH p AS (SELECT vec_id, {_softmax_sql(5)} FROM embeddings)
SELECT vec_id, round(p0 + p1, 6) AS p_negative, round(p2, 6) AS p_neutral, round(p3 + p4, 6) AS p_positive FROM p""")
def q_label_probabilities(spark, sf):
    r = from_logits(_logits(spark, sf, 5), "logits", FV.MODEL_LABEL_MAPS[5])
    pr = F.col("sentiment.probabilities")
    return r.select("vec_id", F.round(pr["Negative"], 6).alias("p_negative"), F.round(pr["Neutral"], 6).alias("p_neutral"),
                    F.round(pr["Positive"], 6).alias("p_positive"))


@register("neutral_threshold", f"""
WITH p AS (SELECT vec_id, {_softmax_sql(2)} FROM embeddings),
a AS (SELECT vec_id, {_argmax_sql(2)} AS idx, greatest(p0, p1) AS conf FROM p)
SELECT vec_id, ['Negative', 'Positive'][idx + 1] AS raw_label,
       CASE WHEN conf < 0.6::DOUBLE THEN 'Neutral' ELSE ['Negative', 'Positive'][idx + 1] END AS label,
       round(conf, 6) AS confidence FROM a""")
def q_neutral_threshold(spark, sf):
    r = from_logits(_logits(spark, sf, 2), "logits", FV.MODEL_LABEL_MAPS[2])
    r = r.withColumn("adj", apply_neutral_threshold(F.col("sentiment"), FV.NEUTRAL_THRESHOLD))
    return r.select("vec_id", F.col("sentiment.label").alias("raw_label"), F.col("adj.label").alias("label"),
                    F.round("sentiment.confidence", 6).alias("confidence"))
