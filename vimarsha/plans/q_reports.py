"""Plans for the report operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions import lexicon as LX
from ..functions import text as X
from ..functions.labels import normalize_label, recode
from ..operators import report as R
from ..operators.detect import detect_language
from ..operators.pipeline import row_status
from ..operators.pipeline import errors_only, processed, select_result_columns
from ..operators.translate import score_translations, translated_text
from ..operators.translit import translit_table, transliterate
from . import sqlfrag as S
from .catalog import register, table
from .q_pipeline import ANALYZE_SQL, analyzed
from .views import REVIEW_SQL, docs, review_view

LABELS_SQL = "['Positive', 'Negative', 'Neutral']"


def rv(spark, sf, text=False):
    return review_view(spark, sf, with_text=text)


def r(df, cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def r6(cols, digits=6):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


# --------------------------------------------------------------------------- flagship (entry)
def detected_label_distribution(spark, sf):
    """analyze every document, then label counts and share per detected language."""
    g = analyzed(spark, sf).groupBy("detected_language", "sentiment_label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("detected_language"))  # over the small grouped table
    return g.select("detected_language", "sentiment_label", "n", F.round(F.col("n") / total, 6).alias("share"))


register("detected_label_distribution", f"""
WITH a AS ({ANALYZE_SQL}), g AS (SELECT detected_language, sentiment_label, count(*) AS n FROM a GROUP BY ALL)
SELECT detected_language, sentiment_label, n,
       round(n::DOUBLE / sum(n) OVER (PARTITION BY detected_language), 6) AS share FROM g""")(detected_label_distribution)


# --------------------------------------------------------------------------- A1
@register("value_counts", f"""
WITH {REVIEW_SQL}
SELECT predicted_label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM rv GROUP BY 1""")
def q_value_counts(spark, sf):
    return r(R.value_counts(rv(spark, sf), "predicted_label"), ["share"])


# --------------------------------------------------------------------------- A2
@register("crosstab", f"""
WITH {REVIEW_SQL}
SELECT script_type, count(*) FILTER (WHERE ground_truth = 'Positive') AS "Positive",
       count(*) FILTER (WHERE ground_truth = 'Negative') AS "Negative",
       count(*) FILTER (WHERE ground_truth = 'Neutral') AS "Neutral" FROM rv GROUP BY 1""")
def q_crosstab(spark, sf):
    return R.crosstab(rv(spark, sf), "script_type", "ground_truth", FV.LABELS)


# --------------------------------------------------------------------------- A10
@register("script_summary", f"""
WITH {REVIEW_SQL},
p AS (SELECT script_type, ground_truth, count(*) AS _n, count(*) FILTER (WHERE correct) AS _ok,
             sum(confidence_score) AS _c FROM rv GROUP BY ALL)
SELECT script_type, sum(_n) AS total, sum(_ok) AS correct, round(sum(_ok)::DOUBLE / sum(_n), 6) AS accuracy,
       round(sum(_c) / sum(_n), 6) AS avg_confidence,
       round(max(CASE WHEN ground_truth = 'Positive' THEN _ok::DOUBLE / _n END), 6) AS recall_positive,
       round(max(CASE WHEN ground_truth = 'Negative' THEN _ok::DOUBLE / _n END), 6) AS recall_negative,
       round(max(CASE WHEN ground_truth = 'Neutral' THEN _ok::DOUBLE / _n END), 6) AS recall_neutral
FROM p GROUP BY script_type""")
def q_script_summary(spark, sf):
    s = R.script_summary(rv(spark, sf))
    m = F.col("label_recall")
    return r(s.select("script_type", "total", "correct", "accuracy", "avg_confidence",
                      m["Positive"].alias("recall_positive"), m["Negative"].alias("recall_negative"),
                      m["Neutral"].alias("recall_neutral")),
             ["accuracy", "avg_confidence", "recall_positive", "recall_negative", "recall_neutral"])


# --------------------------------------------------------------------------- A11
@register("accuracy_by", f"""
WITH {REVIEW_SQL}
SELECT product_category, count(*) AS total, count(*) FILTER (WHERE correct) AS n_correct,
       round(count(*) FILTER (WHERE correct)::DOUBLE / count(*), 6) AS accuracy FROM rv GROUP BY 1""")
def q_accuracy_by(spark, sf):
    return r(R.accuracy_by(rv(spark, sf), "product_category"), ["accuracy"])


# --------------------------------------------------------------------------- A12
_NUM_COLS = ["l_quantity", "l_discount", "l_tax"]


@register("numeric_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS measure, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, "
    f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM lineitem"
    for c in _NUM_COLS))
def q_numeric_summary(spark, sf):
    s = R.numeric_summary(table(spark, sf, "lineitem"), _NUM_COLS).withColumnRenamed("column", "measure")
    return r(s, ["mean", "median", "std", "min", "max"])


# --------------------------------------------------------------------------- A13 (ms scaling, 3 decimals)
@register("numeric_summary_by", """
SELECT event_type, round(avg(value * 1000), 3) AS mean, round(median(value * 1000), 3) AS median,
       round(stddev_samp(value * 1000), 3) AS std, round(min(value * 1000), 3) AS min,
       round(max(value * 1000), 3) AS max FROM events GROUP BY 1""")
def q_numeric_summary_by(spark, sf):
    s = R.numeric_summary_by(table(spark, sf, "events"), "event_type", "value", 1000.0)
    return r(s, ["mean", "median", "std", "min", "max"], 3)


# --------------------------------------------------------------------------- A14
@register("step_means_long", " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS step, round(avg({c}), 6) AS mean FROM lineitem GROUP BY 1" for c in _NUM_COLS))
def q_step_means_long(spark, sf):
    return r(R.step_means_long(table(spark, sf, "lineitem"), "l_returnflag", _NUM_COLS), ["mean"])


# --------------------------------------------------------------------------- A15 / J6
def _doc_words(spark, sf):
    d = docs(spark, sf).filter(~X.is_blank("text"))
    return X.explode_rows(d, X.split_ws(X.py_strip("text")), "token")


_WORDS_SQL = f"""w AS (SELECT unnest({S.split_ws(S.strip('text'))}) AS token FROM documents WHERE NOT {S.is_blank('text')})"""
_DICT_SQL = "dict AS (SELECT * FROM (VALUES " + ", ".join(
    f"({S.q(k)}, {S.q(v)})" for k, v in LX.roman_lookup().items()) + ") t(word, expected))"


@register("word_accuracy", f"""
WITH {_WORDS_SQL}, {_DICT_SQL}, added AS (SELECT DISTINCT lower(tok) AS src, '[' || lower(tok) || ']' AS dst FROM (
    SELECT unnest({S.split_ws(S.strip('text'))}) AS tok FROM benchmark WHERE NOT {S.is_blank('text')})),
ref AS (SELECT src AS word, CASE WHEN length(src) % 2 = 0 THEN src ELSE dst END AS expected FROM added
        UNION ALL SELECT word, expected FROM dict WHERE word NOT IN (SELECT src FROM added)),
o AS (SELECT DISTINCT lower(token) AS word FROM w),
g AS (SELECT word, {S.translit_token('word', LX.roman_lookup())} AS got FROM o),
j AS (SELECT g.word, got, expected FROM ref JOIN g ON ref.word = g.word)
SELECT count(*) AS total, count(*) FILTER (WHERE got = expected) AS correct,
       count(*) FILTER (WHERE got <> expected) AS incorrect,
       round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE got = expected)::DOUBLE / count(*) ELSE 0.0 END, 6)
         AS accuracy FROM j""")
def q_word_accuracy(spark, sf):
    """Outputs of the default dictionary against a reference table that agrees with it in part only."""
    words = _doc_words(spark, sf).select(F.lower("token").alias("word")).distinct()
    outs = transliterate(words, "word", "t").select("word", F.col("t.transliterated").alias("got"))
    own = _added(spark, sf).select("src", F.when(F.length("src") % 2 == 0, F.col("src")).otherwise(F.col("dst")).alias("dst"))
    ref = LX.merge_dictionary(LX.dictionary_table(spark, LX.roman_lookup()), own).select(
        F.col("src").alias("word"), F.col("dst").alias("expected"))
    return r(R.word_accuracy(outs, ref), ["accuracy"])


# --------------------------------------------------------------------------- A16
@register("detection_accuracy", f"""
WITH {S.detection_ctes('documents', 'doc_id, lang', 'text')},
x AS (SELECT lang AS script_type, CASE WHEN lang = 'en' THEN 'english' END AS expected_language,
             _lang AS detected_language FROM _d3)
SELECT script_type, expected_language, count(*) AS total,
       count(*) FILTER (WHERE detected_language IS NOT DISTINCT FROM expected_language) AS correct,
       round(count(*) FILTER (WHERE detected_language IS NOT DISTINCT FROM expected_language)::DOUBLE / count(*), 6)
         AS accuracy,
       {", ".join(f"count(*) FILTER (WHERE detected_language = '{x}') AS n_{x}" for x in FV.LANGUAGES)}
FROM x GROUP BY ALL""")
def q_detection_accuracy(spark, sf):
    d = detect_language(docs(spark, sf, ("doc_id", "text", "lang")))
    d = d.select(F.col("lang").alias("script_type"), recode("lang", {"en": "english"}).alias("expected_language"),
                 F.col("detection.language").alias("detected_language"))
    return r(R.detection_accuracy(d), ["accuracy"])


# --------------------------------------------------------------------------- A17
@register("misprediction_pairs", f"""
WITH {REVIEW_SQL}
SELECT ground_truth, predicted_label, count(*) AS count FROM rv WHERE NOT correct GROUP BY ALL""")
def q_misprediction_pairs(spark, sf):
    return R.misprediction_pairs(rv(spark, sf))


# --------------------------------------------------------------------------- A18
@register("top_messages", f"""
WITH {REVIEW_SQL},
p AS (SELECT {S.strip('m')} AS message FROM (SELECT unnest(string_split(errors, ';')) AS m FROM rv
      WHERE NOT correct AND length(errors) > 0)),
c AS (SELECT message, count(*) AS count FROM p WHERE message <> '' GROUP BY 1)
SELECT * FROM c ORDER BY count DESC, message LIMIT 5""")
def q_top_messages(spark, sf):
    return R.top_messages(rv(spark, sf))


# --------------------------------------------------------------------------- J2
@register("error_rate_by", f"""
WITH {REVIEW_SQL}
SELECT script_type, count(*) FILTER (WHERE NOT correct) AS error_count, count(*) AS total,
       round(count(*) FILTER (WHERE NOT correct)::DOUBLE / count(*), 6) AS error_rate
FROM rv GROUP BY 1 HAVING count(*) FILTER (WHERE NOT correct) > 0""")
def q_error_rate_by(spark, sf):
    return r(R.error_rate_by(rv(spark, sf), "script_type"), ["error_rate"])


# --------------------------------------------------------------------------- J3
@register("error_details", f"""
WITH {REVIEW_SQL}
SELECT review_id, script_type, ground_truth, predicted_label, confidence_score, errors, review FROM rv WHERE NOT correct""")
def q_error_details(spark, sf):
    return R.error_details(rv(spark, sf, text=True), ["review_id", "script_type", "ground_truth", "predicted_label",
                                                      "confidence_score", "errors", "review"])


# --------------------------------------------------------------------------- A33
@register("error_summary", f"""
WITH {REVIEW_SQL}
SELECT 'overall' AS section, NULL::VARCHAR AS key, count(*) FILTER (WHERE NOT correct) AS errors, count(*) AS total,
       count(*) FILTER (WHERE NOT correct)::DOUBLE / count(*) AS error_rate FROM rv
UNION ALL
SELECT 'script_type', script_type, count(*) FILTER (WHERE NOT correct), count(*),
       count(*) FILTER (WHERE NOT correct)::DOUBLE / count(*) FROM rv GROUP BY 2
UNION ALL
SELECT 'ground_truth', ground_truth, count(*), NULL::BIGINT, NULL::DOUBLE FROM rv WHERE NOT correct GROUP BY 2""")
def q_error_summary(spark, sf):
    return R.error_summary(rv(spark, sf))


# --------------------------------------------------------------------------- A19
@register("confidence_by_outcome", f"""
WITH {REVIEW_SQL}
SELECT correct, round(avg(confidence_score), 6) AS mean, round(median(confidence_score), 6) AS median,
       count(*) AS n FROM rv GROUP BY 1""")
def q_confidence_by_outcome(spark, sf):
    return r(R.confidence_by_outcome(rv(spark, sf)), ["mean", "median"])


# --------------------------------------------------------------------------- A20 / A21 on the analyzed documents
@register("kpis", f"""
WITH a AS ({ANALYZE_SQL}), o AS (SELECT * FROM a WHERE status IN ('ok', 'ok_with_warnings'))
SELECT (SELECT count(*) FROM a) AS total, count(*) AS processed, (SELECT count(*) FROM a) - count(*) AS errors,
       count(*) FILTER (WHERE sentiment_label = 'Positive') AS positive,
       count(*) FILTER (WHERE sentiment_label = 'Negative') AS negative,
       count(*) FILTER (WHERE sentiment_label = 'Neutral') AS neutral,
       round(coalesce(avg(confidence_score), 0.0), 6) AS avg_confidence,
       round(coalesce(avg(processing_time_s), 0.0), 6) AS avg_time FROM o""")
def q_kpis(spark, sf):
    return r(R.kpis(analyzed(spark, sf)), ["avg_confidence", "avg_time"])


@register("confidence_by", f"""
WITH a AS ({ANALYZE_SQL}), o AS (SELECT * FROM a WHERE status IN ('ok', 'ok_with_warnings'))
SELECT detected_language, sentiment_label, round(avg(confidence_score), 6) AS avg_confidence FROM o
WHERE (SELECT count(DISTINCT detected_language) FROM o) > 1 GROUP BY ALL""")
def q_confidence_by(spark, sf):
    return r(R.confidence_by(analyzed(spark, sf)), ["avg_confidence"])


# --------------------------------------------------------------------------- A22
@register("histogram", f"""
WITH {REVIEW_SQL},
b AS (SELECT predicted_label, least(greatest(floor((confidence_score - 0.0) * 25.0 / 1.0), 0), 24)::INTEGER AS bin
      FROM rv WHERE confidence_score IS NOT NULL)
SELECT predicted_label, bin + 1 AS bin, round(0.0::DOUBLE + bin * 0.04::DOUBLE, 6) AS bin_lo, count(*) AS count FROM b GROUP BY ALL""")
def q_histogram(spark, sf):
    h = R.histogram(rv(spark, sf), "confidence_score", "predicted_label", 0.0, 1.0, 25)
    return r(h, ["bin_lo"])


# --------------------------------------------------------------------------- A23
@register("box_summary", f"""
WITH {REVIEW_SQL}
SELECT predicted_label, count(confidence_score) AS n, round(quantile_cont(confidence_score, 0.25), 6) AS q1,
       round(quantile_cont(confidence_score, 0.5), 6) AS median, round(quantile_cont(confidence_score, 0.75), 6) AS q3,
       round(avg(confidence_score), 6) AS mean, round(stddev_samp(confidence_score), 6) AS std,
       round(min(confidence_score), 6) AS min, round(max(confidence_score), 6) AS max FROM rv GROUP BY 1""")
def q_box_summary(spark, sf):
    return r(R.box_summary(rv(spark, sf), "confidence_score", "predicted_label"),
             ["q1", "median", "q3", "mean", "std", "min", "max"])


# --------------------------------------------------------------------------- A24
@register("label_balance", f"""
WITH {REVIEW_SQL}, l AS (SELECT unnest({LABELS_SQL}) AS label)
SELECT l.label, (SELECT count(*) FROM rv WHERE ground_truth = l.label) AS true_count,
       (SELECT count(*) FROM rv WHERE predicted_label = l.label) AS predicted_count FROM l""")
def q_label_balance(spark, sf):
    return R.label_balance(rv(spark, sf))


# --------------------------------------------------------------------------- A25-A27 on out-of-vocabulary words
def _oov_pairs(spark, sf):
    """(input, got) for every word occurrence the dictionary leaves unchanged."""
    t = transliterate(docs(spark, sf))
    m = X.explode_rows(t, F.col("transliteration.word_mappings"), "m")
    return m.select(F.col("m.src").alias("input"), F.col("m.dst").alias("got")).filter(
        (F.col("input") == F.col("got")) & F.col("input").rlike(r"\p{L}") & ~X.has_native("input"))


_OOV_SQL = f"""w AS (SELECT unnest({S.tokens_ws('text')}) AS t FROM documents WHERE NOT {S.is_blank('text')}),
oov AS (SELECT t AS input, {S.translit_token('t', LX.roman_lookup())} AS got FROM w
        WHERE regexp_matches(t, '{S.NON_WS}')),
f AS (SELECT * FROM oov WHERE input = got AND regexp_matches(input, '\\pL') AND NOT regexp_matches(input, '{S.KANNADA}'))"""


_ALL_PAIRS_SQL = f"""p AS (SELECT input, got FROM oov WHERE regexp_matches(input, '\\pL')
      UNION ALL SELECT got || input, got FROM oov WHERE regexp_matches(input, '\\pL') AND got <> input
      UNION ALL SELECT input, upper(input) FROM oov WHERE regexp_matches(input, '^[a-z]+$'))"""


@register("translit_error_patterns", f"""
WITH {_OOV_SQL}, {_ALL_PAIRS_SQL}
SELECT CASE WHEN got = input THEN 'unchanged' WHEN regexp_matches(got, '{S.KANNADA}') THEN 'wrong' ELSE 'partial' END
       AS pattern, count(*) AS n FROM p GROUP BY 1""")
def q_translit_error_patterns(spark, sf):
    """Every word with its output; words that changed once more, against an input that they cannot equal; and lower-case
    words with an output that only changes their case: all three patterns occur."""
    t = transliterate(docs(spark, sf))
    m = X.explode_rows(t, F.col("transliteration.word_mappings"), "m")
    m = m.select(F.col("m.src").alias("input"), F.col("m.dst").alias("got")).filter(F.col("input").rlike(r"\p{L}"))
    again = m.filter("got <> input").select(F.concat("got", "input").alias("input"), "got")
    cased = m.filter(F.col("input").rlike("^[a-z]+$")).select("input", F.upper("input").alias("got"))
    pairs = m.unionByName(again).unionByName(cased)
    return R.translit_error_patterns(pairs).groupBy("pattern").agg(F.count("*").alias("n"))


@register("ending_frequency", f"""
WITH {_OOV_SQL}
SELECT substr(input, -2, 2) AS ending, count(*) AS count FROM f WHERE length(input) >= 2
GROUP BY 1 ORDER BY count DESC, ending LIMIT 5""")
def q_ending_frequency(spark, sf):
    return R.ending_frequency(_oov_pairs(spark, sf), "input")


@register("char_frequency", """
WITH c AS (SELECT unnest(regexp_extract_all(lower(text), '(\\pL)', 1)) AS char FROM documents)
SELECT char, count(*) AS count FROM c GROUP BY 1 ORDER BY count DESC, char LIMIT 15""")
def q_char_frequency(spark, sf):
    return R.char_frequency(docs(spark, sf), "text", 15)


# --------------------------------------------------------------------------- T15, A28, A29: round-trip quality
def scored_translations(spark, sf):
    """Romanized text -> native (dictionary) -> English (dictionary), scored against the text."""
    return r(score_translations(docs(spark, sf, ("doc_id", "text", "source")), "doc_id", "text", "source"), ["score"])


_SCORED_SQL = f"""t AS (SELECT doc_id, source, text, {S.transliterated('text')} AS tl FROM documents),
u AS (SELECT *, {S.translated_text('tl')} AS translated FROM t),
v AS (SELECT *, {S.lower_word_set('translated')} AS a, {S.lower_word_set('text')} AS e FROM u),
sc AS (SELECT doc_id, source AS category, 'fallback' AS backend,
  round(CASE WHEN len(e) = 0 THEN 0.0 ELSE least(greatest(len(list_intersect(a, e))::DOUBLE / len(e) * 5.0::DOUBLE,
        1.0::DOUBLE), 5.0::DOUBLE) END, 6) AS score, true AS success,
  CASE WHEN length(text) > 35 THEN substr(text, 1, 32) || '...' ELSE text END AS display FROM v)"""


@register("score_translations", f"WITH {_SCORED_SQL} SELECT * FROM sc")
def q_score_translations(spark, sf):
    return scored_translations(spark, sf)


@register("quality_summary", f"""
WITH {_SCORED_SQL}
SELECT count(*) AS total, count(score) AS scored, round(avg(score), 6) AS avg_score, min(score) AS min_score,
       max(score) AS max_score, {", ".join(f"count(*) FILTER (WHERE score = {i}) AS score_{i}" for i in range(1, 6))},
       round(count(*) FILTER (WHERE success)::DOUBLE / count(*), 6) AS success_rate FROM sc""")
def q_quality_summary(spark, sf):
    return r(R.quality_summary(scored_translations(spark, sf)), ["avg_score", "success_rate"])


@register("quality_by_category", f"""
WITH {_SCORED_SQL}
SELECT category, round(avg(score), 6) AS avg_score, count(*) AS n, list_sort(list_distinct(list(backend))) AS backends
FROM sc WHERE score IS NOT NULL GROUP BY 1""")
def q_quality_by_category(spark, sf):
    return r(R.quality_by_category(scored_translations(spark, sf)), ["avg_score"])


# --------------------------------------------------------------------------- A30, A31, K1, K3
@register("profile_text", f"""
SELECT count(*) AS rows, 5 AS columns, count(*) FILTER (WHERE NOT {S.is_blank('text')}) AS non_empty FROM documents""")
def q_profile_text(spark, sf):
    return R.profile_text(table(spark, sf, "documents"), "text")


@register("label_set", f"""
WITH {REVIEW_SQL}
SELECT list_sort(list_distinct(list(predicted_label))) AS labels, len(list_distinct(list(predicted_label))) AS n_classes
FROM rv""")
def q_label_set(spark, sf):
    return R.label_set(rv(spark, sf), "predicted_label")


@register("first_n", "SELECT doc_id, source, text FROM documents ORDER BY doc_id LIMIT 10")
def q_first_n(spark, sf):
    return R.first_n(table(spark, sf, "documents").select("doc_id", "source", "text"), 10, "doc_id")


@register("top_k", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def q_top_k(spark, sf):
    return R.top_k(table(spark, sf, "documents"), "source", 5)


# --------------------------------------------------------------------------- U1/S10: evaluation set from two sources
@register("eval_set", """
WITH u AS (SELECT doc_id AS review_id, text AS review, source AS product_category, (1 + doc_id % 5)::INTEGER AS rating,
                  lang AS script_type FROM documents
           UNION ALL
           SELECT -(conv_id * 100 + turn) AS review_id, text, role, (1 + turn % 5)::INTEGER, 'conversation'
           FROM conversations)
SELECT *, CASE WHEN rating >= 4 THEN 'Positive' WHEN rating <= 2 THEN 'Negative' ELSE 'Neutral' END AS ground_truth
FROM u""")
def q_eval_set(spark, sf):
    from ..sources.readers import load_eval_set
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("review"), F.col("source").alias("product_category"),
        ((F.col("doc_id") % 5) + 1).cast("int").alias("rating"), F.col("lang").alias("script_type"))
    c = table(spark, sf, "conversations").select(
        (-(F.col("conv_id") * 100 + F.col("turn"))).alias("review_id"), F.col("text").alias("review"),
        F.col("role").alias("product_category"), ((F.col("turn") % 5) + 1).cast("int").alias("rating"),
        F.lit("conversation").alias("script_type"))
    return load_eval_set(d, c)


# --------------------------------------------------------------------------- P2
_RAW_LABEL = ("CASE WHEN toxic = 1 THEN ' negative ' WHEN quality = 1 THEN 'POSITIVE' ELSE 'Neutral' END")


@register("normalize_label", f"""
SELECT raw, CASE WHEN trim(raw) IN ('positive', 'Positive') THEN 'Positive'
                 WHEN trim(raw) IN ('negative', 'Negative') THEN 'Negative'
                 WHEN trim(raw) IN ('neutral', 'Neutral') THEN 'Neutral'
                 WHEN upper(substr(trim(raw), 1, 1)) || lower(substr(trim(raw), 2)) IN ('Positive', 'Negative', 'Neutral')
                   THEN upper(substr(trim(raw), 1, 1)) || lower(substr(trim(raw), 2)) END AS label, count(*) AS n
FROM (SELECT {_RAW_LABEL} AS raw FROM labels) GROUP BY ALL""")
def q_normalize_label(spark, sf):
    lab = table(spark, sf, "labels").select(F.expr(_RAW_LABEL).alias("raw"))
    return lab.groupBy("raw", normalize_label("raw").alias("label")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- P4 / P5
@register("row_status", f"""
WITH {REVIEW_SQL}
SELECT review_id, CASE WHEN status = 'error' THEN 'error' WHEN status = 'skipped' THEN 'skipped'
                       WHEN length(errors) > 0 THEN 'ok_with_warnings' ELSE 'ok' END AS row_status FROM rv""")
def q_row_status(spark, sf):
    v = rv(spark, sf)
    return v.select("review_id", row_status(F.col("errors"), F.col("status") == "skipped",
                                            F.col("status") == "error").alias("row_status"))


@register("flatten_result", f"""
WITH a AS ({S.analyze_sql('documents', 'doc_id', 'text')})
SELECT doc_id, pipeline_steps, errors FROM a""")
def q_flatten_result(spark, sf):
    from ..operators.pipeline import analyze, flatten_result
    a = analyze(docs(spark, sf), "text", keep=["doc_id"], nested=True)
    return flatten_result(a).select("doc_id", "pipeline_steps", "errors")


# --------------------------------------------------------------------------- P8
@register("recode", """
SELECT lang, coalesce(CASE lang WHEN 'en' THEN 'english' END, 'unknown') AS expected_language, count(*) AS n
FROM documents GROUP BY ALL""")
def q_recode(spark, sf):
    d = table(spark, sf, "documents").select("lang")
    return d.groupBy("lang", recode("lang", {"en": "english"}, default="unknown").alias("expected_language")).agg(
        F.count("*").alias("n"))


# --------------------------------------------------------------------------- P9
@register("clean_labelled", """
SELECT d.doc_id, d.text, CAST(l.quality AS VARCHAR) AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.text IS NOT NULL AND l.quality IS NOT NULL""")
def q_clean_labelled(spark, sf):
    from ..sources.readers import clean_labelled
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return clean_labelled(d.join(lab, "doc_id", "left"), "text", "label")


# --------------------------------------------------------------------------- P10
@register("errors_only", f"""
WITH {REVIEW_SQL}
SELECT review_id, script_type, errors FROM rv WHERE NOT correct AND length(errors) > 0""")
def q_errors_only(spark, sf):
    v = rv(spark, sf)
    return errors_only(v).select("review_id", "script_type", "errors")


@register("processed", f"""
WITH {REVIEW_SQL}
SELECT status, count(*) AS n FROM rv WHERE status IN ('ok', 'ok_with_warnings') GROUP BY 1""")
def q_processed(spark, sf):
    v = rv(spark, sf)
    return processed(v).groupBy("status").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- J1
@register("dictionary_join", f"""
WITH {_WORDS_SQL}, {_DICT_SQL},
lw AS (SELECT lower(token) AS word FROM w)
SELECT lw.word, coalesce(dict.expected, lw.word) AS native, count(*) AS n
FROM lw LEFT JOIN dict ON lw.word = dict.word GROUP BY ALL""")
def q_dictionary_join(spark, sf):
    from ..operators.translit import dictionary_join
    words = _doc_words(spark, sf).select(F.lower("token").alias("word"))
    j = dictionary_join(words, "word", LX.dictionary_table(spark, LX.roman_lookup()), out="native")
    return j.groupBy("word", "native").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- T6
_ADDED_SQL = f"""added AS (SELECT DISTINCT lower(tok) AS src, '[' || lower(tok) || ']' AS dst FROM (
    SELECT unnest({S.split_ws(S.strip('text'))}) AS tok FROM benchmark WHERE NOT {S.is_blank('text')}))"""


def _added(spark, sf):
    """A user dictionary of every word of the benchmark texts: each word spelled in brackets."""
    b = table(spark, sf, "benchmark").filter(~X.is_blank("text"))
    toks = X.explode_rows(b, X.split_ws(X.py_strip("text")), "tok").select(F.lower("tok").alias("src")).distinct()
    return toks.withColumn("dst", F.concat(F.lit("["), F.col("src"), F.lit("]")))


@register("dictionary_merge", f"""
WITH {_DICT_SQL}, {_ADDED_SQL}
SELECT src, dst FROM added
UNION ALL SELECT word, expected FROM dict WHERE word NOT IN (SELECT src FROM added)""")
def q_dictionary_merge(spark, sf):
    return LX.merge_dictionary(LX.dictionary_table(spark, LX.roman_lookup()), _added(spark, sf))


# --------------------------------------------------------------------------- T6 + J1 at scale: dictionary as a table
@register("transliterate_by_join", f"""
WITH {_DICT_SQL}, {_ADDED_SQL},
merged AS (SELECT src, dst FROM added UNION ALL SELECT word, expected FROM dict WHERE word NOT IN (SELECT src FROM added)),
tk AS (SELECT doc_id, {S.tokens_ws('text')} AS toks FROM documents),
t AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM tk),
u AS (SELECT *, lower(tok) AS low, {S.rstrip_punct('lower(tok)')} AS stem,
             NOT regexp_matches(tok, '{S.NON_WS}') AS ws,
             regexp_matches(tok, '{S.KANNADA}') OR NOT regexp_matches(tok, '\\pL') AS pass FROM t),
v AS (SELECT u.*, e.dst AS ex, s.dst AS st FROM u LEFT JOIN merged e ON u.low = e.src LEFT JOIN merged s ON u.stem = s.src),
w AS (SELECT doc_id, pos,
        CASE WHEN ws OR pass THEN tok WHEN ex IS NOT NULL THEN ex
             WHEN st IS NOT NULL THEN st || substr(low, length(stem) + 1) ELSE tok END AS dst,
        NOT ws AND NOT pass AND (ex IS NOT NULL OR st IS NOT NULL) AS hit FROM v)
SELECT doc_id, string_agg(dst, '' ORDER BY pos) AS transliterated,
       CASE WHEN bool_or(hit) THEN 'fallback' ELSE 'unchanged' END AS method FROM w GROUP BY doc_id""")
def q_transliterate_by_join(spark, sf):
    t = transliterate(docs(spark, sf), dictionary=_added(spark, sf), key="doc_id")
    return t.select("doc_id", "transliteration.transliterated", "transliteration.method")


# --------------------------------------------------------------------------- T10 translation memories
_MEMORY_SQL = f"""tl AS (SELECT d.doc_id, d.text, {S.transliterated('d.text')} AS src FROM documents d),
mem AS (SELECT {S.strip('tl.src')} AS k, min('[memory] ' || {S.translated_text('tl.src')}) AS tr
        FROM tl JOIN labels l ON tl.doc_id = l.doc_id GROUP BY 1)"""


@register("translate_with", f"""
WITH {_MEMORY_SQL}
SELECT tl.doc_id, CASE WHEN {S.is_blank('tl.src')} THEN tl.src ELSE coalesce(mem.tr, {S.translated_text('tl.src')}) END
         AS translated,
       CASE WHEN mem.tr IS NOT NULL THEN 'memory' ELSE 'fallback' END AS backend
FROM tl LEFT JOIN mem ON {S.strip('tl.src')} = mem.k""")
def q_translate_with(spark, sf):
    from ..operators.translate import translate_with
    t = transliterate(docs(spark, sf)).select("doc_id", F.col("transliteration.transliterated").alias("src"))
    reviewed = t.join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    memory = reviewed.select(F.col("src").alias("source_text"),
                             F.concat(F.lit("[memory] "), translated_text("src")).alias("translated_text"))
    return translate_with(t, "src", [("memory", memory)]).select("doc_id", "translated", "backend")


# --------------------------------------------------------------------------- T17 evaluation document
@register("evaluation_document")
def q_evaluation_document(spark, sf):
    return R.evaluation_document(rv(spark, sf, text=True), analyzed(spark, sf))


# --------------------------------------------------------------------------- T7 rule scheme on the OOV vocabulary
@register("translit_vocab", f"""
WITH {_OOV_SQL}
SELECT word, {S.scheme_spelling('word')} AS spelling FROM (SELECT DISTINCT input AS word FROM f)""")
def q_translit_vocab(spark, sf):
    from ..operators.scheme import scheme_spelling
    words = _oov_pairs(spark, sf).select(F.col("input").alias("word")).distinct()
    return words.select("word", scheme_spelling("word").alias("spelling"))


@register("transliterate_scheme", f"""
WITH {S.spelled_ctes('(SELECT doc_id, text FROM documents)', 'doc_id', 'text', None)}
SELECT CASE WHEN {S.is_blank('text')} THEN 'unchanged' ELSE method END AS method, count(*) AS n
FROM documents LEFT JOIN _sp USING (doc_id) GROUP BY 1""")
def q_transliterate_scheme(spark, sf):
    t = transliterate(docs(spark, sf), key="doc_id", scheme=True)
    return t.groupBy(F.col("transliteration.method").alias("method")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- A26 second form: characters of failed words
@register("problem_chars", f"""
WITH {_OOV_SQL}, c AS (SELECT unnest(regexp_extract_all(input, '(?s)(.)', 1)) AS char FROM f)
SELECT char, count(*) AS count FROM c GROUP BY 1 ORDER BY count DESC, char LIMIT 10""")
def q_problem_chars(spark, sf):
    return R.char_frequency(_oov_pairs(spark, sf), "input", 10, letters_only=False, lower=False)


# --------------------------------------------------------------------------- P11, T18, A25 (list)
@register("select_result_columns", f"""
WITH a AS ({ANALYZE_SQL})
SELECT original_text, sentiment_label, confidence_score, detected_language, transliterated_text, translated_text, errors,
       status, processing_time_s FROM a""")
def q_select_result_columns(spark, sf):
    return select_result_columns(analyzed(spark, sf))


@register("translit_table", f"""
WITH t AS (SELECT doc_id, text AS input, {S.transliterated('text')} AS output, {S.translit_method('text')} AS method FROM documents)
SELECT *, output IS DISTINCT FROM input AS changed FROM t""")
def q_translit_table(spark, sf):
    return translit_table(docs(spark, sf), "doc_id")


@register("unchanged_words", f"""
WITH {_OOV_SQL}
SELECT input AS word, count(*) AS n FROM f GROUP BY 1""")
def q_unchanged_words(spark, sf):
    return R.unchanged_words(_oov_pairs(spark, sf))
