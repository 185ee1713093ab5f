"""Plans of the evaluation document (T17): every section against SQL, the row-level tables, the document itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..operators import evaluation as E
from ..operators.detect import detect_simple
from . import sqlfrag as S
from .catalog import register
from .views import REVIEW_SQL, review_view

EXPECTED = (("en", "english"), ("fr", "english"), ("de", "mixed"))
COLUMNS = E.Columns(dataset="dataset", times=("time_detect", "time_total"), expected=EXPECTED)

_RESULTS_SQL = f"""WITH {REVIEW_SQL}, {S.detection_ctes('rv', 'review_id', 'review')},
res AS (SELECT rv.*, d._lang AS detected_language, CASE WHEN review_id % 3 = 0 THEN 'demo' ELSE 'extended' END AS dataset,
  (length(review) % 100) / 1000.0::DOUBLE AS time_detect, (length(review) % 5000) / 1000.0::DOUBLE AS time_total,
  CASE script_type {' '.join(f"WHEN {S.q(s)} THEN {S.q(l)}" for s, l in EXPECTED)} END AS expected
  FROM rv JOIN _d3 d USING (review_id))"""


def results(spark, sf):
    rv = detect_simple(review_view(spark, sf), "review", "detected_language")
    n = F.length("review")
    return rv.withColumns({"dataset": F.when(F.col("review_id") % 3 == 0, "demo").otherwise("extended"),
                           "time_detect": (n % 100) / 1000.0, "time_total": (n % 5000) / 1000.0})


def _acc(by):
    return (f"SELECT {by} AS a, NULL AS b, count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (correct)::DOUBLE / count(*) AS accuracy, "
            "avg(confidence_score) AS avg_confidence, avg(time_detect) * 1000 AS avg_time_detect_ms, avg(time_total) * 1000 AS avg_time_total_ms "
            "FROM res GROUP BY ALL")


_LABELS = ", ".join(f"({S.q(x)})" for x in FV.LABELS)
_PER_CLASS = f"""SELECT l AS a, NULL AS b, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM (
  SELECT l, count(*) FILTER (ground_truth = l AND predicted_label = l) AS tp, count(*) FILTER (predicted_label = l AND ground_truth IS DISTINCT FROM l) AS fp,
    count(*) FILTER (ground_truth = l AND predicted_label IS DISTINCT FROM l) AS fn FROM res, (VALUES {_LABELS}) v(l) GROUP BY l)"""
_MATRIX = f"""SELECT t AS a, p AS b, n, n::DOUBLE / nullif(sum(n) OVER (PARTITION BY t), 0) AS share FROM (
  SELECT t, p, count(*) FILTER (ground_truth = t AND predicted_label = p) AS n FROM res, (VALUES {_LABELS}) v(t), (VALUES {_LABELS}) u(p) GROUP BY t, p)"""


def _timing(column):
    v = f"{column} * 1000"
    return f"SELECT '{column}' AS a, NULL AS b, avg({v}) AS mean, median({v}) AS median, stddev_samp({v}) AS std, min({v}) AS min, max({v}) AS max FROM res"


_ONE = "SELECT {a} AS a, {b} AS b, count(*) AS n FROM res {where} GROUP BY ALL"
_SECTIONS = {
    "dataset_size": _ONE.format(a="dataset", b="NULL", where=""),
    "sentiment_distribution": _ONE.format(a="ground_truth", b="NULL", where=""),
    "script_distribution": _ONE.format(a="script_type", b="NULL", where=""),
    "category_accuracy": _acc("product_category"), "per_script": _acc("script_type"),
    "overall": "SELECT NULL AS a, NULL AS b, count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (correct)::DOUBLE / count(*) AS accuracy FROM res",
    "per_class": _PER_CLASS, "confusion_matrix": _MATRIX,
    "label_breakdown": "SELECT script_type AS a, ground_truth AS b, count(*) AS n, count(*) FILTER (correct)::DOUBLE / count(*) AS accuracy FROM res GROUP BY ALL",
    "detection": """SELECT NULL AS a, NULL AS b, count(*) AS total, count(*) FILTER (detected_language = expected) AS correct,
      count(*) FILTER (detected_language = expected)::DOUBLE / count(*) AS accuracy FROM res""",
    "detection_per_script": """SELECT script_type AS a, expected AS b, count(*) AS total, count(*) FILTER (detected_language = expected) AS correct,
      count(*) FILTER (detected_language = expected)::DOUBLE / count(*) AS accuracy FROM res WHERE expected IS NOT NULL GROUP BY ALL""",
    "detected_distribution": _ONE.format(a="script_type", b="detected_language", where="WHERE expected IS NOT NULL"),
    "errors": "SELECT NULL AS a, NULL AS b, count(*) FILTER (NOT correct) AS errors, count(*) FILTER (NOT correct)::DOUBLE / count(*) AS error_rate FROM res",
    "errors_by_script": _ONE.format(a="script_type", b="NULL", where="WHERE NOT correct"),
    "errors_by_true_label": _ONE.format(a="ground_truth", b="NULL", where="WHERE NOT correct"),
    "misprediction_patterns": _ONE.format(a="ground_truth", b="predicted_label", where="WHERE NOT correct"),
    "timing_detect": _timing("time_detect"), "timing_total": _timing("time_total"),
}


_ACC = ["total", "correct", "accuracy"]
_METRICS = {"category_accuracy": _ACC + ["avg_confidence", "avg_time_detect_ms", "avg_time_total_ms"], "overall": _ACC, "detection": _ACC,
            "detection_per_script": _ACC, "per_class": ["precision", "recall", "f1", "support"], "confusion_matrix": ["n", "share"],
            "label_breakdown": ["n", "accuracy"], "errors": ["errors", "error_rate"],
            "timing_detect": ["mean", "median", "std", "min", "max"]}
_METRICS |= {"per_script": _METRICS["category_accuracy"], "timing_total": _METRICS["timing_detect"]}


def _long(section, sql):
    name = section.split("_")[0] if section.startswith("timing") else section
    metrics = ", ".join(f"{{'metric': '{m}', 'value': {m}::DOUBLE}}" for m in _METRICS.get(section, ["n"]))
    return (f"SELECT '{name}' AS section, a, b, m.metric AS metric, round(m.value, 6) AS value FROM "
            f"(SELECT a::VARCHAR AS a, b::VARCHAR AS b, unnest([{metrics}]) AS m FROM ({sql}))")


@register("evaluation_sections", f"""{_RESULTS_SQL}
{' UNION ALL '.join(_long(k, v) for k, v in _SECTIONS.items())}""")
def q_evaluation_sections(spark, sf):
    return E.Evaluation(results(spark, sf), COLUMNS).long().withColumn("value", F.round("value", 6))


@register("evaluation_cube", f"""{_RESULTS_SQL}
SELECT dataset, script_type AS script, product_category AS category, ground_truth AS truth, predicted_label AS pred, detected_language AS detected,
  expected, count(*) AS n, round(sum(confidence_score), 6) AS confidence FROM res GROUP BY ALL""")
def q_evaluation_cube(spark, sf):
    cube = E.evaluation_cube(results(spark, sf), COLUMNS).filter("set = 0")
    return cube.select(*E.DIMENSIONS, "n", F.round("confidence", 6).alias("confidence"))


@register("evaluation_full_results", f"""{_RESULTS_SQL}
SELECT review_id, script_type, product_category, rating, ground_truth, predicted_label, round(confidence_score, 4) AS confidence_score,
  detected_language, correct, round(time_detect * 1000, 3) AS time_detect_ms, round(time_total * 1000, 3) AS time_total_ms,
  errors AS pipeline_errors FROM res""")
def q_evaluation_full_results(spark, sf):
    return E.full_results(results(spark, sf), COLUMNS)


@register("evaluation_error_details", f"""{_RESULTS_SQL}
SELECT review_id, script_type, ground_truth, predicted_label, round(confidence_score, 4) AS confidence, errors AS pipeline_errors,
  detected_language FROM res WHERE NOT correct""")
def q_evaluation_error_details(spark, sf):
    return E.error_details(results(spark, sf), COLUMNS)


@register("evaluation_full_document")
def q_evaluation_full_document(spark, sf):
    config = {"translation_backend": "fallback", "use_transliteration_model": False, "auto_fallback": True}
    return E.Evaluation(results(spark, sf), COLUMNS).document("2026-01-01T00:00:00", config)
