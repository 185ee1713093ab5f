"""Plans for the metric operators (A3-A9, T16, P1, P7) on the review view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import rating_to_sentiment
from ..operators import metrics as M
from .catalog import register, table
from .views import REVIEW_SQL, review_view

LABELS_SQL = "['Positive', 'Negative', 'Neutral']"


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def stats_sql(by: list[str], labels_sql: str | None) -> str:
    """CTEs ``c`` (counts) and ``st`` (per-label stats) over ``rv``."""
    b = "".join(f"{x}, " for x in by)
    labs = labels_sql or "list_filter(list_distinct([truth, pred]), lambda x: x IS NOT NULL)"
    return f"""c AS (SELECT {b}ground_truth AS truth, predicted_label AS pred, count(*) AS n FROM rv GROUP BY ALL),
e AS (SELECT {b}truth, pred, n, unnest({labs}) AS label FROM c),
s0 AS (SELECT {b}label,
   sum(CASE WHEN truth = label AND pred = label THEN n ELSE 0 END) AS tp,
   sum(CASE WHEN pred = label AND truth IS DISTINCT FROM label THEN n ELSE 0 END) AS fp,
   sum(CASE WHEN truth = label AND pred IS DISTINCT FROM label THEN n ELSE 0 END) AS fn,
   sum(CASE WHEN truth = label THEN n ELSE 0 END) AS support
   FROM e GROUP BY ALL),
st AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
   CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
   CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM s0)"""


def summary_sql(by: list[str]) -> str:
    b = ", ".join(by)
    g = f"GROUP BY {b}" if by else ""
    on = " AND ".join(f"t.{x} = s.{x}" for x in by) or "TRUE"
    sel = "".join(f"t.{x}, " for x in by)
    return f"""tot AS (SELECT {b + ', ' if by else ''}sum(n) AS n,
   sum(CASE WHEN truth IS NOT DISTINCT FROM pred THEN n ELSE 0 END) AS correct FROM c {g}),
sm AS (SELECT {b + ', ' if by else ''}avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
   sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall,
   sum(f1 * support) / sum(support) AS weighted_f1 FROM st {g}),
summ AS (SELECT {sel}t.n, t.correct, t.correct::DOUBLE / t.n AS accuracy, s.macro_precision, s.macro_recall,
   s.macro_f1, s.weighted_precision, s.weighted_recall, s.weighted_f1 FROM tot t LEFT JOIN sm s ON {on})"""


def r6(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# --------------------------------------------------------------------------- P1
@register("rating_to_sentiment", """
SELECT 1 + doc_id % 5 AS rating, CASE WHEN 1 + doc_id % 5 >= 4 THEN 'Positive' WHEN 1 + doc_id % 5 <= 2 THEN 'Negative'
       ELSE 'Neutral' END AS ground_truth, count(*) AS n FROM documents GROUP BY ALL""")
def q_rating_to_sentiment(spark, sf):
    d = table(spark, sf, "documents").select(((F.col("doc_id") % 5) + 1).cast("int").alias("rating"))
    return d.groupBy("rating", rating_to_sentiment("rating").alias("ground_truth")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- P7
@register("with_correct", f"""
WITH {REVIEW_SQL}
SELECT review_id, ground_truth, predicted_label, ground_truth IS NOT DISTINCT FROM predicted_label AS correct FROM rv""")
def q_with_correct(spark, sf):
    rv = review_view(spark, sf, with_text=False).drop("correct")
    return M.with_correct(rv).select("review_id", "ground_truth", "predicted_label", "correct")


# --------------------------------------------------------------------------- A3
@register("accuracy", f"""
WITH {REVIEW_SQL}
SELECT count(*) AS n, count(*) FILTER (WHERE correct) AS correct,
       round(count(*) FILTER (WHERE correct)::DOUBLE / count(*), 6) AS accuracy FROM rv""")
def q_accuracy(spark, sf):
    return _r6(M.accuracy(review_view(spark, sf, with_text=False)), ["accuracy"])


# --------------------------------------------------------------------------- A4
@register("confusion_matrix", f"""
WITH {REVIEW_SQL},
c AS (SELECT ground_truth AS truth, predicted_label AS pred, count(*) AS n FROM rv GROUP BY ALL),
g AS (SELECT a.truth, b.pred FROM (SELECT unnest({LABELS_SQL}) AS truth) a, (SELECT unnest({LABELS_SQL}) AS pred) b),
j AS (SELECT g.truth, g.pred, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.truth = c.truth AND g.pred = c.pred)
SELECT truth, pred, n, round(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY truth), 0), 6) AS share FROM j""")
def q_confusion_matrix(spark, sf):
    return _r6(M.confusion_matrix(review_view(spark, sf, with_text=False)), ["share"])


# --------------------------------------------------------------------------- A5
@register("per_class_metrics", f"""
WITH {REVIEW_SQL}, {stats_sql([], LABELS_SQL)}
SELECT label, {r6(['precision', 'recall', 'f1'])}, support FROM st""")
def q_per_class_metrics(spark, sf):
    return _r6(M.per_class_metrics(review_view(spark, sf, with_text=False)), ["precision", "recall", "f1"])


_SUMMARY_COLS = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision",
                 "weighted_recall", "weighted_f1"]


# --------------------------------------------------------------------------- A6
@register("f1_summary", f"""
WITH {REVIEW_SQL}, {stats_sql([], None)}, {summary_sql([])}
SELECT n, correct, {r6(_SUMMARY_COLS)} FROM summ""")
def q_f1_summary(spark, sf):
    return _r6(M.f1_summary(review_view(spark, sf, with_text=False)), _SUMMARY_COLS)


# --------------------------------------------------------------------------- A7
@register("weighted_metrics", f"""
WITH {REVIEW_SQL}, {stats_sql([], None)}, {summary_sql([])}
SELECT {r6(['accuracy', 'weighted_precision', 'weighted_recall', 'weighted_f1'])} FROM summ""")
def q_weighted_metrics(spark, sf):
    return _r6(M.weighted_metrics(review_view(spark, sf, with_text=False)),
               ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1"])


# --------------------------------------------------------------------------- A8
@register("classification_report", f"""
WITH {REVIEW_SQL}, {stats_sql([], None)}, {summary_sql([])},
u AS (SELECT label AS row, precision, recall, f1 AS f1_score, support::BIGINT AS support FROM st
  UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, n::BIGINT FROM summ
  UNION ALL SELECT 'macro avg', macro_precision, macro_recall, macro_f1, n::BIGINT FROM summ
  UNION ALL SELECT 'weighted avg', weighted_precision, weighted_recall, weighted_f1, n::BIGINT FROM summ)
SELECT row, {r6(['precision', 'recall', 'f1_score'])}, support FROM u""")
def q_classification_report(spark, sf):
    return _r6(M.classification_report(review_view(spark, sf, with_text=False)), ["precision", "recall", "f1_score"])


# --------------------------------------------------------------------------- A9
@register("metrics_by", f"""
WITH {REVIEW_SQL}, {stats_sql(['script_type'], None)}, {summary_sql(['script_type'])}
SELECT script_type, n, correct, {r6(['accuracy', 'macro_f1'])} FROM summ""")
def q_metrics_by(spark, sf):
    return _r6(M.metrics_by(review_view(spark, sf, with_text=False), "script_type"), ["accuracy", "macro_f1"])


# --------------------------------------------------------------------------- T16
@register("evaluation_report", f"""
WITH {REVIEW_SQL}, {stats_sql(['script_type'], None)}, {summary_sql(['script_type'])},
c_all AS (SELECT truth, pred, sum(n) AS n FROM c GROUP BY ALL),
e_all AS (SELECT truth, pred, n, unnest(list_filter(list_distinct([truth, pred]), lambda x: x IS NOT NULL)) AS label
          FROM c_all),
s_all AS (SELECT label, sum(CASE WHEN truth = label AND pred = label THEN n ELSE 0 END) AS tp,
   sum(CASE WHEN pred = label AND truth IS DISTINCT FROM label THEN n ELSE 0 END) AS fp,
   sum(CASE WHEN truth = label AND pred IS DISTINCT FROM label THEN n ELSE 0 END) AS fn,
   sum(CASE WHEN truth = label THEN n ELSE 0 END) AS support FROM e_all GROUP BY label),
f_all AS (SELECT support, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END AS f1
          FROM s_all),
o AS (SELECT 'overall' AS scope, (SELECT sum(n) FROM c_all) AS n,
             (SELECT sum(n) FILTER (WHERE truth IS NOT DISTINCT FROM pred) FROM c_all) AS correct,
             avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM f_all)
SELECT scope, n, correct, round(correct::DOUBLE / n, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(weighted_f1, 6) AS weighted_f1 FROM o
UNION ALL
SELECT script_type, n, correct, {r6(['accuracy', 'macro_f1', 'weighted_f1'])} FROM summ""")
def q_evaluation_report(spark, sf):
    return _r6(M.evaluation_report(review_view(spark, sf, with_text=False)), ["accuracy", "macro_f1", "weighted_f1"])

