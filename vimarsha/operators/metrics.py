"""Classification metrics from one small confusion-count table.

Every metric here starts from ``confusion_counts`` -- a single ``groupBy(by..., truth, pred)
.count()``, i.e. one shuffle with map-side partial aggregation whose output has at most
|groups| x |labels|^2 rows however large the input is. Everything after that works on that
tiny table (joins and aggregations over a few dozen rows), so nothing large is ever collected.

Conventions (zero division -> 0): precision = tp/(tp+fp), recall = tp/(tp+fn),
f1 = 2tp/(2tp+fp+fn). Macro F1 averages over the labels present in truth or prediction
(per group for ``metrics_by``), weighted F1 weights by support.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..session import cut_lineage


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_correct(df: DataFrame, truth: str = "ground_truth", pred: str = "predicted_label",
                 out: str = "correct") -> DataFrame:
    """Null-safe equality flag."""
    return df.withColumn(out, F.col(truth).eqNullSafe(F.col(pred)))


def confusion_counts(df: DataFrame, truth: str = "ground_truth", pred: str = "predicted_label",
                     by: list[str] | None = None) -> DataFrame:
    """(by..., truth, pred, n): the only pass over the big table.

    The few rows are kept (a reliable checkpoint in the shared folder), as several metrics read them: the plans
    above start from them and hold no scan of the big table.
    """
    by = list(by or [])
    return cut_lineage(df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred"))
                       .agg(F.count("*").alias("n")))


def label_stats(counts: DataFrame, by: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """(by..., label, tp, fp, fn, support, predicted, precision, recall, f1).

    A count row (truth, pred, n) only ever contributes to the labels ``truth`` and ``pred``, so
    each row is expanded to those labels (or to the fixed label list) and re-aggregated: no join.
    """
    by = list(by or [])
    t, p = F.col("truth"), F.col("pred")
    labs = (F.array(*[F.lit(x) for x in labels]) if labels is not None
            else F.filter(F.array_distinct(F.array(t, p)), lambda x: x.isNotNull()))
    ex = counts.select(*by, "truth", "pred", "n", F.explode(labs).alias("label"))
    lab, n = F.col("label"), F.col("n")
    agg = ex.groupBy(*by, "label").agg(
        F.sum(F.when((t == lab) & (p == lab), n).otherwise(0)).alias("tp"),
        F.sum(F.when((p == lab) & ~t.eqNullSafe(lab), n).otherwise(0)).alias("fp"),
        F.sum(F.when((t == lab) & ~p.eqNullSafe(lab), n).otherwise(0)).alias("fn"),
        F.sum(F.when(t == lab, n).otherwise(0)).alias("support"),
        F.sum(F.when(p == lab, n).otherwise(0)).alias("predicted"),
    )
    return agg.select(
        *by, "label", "tp", "fp", "fn", "support", "predicted",
        _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def per_class_metrics(df: DataFrame, truth: str = "ground_truth", pred: str = "predicted_label",
                      labels: list[str] | None = FV.LABELS, by: list[str] | None = None) -> DataFrame:
    """A5: precision / recall / f1 / support per label (fixed label list by default)."""
    st = label_stats(confusion_counts(df, truth, pred, by), by, labels)
    return st.select(*(by or []), "label", "precision", "recall", "f1", "support")


def summary_from_stats(stats: DataFrame, counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A3/A6/A7 per group: n, correct, accuracy, macro/weighted precision, recall, f1."""
    by = list(by or [])
    tot = counts.groupBy(*by).agg(F.sum("n").alias("n"),
                                  F.sum(F.when(F.col("truth").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0))
                                  .alias("correct"))
    s = stats.groupBy(*by).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        _div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("weighted_precision"),
        _div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("weighted_recall"),
        _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )
    if not by:  # both sides are single rows: the label summary enters as scalar subqueries
        j = tot.withColumns({c: s.select(c).scalar() for c in s.columns})
    else:
        j = tot.join(s, by, "left")
    return j.select(*by, "n", "correct", _div(F.col("correct"), F.col("n")).alias("accuracy"),
                    "macro_precision", "macro_recall", "macro_f1",
                    "weighted_precision", "weighted_recall", "weighted_f1")


def accuracy(df: DataFrame, truth: str = "ground_truth", pred: str = "predicted_label") -> DataFrame:
    """A3: one row (n, correct, accuracy)."""
    eq = F.col(truth).eqNullSafe(F.col(pred))
    return df.agg(F.count("*").alias("n"), F.count_if(eq).alias("correct"),
                  _div(F.count_if(eq), F.count("*")).alias("accuracy"))


def f1_summary(df: DataFrame, truth: str = "ground_truth", pred: str = "predicted_label",
               by: list[str] | None = None) -> DataFrame:
    """A6 (+A3, A7): summary over labels present in truth or prediction."""
    counts = confusion_counts(df, truth, pred, by)
    return summary_from_stats(label_stats(counts, by, None), counts, by)


def weighted_metrics(df: DataFrame, truth: str = "ground_truth", pred: str = "predicted_label") -> DataFrame:
    """Accuracy + weighted precision / recall / f1."""
    return f1_summary(df, truth, pred).select("accuracy", "weighted_precision", "weighted_recall", "weighted_f1")


def metrics_by(df: DataFrame, key: str, truth: str = "ground_truth", pred: str = "predicted_label") -> DataFrame:
    """Per group count, correct, accuracy, macro F1 over the labels present in that group."""
    return f1_summary(df, truth, pred, [key]).select(key, "n", "correct", "accuracy", "macro_f1")


def classification_report(df: DataFrame, truth: str = "ground_truth", pred: str = "predicted_label",
                          labels: list[str] | None = None) -> DataFrame:
    """Rows per class + 'accuracy' + 'macro avg' + 'weighted avg' (precision, recall, f1, support)."""
    return report_of(confusion_counts(df, truth, pred), labels)


def report_of(counts: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """A8 from counts (truth, pred, n)."""
    st = label_stats(counts, None, labels)
    summ = summary_from_stats(st, counts)
    cls = st.select(F.col("label").alias("row"), "precision", "recall", F.col("f1").alias("f1_score"),
                    F.col("support").cast("long").alias("support"))

    def line(name, precision, recall, f1):
        return F.struct(F.lit(name).alias("row"), F.col(precision).alias("precision"), F.col(recall).alias("recall"),
                        F.col(f1).alias("f1_score"), F.col("n").cast("long").alias("support"))
    # one summary row unfolds into its three lines
    lines = summ.select(F.explode(F.array(
        line("accuracy", "accuracy", "accuracy", "accuracy"), line("macro avg", "macro_precision", "macro_recall", "macro_f1"),
        line("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"))).alias("x")).select("x.*")
    return cls.unionByName(lines)


def confusion_matrix(df: DataFrame, truth: str = "ground_truth", pred: str = "predicted_label",
                     labels: list[str] = FV.LABELS) -> DataFrame:
    """A4: full label x label grid with counts (0 filled) and the row-normalised share.

    A truth label with no rows gives NULL shares (the reference shows NaN).
    """
    return matrix_of(confusion_counts(df, truth, pred), labels)


def matrix_of(counts: DataFrame, labels: list[str] = FV.LABELS) -> DataFrame:
    """A4 from counts (truth, pred, n)."""
    grid = counts.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "truth string, pred string")
    j = grid.join(counts, ["truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = j.groupBy("truth").agg(F.sum("n").alias("row_total"))
    j = j.join(rows, "truth")
    return j.select("truth", "pred", F.col("n").cast("long").alias("n"),
                    F.try_divide(F.col("n").cast("double"), F.col("row_total").cast("double")).alias("share"))


def evaluation_report(df: DataFrame, truth: str = "ground_truth", pred: str = "predicted_label",
                      key: str = "script_type") -> DataFrame:
    """Overall and per-group summary from one count table, in long form.

    ``scope`` is 'overall' or the group value.
    """
    counts = confusion_counts(df, truth, pred, [key])
    overall_counts = counts.groupBy("truth", "pred").agg(F.sum("n").alias("n"))
    overall = summary_from_stats(label_stats(overall_counts, None, None), overall_counts)
    per = summary_from_stats(label_stats(counts, [key], None), counts, [key])
    cols = ["n", "correct", "accuracy", "macro_f1", "weighted_f1"]
    return (overall.select(F.lit("overall").alias("scope"), *cols)
            .unionByName(per.select(F.col(key).cast("string").alias("scope"), *cols)))
