"""Metric operators re-derive the recorded numbers from the golden confusion counts."""

import pytest

from vimarsha.operators import metrics as M

L = ["Positive", "Negative", "Neutral"]


def expand(spark, grid, labels):
    rows = []
    for i, t in enumerate(labels):
        for j, p in enumerate(labels):
            rows += [(t, p)] * grid[i][j]
    return spark.createDataFrame(rows, "ground_truth string, predicted_label string")


@pytest.mark.parametrize("grid, acc, macro, weighted, prf", [
    ([[18, 6, 0], [0, 24, 0], [1, 1, 0]], 0.84, 0.56998, 0.82077,
     {"Positive": (0.9474, 0.75, 0.8372), "Negative": (0.7742, 1.0, 0.8727), "Neutral": (0, 0, 0)}),
    ([[24, 0, 0], [2, 22, 0], [1, 1, 0]], 0.92, 0.62578, 0.90113,
     {"Positive": (0.8889, 1.0, 0.9412), "Negative": (0.9565, 0.9167, 0.9362), "Neutral": (0, 0, 0)}),
])
def test_pipeline_runs(spark, grid, acc, macro, weighted, prf):
    df = expand(spark, grid, L)
    s = M.f1_summary(df).collect()[0]
    assert s.accuracy == pytest.approx(acc, abs=1e-4)
    assert s.macro_f1 == pytest.approx(macro, abs=1e-4)
    assert s.weighted_f1 == pytest.approx(weighted, abs=1e-4)
    per = {r.label: r for r in M.per_class_metrics(df).collect()}
    for lab, (p, r, f) in prf.items():
        assert per[lab].precision == pytest.approx(p, abs=1e-4)
        assert per[lab].recall == pytest.approx(r, abs=1e-4)
        assert per[lab].f1 == pytest.approx(f, abs=1e-4)
    assert per["Neutral"].support == 2


@pytest.mark.parametrize("grid, acc, macro", [
    ([[103, 13], [30, 85]], 0.81385, 0.81272),
    ([[95, 21], [19, 96]], 0.82684, 0.82684),
    ([[97, 19], [21, 94]], 0.82684, 0.82681),
])
def test_classifier_benchmark_numbers(spark, grid, acc, macro):
    df = expand(spark, grid, ["Positive", "Negative"])
    s = M.f1_summary(df).collect()[0]
    assert s.accuracy == pytest.approx(acc, abs=1e-5)
    assert s.macro_f1 == pytest.approx(macro, abs=1e-5)


def test_report_and_matrix(spark):
    df = expand(spark, [[18, 6, 0], [0, 24, 0], [1, 1, 0]], L)
    rep = {r.row: r for r in M.classification_report(df).collect()}
    assert set(rep) == {"Positive", "Negative", "Neutral", "accuracy", "macro avg", "weighted avg"}
    assert rep["accuracy"].f1_score == pytest.approx(0.84)
    cm = {(r.truth, r.pred): r for r in M.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[("Neutral", "Neutral")].n == 0
    assert cm[("Positive", "Positive")].share == pytest.approx(0.75)


def test_metrics_by_group_uses_present_labels(spark):
    rows = [("a", "Positive", "Positive"), ("a", "Negative", "Positive"), ("b", "Neutral", "Neutral")]
    df = spark.createDataFrame(rows, "script_type string, ground_truth string, predicted_label string")
    got = {r.script_type: r for r in M.metrics_by(df, "script_type").collect()}
    assert got["b"].macro_f1 == pytest.approx(1.0)
    assert got["a"].macro_f1 == pytest.approx((2 / 3 + 0) / 2)
