import pytest

from conftest import one_col
from vimarsha.operators.pipeline import RESULT_COLUMNS, analyze


def _run(spark, texts, **kw):
    return analyze(one_col(spark, texts), "text", keep=["id"], **kw).orderBy("id").collect()


def test_batch_contract(spark):
    texts = ["This is great!", "ಚೆನ್ನಾಗಿದೆ", "tumba olle", "", "   ", None]
    rows = _run(spark, texts)
    assert len(rows) == len(texts)
    assert [c for c in rows[0].asDict() if c != "id"] == RESULT_COLUMNS
    assert [r.status for r in rows[3:]] == ["skipped"] * 3
    assert rows[3].errors == "Empty or whitespace-only string"
    assert rows[5].errors == "Expected str, got NoneType"
    assert all(r.sentiment_label in ("Positive", "Negative", "Neutral") for r in rows)
    assert all(0.0 <= r.confidence_score <= 1.0 and 0.0 <= r.detection_confidence <= 1.0 for r in rows)


def test_routes_and_steps(spark):
    rows = _run(spark, ["ತುಂಬಾ ಚೆನ್ನಾಗಿದೆ", "tumba chennagide", "This product is excellent and I love it",
                        "Hello!!! World??? Great!!!!"])
    kn, ro, en, mx = rows
    assert kn.pipeline_steps == "language_detection, translation, sentiment_classification"
    assert kn.translated_text == "very is good" and kn.transliterated_text is None
    assert ro.pipeline_steps == "language_detection, transliteration, translation, sentiment_classification"
    assert ro.transliterated_text == "ತುಂಬ ಚೆನ್ನಾಗಿದೆ" and ro.translated_text == "very is good"
    assert en.pipeline_steps == "language_detection, sentiment_classification" and en.status == "ok"
    assert mx.errors == "Language is 'mixed'; attempting direct sentiment classification."
    assert mx.status == "ok_with_warnings"
    assert en.sentiment_label == "Positive"


def test_wrong_column(spark):
    with pytest.raises(ValueError, match="Column 'nonexistent' not found"):
        analyze(one_col(spark, ["x"]), "nonexistent")


def test_nested_form(spark):
    r = analyze(one_col(spark, ["tumba chennagide"]), "text", nested=True).collect()[0]
    assert r.pipeline_steps == ["language_detection", "transliteration", "translation", "sentiment_classification"]
    assert r.errors == []


def test_langid_signal_in_pipeline(spark):
    df = spark.createDataFrame([(0, "Hello!!! World??? Great!!!!", "en", 0.99)],
                               "id int, text string, top string, p double")
    r = analyze(df, "text", langid=("top", "p")).collect()[0]
    assert r.detected_language == "english" and r.status == "ok"


def test_batch_udf_scorer_in_pipeline(spark):
    from vimarsha.operators.score import BatchModelScorer

    def length_model():  # defined inside the test so it is shipped to workers by value
        import numpy as np

        def predict(texts):
            n = np.array([len(t) for t in texts], dtype=float)
            return np.stack([np.zeros_like(n), np.where(n > 20, 2.0, -2.0)], axis=1)
        return predict

    scorer = BatchModelScorer(length_model, ["Negative", "Positive"], batch_size=4)
    rows = _run(spark, ["short one", "This product is excellent and I love it", ""], scorer=scorer)
    assert [r.sentiment_label for r in rows] == ["Negative", "Positive", "Neutral"]
    assert rows[2].status == "skipped"
