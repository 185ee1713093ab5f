import pytest
from pyspark.sql import functions as F

from conftest import SF
from vimarsha.operators import ml as ML
from vimarsha.plans.catalog import plans


def test_stratified_split_exact_counts(spark):
    rows = [(i, "A" if i % 3 else "B") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, label string")
    s = ML.stratified_split(df, "id", "label", 0.2, 42)
    counts = {(r.label, r.split): r["count"] for r in s.groupBy("label", "split").count().collect()}
    n_a, n_b = 666, 334
    assert counts[("A", "test")] + counts[("B", "test")] == 200
    assert abs(counts[("A", "test")] - 0.2 * n_a) < 1 and abs(counts[("B", "test")] - 0.2 * n_b) < 1
    again = ML.stratified_split(df.repartition(3), "id", "label", 0.2, 42)
    assert s.filter("split = 'test'").select("id").subtract(again.filter("split = 'test'").select("id")).count() == 0


def test_keys_may_be_text(spark):
    df = spark.createDataFrame([(f"indic_{i}", "A" if i % 2 else "B") for i in range(400)], "id string, label string")
    s = ML.stratified_split(df, "id", "label", 0.25)
    assert s.filter("split = 'test'").groupBy("label").count().collect()[0]["count"] == 50
    assert 10 < ML.holdout_split(df, "id", 0.1).filter("split = 'validation'").count() < 80


def test_margin_models_score_with_probabilities(spark):
    rows = [(i, "good fine nice" if i % 2 else "bad awful poor", "Positive" if i % 2 else "Negative") for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t string, l string")
    model, labels, _ = ML.train_sentiment(df, "k", "t", "l", classifier="linear_svm")
    out = ML.TextModelScorer(model, labels).score(df.limit(10), "t").collect()
    assert all(r.sentiment.label == r.l and 0.5 <= r.sentiment.confidence <= 1 for r in out)


def test_exact_quantiles(spark):
    import statistics

    from vimarsha.operators.report import box_summary, confidence_by_outcome, numeric_summary
    import random
    r = random.Random(1)
    rows = [("a", r.choice([1.0, 2.5, 2.5, r.uniform(0, 9)])) for _ in range(301)] + [("b", 4.0)] * 7 + [(None, x) for x in (1.0, 2.0, 9.0, 10.0)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: x for x in box_summary(df, "v", "g").collect()}
    for g in ("a", "b", None):
        v = sorted(y for x, y in rows if x == g)
        q = statistics.quantiles(v, n=4, method="inclusive")
        assert all(abs(x - y) < 1e-9 for x, y in zip((got[g].q1, got[g].median, got[g].q3), q)), g
    assert got["c"].median is None and got["c"].n == 0
    assert numeric_summary(df.select("v"), ["v"]).first().median == statistics.median(y for _, y in rows if y is not None)
    plan = confidence_by_outcome(df.withColumnRenamed("v", "confidence_score"), "g")._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median(" not in plan


def test_holdout_is_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = ML.holdout_split(df, "k", 0.1).filter("split = 'validation'")
    assert 350 < a.count() < 650
    assert a.subtract(ML.holdout_split(df.repartition(7), "k", 0.1).filter("split = 'validation'")).count() == 0


def test_naive_bayes_benchmark_runs(spark):
    r = plans()["bench_nb"][0](spark, SF).collect()
    assert len(r) == 1 and 0.0 <= r[0].accuracy <= 1.0 and r[0].best


def test_stream_equals_batch(spark):
    p = plans()
    stream = {r.status: r.n for r in p["running_counts"][0](spark, SF).collect()}
    batch = {r.status: r.n for r in p["analyze"][0](spark, SF).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert stream == batch


def test_unknown_classifier(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "k long, t string, l string")
    with pytest.raises(ValueError, match="Unknown classifier"):
        ML.benchmark_classifiers(df, "k", "t", "l", ["forest"])


def _reviews(spark, n, seed):
    import random
    r = random.Random(seed)
    words = {"Positive": "good fine nice lovely", "Negative": "bad awful poor broken", "Neutral": "plain okay so usual"}
    rows = []
    for i in range(n):
        label = list(words)[i % 3]
        rows.append((i, " ".join(r.choice((words[label] if r.random() < .9 else words[r.choice(list(words))]).split()) for _ in range(5)), label))
    return spark.createDataFrame(rows, "k long, t string, l string")


def test_benchmark_holds_per_class_rows_sizes_and_report(spark):
    b = ML.run_benchmark(_reviews(spark, 150, 1), "k", "t", "l")
    assert b.sizes == {"dataset": 150, "train": 120, "test": 30} and b.labels == ["Negative", "Neutral", "Positive"]
    per = b.per_class().collect()
    assert len(per) == 9 and all(sum(r.support for r in per if r.classifier == c) == 30 for c in ML.CLASSIFIERS)
    summary = {r.name: r for r in b.summary().collect()}
    assert sorted(r["rank"] for r in summary.values()) == [1, 2, 3] and summary["naive_bayes"].baseline
    for c in ML.CLASSIFIERS:
        f1 = [r.f1 for r in per if r.classifier == c]
        assert abs(sum(f1) / 3 - summary[c].macro_f1) < 1e-9 and summary[c].macro_f1 > .8 and summary[c].train_size == 120
    best = next(r.name for r in summary.values() if r.best)
    report = {r.row: r for r in b.report().collect()}
    assert set(report) == {*b.labels, "accuracy", "macro avg", "weighted avg"}
    assert abs(report["macro avg"].f1_score - summary[best].macro_f1) < 1e-9


@pytest.mark.parametrize("classifier", ["logistic_regression", "naive_bayes"])
def test_train_with_a_validation_table_save_and_reload(spark, tmp_path, classifier):
    train, val = _reviews(spark, 90, 2), _reviews(spark, 30, 3)
    path = str(tmp_path / "m")
    model, labels, metrics = ML.train_sentiment(train, "k", "t", "l", path, classifier=classifier, validation=val, dataset="reviews")
    loaded, names, record = ML.load_sentiment(spark, path)
    assert names == labels and (record.base, record.dataset, record.n_train, record.n_validation) == (classifier, "reviews", 90, 30)
    assert record.metrics.accuracy == metrics.first().accuracy > .8 and record.model_path == path
    a, b = (ML.TextModelScorer(m, labels).score(val, "t").orderBy("k").collect() for m in (model, loaded))
    assert a == b and all(len(r.sentiment.raw_scores) == 3 and abs(sum(r.sentiment.probabilities.values()) - 1) < 1e-9 for r in a)
