"""Vectors made from words inside the tasks equal those of the model's Spark ML stages."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vimarsha.functions import text as X
from vimarsha.operators import ml as ML
from vimarsha.operators import ngrams as G
from vimarsha.operators.linear import margins

TEXTS = ["Ab ab　abc", " ab\n", "", None, " ", "é ಕನ್ನಡ x", "x x x ab", "zzz", "ಕನ್ನಡ abc"]


def test_vectors_equal_the_stages(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, t string").coalesce(1)
    for size in (G.CHUNK_BYTES, 4):
        monkeypatch.setattr(G, "CHUNK_BYTES", size)
        model = ML.fit_tfidf(df, "t")
        grams = df.select("k", X.char_wb_ngrams(F.coalesce("t", F.lit(""))).alias("_vm_grams"))
        want = {r.k: r.features for r in model.transform(grams).collect()}
        got = {r.k: r.features for r in ML.tfidf_features(df, model, "t").collect()}
        assert len(got) == len(TEXTS)
        for k in want:
            assert list(got[k].indices) == list(want[k].indices) and np.allclose(got[k].values, want[k].values, rtol=1e-14)


def test_vocabulary_counts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").repartition(3)
    grams = df.select(F.monotonically_increasing_id().alias("k"), X.char_wb_ngrams("t").alias("g"))
    want = X.explode_rows(grams, F.col("g"), "g", "k").groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("k").alias("df"))
    for least in (1.0, 2.0, 0.3):
        rows = sorted((-r.n, r.g, r.df) for r in want.collect() if r.df >= (least if least >= 1 else least * len(TEXTS)))
        terms, found, texts = G.vocabulary(df, "t", least, 12)
        assert texts == len(TEXTS) and sorted(zip(terms, found)) == sorted((g, d) for _, g, d in rows[:12])


@pytest.mark.parametrize("classifier", ["naive_bayes", "linear_svm"])
def test_a_fit_writes_no_ngrams(spark, classifier, monkeypatch):
    names, real = [], ML.materialize
    monkeypatch.setattr(ML, "materialize", lambda df, name: names.append((name, df.columns)) or real(df, name))
    rows = [(i, "good fine" if i % 2 else "bad poor", "p" if i % 2 else "n") for i in range(20)]
    ML.train_sentiment(spark.createDataFrame(rows, "k long, t string, l string"), "k", "t", "l", classifier=classifier)
    assert names and not any("_vm_grams" in columns or "_vm_tf" in columns for _, columns in names)


def test_margins_of_rows_without_entries():
    w = np.array([[1.0, 2.0, 4.0, 0.5]])
    got = margins(np.array([0, 0, 2, 2, 3, 3]), np.array([0, 2, 1]), np.array([1.0, 1.0, 3.0]), w)
    assert got[:, 0].tolist() == [0.5, 5.5, 0.5, 6.5, 0.5]


def test_few_codes_and_few_counts_at_a_time(spark, monkeypatch):
    texts = ["ab abc \U0001f600x", "\U0001f600x\x00 ab", "", "q\U00020000q ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    want = G.vocabulary(df, "t", 1.0, 1000)
    assert want[2] == 4 and dict(zip(want[0], want[1]))[" ab"] == 3 and dict(zip(want[0], want[1]))["x\x00 "] == 1
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])]
    for codes, known, size in ((8, 1 << 20, 1), (3, 1 << 20, 1), (0xFFFF, 3, 1), (0xFFFF, 1 << 20, 1 << 20)):
        monkeypatch.setattr(G, "CODES", codes)
        monkeypatch.setattr(G, "KNOWN", known)
        monkeypatch.setattr(G, "CHUNK_BYTES", size)
        got = {}
        for b in G._count(batches):
            for r in b.to_pylist():
                n, df_ = got.get(r["gram"], (0, 0))
                got[r["gram"]] = n + r["n"], df_ + r["df"]
        assert got.pop(None) == (4, 4) and {g: v[1] for g, v in got.items()} == dict(zip(want[0], want[1]))
        cutter = G.Cutter(want[0])
        assert [sorted(cutter.cut([w])[0].tolist()) for w in ("ab", "zab", "")] == [
            sorted(want[0].index(g) for g in G.windows(w) if w and g in want[0]) for w in ("ab", "zab", "")]


def test_linear_models_score_texts_as_their_vectors(spark):
    df = spark.createDataFrame([(i, t, float(i % 2)) for i, t in enumerate(TEXTS)], "k int, t string, y double")
    feats = ML.fit_tfidf(df, "t")
    models = ML.fit_text_classifiers(["linear_svm", "naive_bayes", "logistic_regression"], df, "t", F.col("y"), feats, 2)
    vectors = ML.tfidf_features(df.withColumn("label_idx", F.col("y")), feats, "t")
    for name, model in zip(("linear_svm", "naive_bayes", "logistic_regression"), models):
        alone = ML.fit_classifier(name, vectors, 2)
        if name != "naive_bayes":
            assert np.allclose(alone.weights, model.weights, atol=1e-3)
            got = {r.k: r.margins for r in ML.TextModel(feats, model).transform(df, "t").collect()}
            assert all(np.allclose(r.margins, got[r.k], rtol=1e-12) for r in model.transform(vectors).collect()) and len(got) == len(TEXTS)
        want = {r.k: r.prediction for r in model.transform(vectors).collect()}
        assert {r.k: r.prediction for r in ML.TextModel(feats, model).transform(df, "t").collect()} == want
