"""Features, splits and classifiers with Spark ML.

Splits are hash based and exact: a row's fate depends only on its key and the seed, never on
partitioning, so a rerun (or a task retry after an executor loss) assigns the same rows.

Stratified split (L2) ranks rows by hash *within* a label without sorting a whole label in
one task: rows are bucketed by the high bits of the hash (65 536 buckets per label), bucket
sizes are counted, cumulative offsets come from a window over that small count table, and a
row's rank is offset + its rank inside its bucket. A label holding a third of all rows is thus
spread over 65 536 sort groups.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions import text as X
from ..session import materialize
from . import metrics as M
from . import ngrams as G
from .linear import LinearModel, Rows, fit_linear, fit_rows

BUCKET_BITS = 16
CLASSIFIERS = ["naive_bayes", "logistic_regression", "linear_svm"]


# ---------------------------------------------------------------------------
# hashing and splits
# ---------------------------------------------------------------------------
def key_hash(key, seed: int = 42) -> Column:
    """Deterministic 32-bit hash of a key of any type: the head of the MD5 of its text and the seed, which any SQL
    engine can compute."""
    text = F.concat(X.col_(key).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def holdout_split(df: DataFrame, key: str, frac: float = 0.1, seed: int = 42,
                  out: str = "split") -> DataFrame:
    """``validation`` for a ``frac`` share of hash space, else ``train`` (no join needed)."""
    cut = int(round(frac * 10000))
    val = F.pmod(key_hash(key, seed), F.lit(10000)) < cut
    return df.withColumn(out, F.when(val, "validation").otherwise("train"))


def stratified_split(df: DataFrame, key: str, label: str, test_frac: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """L2: exact per-label test counts, rows chosen by hash order within each label.

    Test size is ceil(frac * N); each label gets floor(frac * n_label) and the remaining rows go
    to the labels with the largest fractional parts (ties by label).
    """
    h = key_hash(key, seed)
    base = df.withColumn("_vm_h", h).withColumn("_vm_b", F.shiftright("_vm_h", 32 - BUCKET_BITS))
    counts = base.groupBy(label, "_vm_b").agg(F.count("*").alias("_vm_bn"))
    w_cum = Window.partitionBy(label).orderBy("_vm_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_vm_off", F.coalesce(F.sum("_vm_bn").over(w_cum), F.lit(0))).drop("_vm_bn")

    per_label = counts.groupBy(label).agg(F.sum("_vm_bn").alias("_vm_n"))
    total = per_label.agg(F.sum("_vm_n").alias("_vm_tot"))
    quota = (per_label.withColumn("_vm_tot", total.select("_vm_tot").scalar())
             .withColumn("_vm_exact", F.col("_vm_n") * F.lit(test_frac))
             .withColumn("_vm_floor", F.floor("_vm_exact"))
             .withColumn("_vm_target", F.ceil(F.col("_vm_tot") * F.lit(test_frac))))
    # the two windows below run over the |labels|-row quota table only
    w_rem = Window.orderBy(F.desc(F.col("_vm_exact") - F.col("_vm_floor")), F.asc(label))
    quota = (quota.withColumn("_vm_rank", F.row_number().over(w_rem))
             .withColumn("_vm_left", F.col("_vm_target") - F.sum("_vm_floor").over(Window.partitionBy()))
             .withColumn("_vm_quota", F.col("_vm_floor") + F.when(F.col("_vm_rank") <= F.col("_vm_left"), 1).otherwise(0))
             .select(label, "_vm_quota"))

    w_in = Window.partitionBy(label, "_vm_b").orderBy("_vm_h", key)
    ranked = base.withColumn("_vm_rn", F.row_number().over(w_in))
    # offsets have at most |labels| x 65536 rows, quota |labels|; labels may be any column, so the planner decides
    ranked = ranked.join(offsets, [label, "_vm_b"]).join(quota, label)
    is_test = F.col("_vm_off") + F.col("_vm_rn") <= F.col("_vm_quota")
    return ranked.withColumn(out, F.when(is_test, "test").otherwise("train")).drop(
        "_vm_h", "_vm_b", "_vm_off", "_vm_rn", "_vm_quota")


def prepare_polarity(df: DataFrame, text: str, label: str, key: str, frac: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """(key, text, label 0/1, split) with a hash holdout of ``frac``."""
    out = df.select(key, F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    return holdout_split(out, key, frac, seed)


# ---------------------------------------------------------------------------
# features (L1)
# ---------------------------------------------------------------------------
def fit_tfidf(train: DataFrame, text: str = "text", min_df: float = 2.0, max_features: int = 50000) -> PipelineModel:
    """char_wb 2-4 grams -> counts (min_df, top max_features by corpus frequency) -> smoothed IDF
    ln((1+n)/(1+df)) + 1 -> L2 normalisation.

    One pass over the training text. The fitted values are kept as Spark ML stages, whose folder any Spark job can load;
    texts are turned into vectors by ``tfidf_features``.
    """
    terms, df, n = G.vocabulary(train, text, min_df, max_features)
    cv_model = CountVectorizerModel.from_vocabulary(terms, inputCol="_vm_grams", outputCol="_vm_tf")
    weights = Vectors.dense([math.log((1.0 + n) / (1.0 + k)) + 1.0 for k in df])
    scale = ElementwiseProduct(scalingVec=weights, inputCol="_vm_tf", outputCol="_vm_tfidf")
    norm = Normalizer(inputCol="_vm_tfidf", outputCol="features", p=2.0)
    return PipelineModel(stages=[cv_model, scale, norm])


def tfidf_pipeline_model(train: DataFrame, text: str = "text", min_df: float = 2.0,
                         max_features: int = 50000) -> PipelineModel:
    return fit_tfidf(train, text, min_df, max_features)


def tfidf_features(df: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """Adds ``features``: what the model's stages make of the n-grams of ``text``, made from its words."""
    counts, scale = model.stages[:2]
    return df.withColumn("features", G.vectors(df, text, counts.vocabulary, scale.getScalingVec().toArray()))


# ---------------------------------------------------------------------------
# classifiers
# ---------------------------------------------------------------------------
#: Largest gradient component of the mean loss at which a fit stops, and steps at most.
STOP = {"logistic_regression": (1e-4, 2000), "linear_svm": (1e-5, 1000)}


def fit_classifier(name: str, train: DataFrame, n_classes: int):
    """A classifier with the reference's settings (C = 1, smoothing 1) on (features, label_idx)."""
    if name == "naive_bayes":
        return NaiveBayes(modelType="multinomial", smoothing=1.0, featuresCol="features", labelCol="label_idx").fit(train)
    if name in STOP:
        tol, steps = STOP[name]
        return fit_linear(train, name, n_classes, tol=tol, max_iter=steps)
    raise ValueError(f"Unknown classifier: {name}")


def fit_text_classifiers(names: list[str], train: DataFrame, text: str, index: Column, features: PipelineModel, n_classes: int) -> list:
    """``fit_classifier`` of several classifiers on the vectors of texts; ``index`` is the label's place. The linear ones read the same
    blocks, written once, at the same time."""
    linear = [name for name in names if name in STOP]
    models = {name: fit_classifier(name, tfidf_features(train.withColumn("label_idx", index), features, text), n_classes)
              for name in names if name not in linear}
    if linear:
        counts, scale = features.stages[:2]
        weights = scale.getScalingVec().toArray()
        rows = Rows(materialize(G.blocks(train, text, index, counts.vocabulary, weights), "training-blocks"), len(weights), weights)

        def fitted(name: str) -> LinearModel:
            tol, steps = STOP[name]
            return fit_rows(rows, name, n_classes, tol=tol, max_iter=steps)
        models |= dict(zip(linear, together(linear, fitted)))
        rows.release()
    return [models[name] for name in names]


def with_margins(df: DataFrame, text: str, features: PipelineModel, models: list) -> DataFrame:
    """Adds ``_vm_margins``, beside each linear model the margins of a text's vector, which is made once and stays in its task."""
    linear = [m for m in models if isinstance(m, LinearModel)]
    if not linear:
        return df
    counts, scale = features.stages[:2]
    made = G.scores(df, text, counts.vocabulary, scale.getScalingVec().toArray(),
                    lambda *vectors: np.concatenate([m.margins(*vectors) for m in linear], 1))
    own, start = [], 1
    for m in models:
        width = max(len(m.weights), 2) if isinstance(m, LinearModel) else 0
        own.append(F.slice("_vm_flat", start, width) if width else F.lit(None).cast("array<double>"))
        start += width
    return df.withColumn("_vm_flat", made).withColumn("_vm_margins", F.array(*own)).drop("_vm_flat")


def together(items: list, f: Callable) -> list:
    """``f`` of each item, at the same time: steps of few rows leave most cores waiting for the driver."""
    if len(items) == 1:
        return [f(items[0])]
    with ThreadPoolExecutor(len(items)) as pool:
        return list(pool.map(f, items))


@dataclass
class Benchmark:
    """What the classifiers of one data set did: the confusion counts (classifier, truth, pred, n), written once."""

    counts: DataFrame
    classifiers: list[str]
    labels: list[str]
    sizes: dict[str, int]

    def per_class(self) -> DataFrame:
        """(classifier, label, precision, recall, f1, support) of all classifiers in one aggregation."""
        stats = M.label_stats(self.counts, ["classifier"], self.labels)
        return stats.select("classifier", "label", "precision", "recall", "f1", "support")

    def summary(self) -> DataFrame:
        """One row a classifier: accuracy, macro and weighted F1, F1 of the three labels, sizes, labels, rank by macro F1 (ties keep
        the order asked for), best, baseline."""
        stats = M.label_stats(self.counts, ["classifier"], None)
        summ = M.summary_from_stats(stats, self.counts, ["classifier"])
        f1 = stats.groupBy("classifier").agg(*[F.max(F.when(F.col("label") == c, F.col("f1"))).alias(c) for c in FV.LABELS])
        order = F.array(*[F.lit(c) for c in self.classifiers])
        j = summ.join(f1, "classifier").withColumn("_pos", F.array_position(order, F.col("classifier")))
        w = Window.orderBy(F.desc("macro_f1"), F.asc("_pos"))      # over the few classifiers
        j = j.withColumn("rank", F.row_number().over(w))
        baseline = (F.col("classifier") == "naive_bayes") if "naive_bayes" in self.classifiers else F.col("rank") == len(self.classifiers)
        return j.select(
            F.col("classifier").alias("name"), "accuracy", "macro_f1", "weighted_f1",
            *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"{c.lower()}_f1") for c in FV.LABELS],
            "rank", (F.col("rank") == 1).alias("best"), baseline.alias("baseline"),
            *[F.lit(self.sizes[s]).cast("long").alias(f"{s}_size") for s in ("dataset", "train", "test")],
            F.array(*[F.lit(x) for x in self.labels]).alias("labels"))

    def report(self, classifier: str | None = None) -> DataFrame:
        """A8 of one classifier, by default of the best one."""
        name = F.lit(classifier) if classifier else self.summary().filter("best").select("name").scalar()
        own = self.counts.filter(F.col("classifier") == name).groupBy("truth", "pred").agg(F.sum("n").alias("n"))
        return M.report_of(own)


def run_benchmark(df: DataFrame, key: str, text: str, label: str, classifiers: list[str] | None = None, test_frac: float = 0.2,
                  seed: int = 42) -> Benchmark:
    """One stratified split; features and every classifier fitted on the training part; all predictions of the test part
    counted in one pass."""
    classifiers = classifiers or CLASSIFIERS
    for c in classifiers:
        if c not in CLASSIFIERS:
            raise ValueError(f"Unknown classifier: {c}")
    clean = df.select(key, text, F.col(label).cast("string").alias("label")).dropna(subset=[text, "label"])
    clean = materialize(clean.select(key, "label", F.col(text).alias("_vm_text")), "benchmark-texts")
    marked = materialize(stratified_split(clean.select(key, "label"), key, "label", test_frac, seed), "benchmark-split")
    split = clean.join(marked.drop("label"), key)
    sizes = {r["split"]: r["n"] for r in marked.groupBy("split").agg(F.count("*").alias("n")).collect()}
    sizes = {"dataset": sum(sizes.values()), "train": sizes.get("train", 0), "test": sizes.get("test", 0)}
    labels = sorted(r["label"] for r in marked.select("label").distinct().collect())
    index = (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1).cast("double")
    train = split.filter(F.col("split") == "train")
    feats = fit_tfidf(train, "_vm_text")
    models = fit_text_classifiers(classifiers, train, "_vm_text", index, feats, len(labels))
    pred = with_margins(split.filter(F.col("split") == "test").select("label", "_vm_text"), "_vm_text", feats, models)
    for i, model in enumerate(models):
        cols = pred.columns
        if isinstance(model, LinearModel):
            scored = model.decided(pred.withColumn("margins", F.col("_vm_margins")[i]))
        else:
            scored = TextModel(feats, model).transform(pred, "_vm_text")
        pred = scored.select(*cols, F.col("prediction").alias(f"_p{i}"))
    names = F.array(*[F.lit(x) for x in labels])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("classifier"), F.element_at(names, F.col(f"_p{i}").cast("int") + 1).alias("pred"))
                               for i, c in enumerate(classifiers)]))
    counted = pred.select(F.col("label").alias("truth"), each.alias("_c")).groupBy("_c.classifier", "truth", "_c.pred").agg(F.count("*").alias("n"))
    return Benchmark(materialize(counted, "benchmark-counts"), classifiers, labels, sizes)


def benchmark_classifiers(df: DataFrame, key: str, text: str, label: str, classifiers: list[str] | None = None,
                          test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """L7 as one row per classifier (see ``Benchmark.summary``)."""
    return run_benchmark(df, key, text, label, classifiers, test_frac, seed).summary()


def benchmark_suite(datasets: dict[str, tuple[DataFrame, str, str, str]],
                    classifiers: list[str] | None = None) -> DataFrame:
    """{name: (df, key, text, label)} -> union of L7 results tagged with ``dataset``."""
    return _tagged(datasets, lambda d: benchmark_classifiers(*d, classifiers))


def _tagged(datasets: dict[str, tuple[DataFrame, str, str, str]], f: Callable) -> DataFrame:
    out = None
    for name, r in zip(datasets, together(list(datasets.values()), f)):
        r = r.withColumn("dataset", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def suite_per_class(datasets: dict[str, tuple[DataFrame, str, str, str]], classifiers: list[str] | None = None) -> DataFrame:
    """L8's per-class rows (dataset, classifier, label, precision, recall, f1, support)."""
    return _tagged(datasets, lambda d: run_benchmark(*d, classifiers).per_class())


# ---------------------------------------------------------------------------
# training and scoring
# ---------------------------------------------------------------------------
#: Of the folder that ``save_sentiment`` writes.
MODEL_FORMAT = 2


class TextModel:
    """TF-IDF features of a text column and a classifier of them."""

    def __init__(self, features: PipelineModel, classifier):
        self.features, self.classifier = features, classifier

    def transform(self, df: DataFrame, text: str) -> DataFrame:
        if isinstance(self.classifier, LinearModel):
            scored = with_margins(df, text, self.features, [self.classifier])
            return self.classifier.decided(scored.withColumn("margins", F.col("_vm_margins")[0])).drop("_vm_margins")
        return self.classifier.transform(tfidf_features(df, self.features, text))

    def predict(self, df: DataFrame, text: str, labels: list[str], out: str = "pred_label") -> DataFrame:
        cols = df.columns
        scored = self.transform(df, text)
        names = F.array(*[F.lit(x) for x in labels])
        return scored.select(*cols, F.element_at(names, F.col("prediction").cast("int") + 1).alias(out))


def train_sentiment(df: DataFrame, key: str, text: str, label: str, path: str | None = None,
                    val_frac: float = 0.1, seed: int = 42, classifier: str = "logistic_regression",
                    validation: DataFrame | None = None, dataset: str = "custom"):
    """Fit TF-IDF + classifier, evaluate weighted metrics on the ``validation`` table (same columns) or, without one, on
    a hash holdout of ``val_frac``, and save model and run record under ``path``. Returns (model, labels, metrics_df)."""
    def clean(d):
        return d.select(key, F.col(text).alias("text"), F.col(label).cast("string").alias("label")).dropna(subset=["text", "label"])
    if validation is None:
        split = holdout_split(clean(df), key, val_frac, seed)
        train, val = split.filter(F.col("split") == "train"), split.filter(F.col("split") == "validation")
    else:
        train, val = clean(df), clean(validation)
    train = materialize(train.select("label", "text"), "training-texts")
    per_label = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(per_label)
    index = (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1).cast("double")
    feats = fit_tfidf(train)
    model = TextModel(feats, fit_text_classifiers([classifier], train, "text", index, feats, len(labels))[0])
    # the few counts of the validation part are kept: the metrics and the record read them
    counts = M.confusion_counts(model.predict(val, "text", labels), "label", "pred_label")
    summary = M.summary_from_stats(M.label_stats(counts, None, None), counts)
    metrics = summary.select("accuracy", "weighted_precision", "weighted_recall", "weighted_f1")
    if path:
        settings = {"val_frac": None if validation is not None else val_frac, "seed": seed}
        save_sentiment(model, labels, path, classifier, dataset, per_label, summary, settings)
    return model, labels, metrics


def save_sentiment(model: TextModel, labels: list[str], path: str, classifier: str, dataset: str, per_label: dict[str, int],
                   summary: DataFrame, settings: dict) -> None:
    """Model folders and, last, the run record: format, base, dataset, labels, sizes, settings, metrics, fit."""
    spark = summary.sparkSession
    model.features.write().overwrite().save(f"{path}/features")
    if isinstance(model.classifier, LinearModel):
        model.classifier.save(spark, f"{path}/classifier")
        fit = {"steps": model.classifier.steps, "converged": model.classifier.converged}
    else:
        model.classifier.write().overwrite().save(f"{path}/classifier")
        fit = {}
    record = summary.select(
        F.lit(MODEL_FORMAT).alias("format"), F.lit(classifier).alias("base"), F.lit(dataset).alias("dataset"),
        F.array(*[F.lit(x) for x in labels]).alias("labels"), F.lit(sum(per_label.values())).alias("n_train"),
        F.col("n").cast("long").alias("n_validation"), F.lit(json.dumps(per_label, sort_keys=True)).alias("train_labels"),
        F.lit(json.dumps(settings)).alias("settings"), F.lit(json.dumps(fit)).alias("fit"),
        F.struct("accuracy", "weighted_precision", "weighted_recall", "weighted_f1", "macro_f1").alias("metrics"),
        F.lit(path).alias("model_path"))
    record.write.mode("overwrite").json(f"{path}/run")


RUN_RECORD = ("format int, base string, dataset string, labels array<string>, n_train long, n_validation long, train_labels string, "
              "settings string, fit string, metrics struct<accuracy:double,weighted_precision:double,weighted_recall:double,"
              "weighted_f1:double,macro_f1:double>, model_path string")


def load_sentiment(spark: SparkSession, path: str):
    """(model, labels, run record) of a folder that ``train_sentiment`` wrote."""
    record = spark.read.schema(RUN_RECORD).json(f"{path}/run").first()
    if record is None or record["format"] != MODEL_FORMAT:
        raise ValueError(f"{path}: no model of format {MODEL_FORMAT}")
    if record["base"] == "naive_bayes":
        classifier = NaiveBayesModel.load(f"{path}/classifier")
    else:
        classifier = LinearModel.load(spark, f"{path}/classifier")
    return TextModel(PipelineModel.load(f"{path}/features"), classifier), list(record["labels"]), record


class TextModelScorer:
    """Score a text column with a model from :func:`train_sentiment`: label, probabilities per label, raw scores (margins, or
    log likelihoods for naive Bayes)."""

    def __init__(self, model: TextModel, labels: list[str]):
        self.model, self.labels = model, labels

    def score(self, df: DataFrame, text_col: str, out: str = "sentiment") -> DataFrame:
        from .score import from_probs
        cols = df.columns
        scored = self.model.transform(df, text_col)
        if "margins" not in scored.columns:
            scored = scored.withColumns({"probabilities": vector_to_array("probability"), "margins": vector_to_array("rawPrediction")})
        return scored.select(*cols, from_probs(F.col("probabilities"), F.col("margins"), self.labels).alias(out))
