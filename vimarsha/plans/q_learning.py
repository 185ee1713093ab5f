"""Plans for splits, learning operators (L1-L10, T11), language ID (T3) and CSV files on documents joined with labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..operators import ml as ML
from . import sqlfrag as S
from .catalog import register, table
from .views import docs

_H = "('0x' || substr(md5(doc_id::VARCHAR || ':42'), 1, 8))::BIGINT"
_POLARITY = "CASE WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END"


def _wb(n_min, n_max):
    from .q_text import _wb_sql
    return _wb_sql("text", n_min, n_max)


def labelled(spark, sf, label_expr: str = _POLARITY):
    d = docs(spark, sf, ("doc_id", "text"))
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id").select("doc_id", "text", F.expr(label_expr).alias("label"))


# --------------------------------------------------------------------------- L3 / J5
@register("holdout_split", f"""
SELECT doc_id, CASE WHEN {_H} % 10000 < 1000 THEN 'validation' ELSE 'train' END AS split FROM documents""")
def q_holdout_split(spark, sf):
    return ML.holdout_split(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.1, 42)


# --------------------------------------------------------------------------- L10
@register("prepare_polarity", f"""
SELECT d.doc_id, d.text, l.quality::INTEGER AS label,
       CASE WHEN {_H.replace('doc_id', 'd.doc_id')} % 10000 < 1000 THEN 'validation' ELSE 'train' END AS split
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_prepare_polarity(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return ML.prepare_polarity(d, "text", "quality", "doc_id", 0.1, 42)


# --------------------------------------------------------------------------- L2
@register("stratified_split", f"""
WITH x AS (SELECT d.doc_id, {_POLARITY} AS label, {_H.replace('doc_id', 'd.doc_id')} AS h
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
pl AS (SELECT label, count(*) AS n FROM x GROUP BY label),
tot AS (SELECT sum(n) AS t FROM pl),
q AS (SELECT label, floor(n * 0.2::DOUBLE) AS fl, n * 0.2::DOUBLE - floor(n * 0.2::DOUBLE) AS fr,
             ceil(t * 0.2::DOUBLE) AS target FROM pl, tot),
q2 AS (SELECT *, row_number() OVER (ORDER BY fr DESC, label) AS rk, target - sum(fl) OVER () AS lft FROM q),
q3 AS (SELECT label, fl + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS quota FROM q2),
r AS (SELECT x.*, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) AS rn FROM x)
SELECT doc_id, label, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN q3 USING (label)""")
def q_stratified_split(spark, sf):
    return ML.stratified_split(labelled(spark, sf).drop("text"), "doc_id", "label", 0.2, 42)


# --------------------------------------------------------------------------- L1
_LAB_SQL = f"lab AS (SELECT doc_id, text, {_POLARITY} AS label FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)"


def _terms(fitted: str) -> str:
    """Term counts of ``lab`` and the vocabulary of the rows that the features are fitted on."""
    return f"""{_LAB_SQL},
tf AS (SELECT doc_id, gram, count(*) AS k FROM (SELECT doc_id, unnest({_wb(2, 4)}) AS gram FROM lab) GROUP BY ALL),
vocab AS (SELECT gram, count(*) AS df FROM tf WHERE doc_id IN (SELECT doc_id FROM {fitted}) GROUP BY 1 HAVING count(*) >= 2
  ORDER BY sum(k) DESC LIMIT 50000)"""


@register("tfidf_features", f"""
WITH {_terms('lab')},
w AS (SELECT tf.doc_id, tf.k * (ln((1.0::DOUBLE + (SELECT count(*) FROM lab)) / (1.0::DOUBLE + v.df)) + 1.0::DOUBLE) AS x FROM tf JOIN vocab v USING (gram)),
n AS (SELECT doc_id, count(*) AS nnz, sum(x * x) AS sq FROM w GROUP BY 1)
SELECT doc_id, coalesce(nnz, 0)::INTEGER AS nnz, CASE WHEN nnz > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS sq_norm FROM lab LEFT JOIN n USING (doc_id)""")
def q_tfidf_features(spark, sf):
    lab = labelled(spark, sf)
    model = ML.tfidf_pipeline_model(lab, "text")
    f = ML.tfidf_features(lab, model, "text")
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("features")
    return f.select("doc_id", F.size(F.filter(arr, lambda v: v != 0)).alias("nnz"),
                    F.round(F.aggregate(arr, F.lit(0.0), lambda a, v: a + v * v), 6).alias("sq_norm"))


# --------------------------------------------------------------------------- L4-L8
def _split_sql(rows: str) -> str:
    """CTE ``part`` (doc_id, label, split): the stratified split of ``rows`` (doc_id, label)."""
    return f"""hx AS (SELECT doc_id, label, {_H} AS h FROM {rows}),
pl AS (SELECT label, count(*) AS n FROM hx GROUP BY label), tot AS (SELECT sum(n) AS t FROM pl),
q1 AS (SELECT label, floor(n * 0.2::DOUBLE) AS fl, n * 0.2::DOUBLE - floor(n * 0.2::DOUBLE) AS fr, ceil(t * 0.2::DOUBLE) AS target FROM pl, tot),
q2 AS (SELECT *, row_number() OVER (ORDER BY fr DESC, label) AS rk, target - sum(fl) OVER () AS lft FROM q1),
q3 AS (SELECT label, fl + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS quota FROM q2),
rr AS (SELECT hx.*, row_number() OVER (PARTITION BY label ORDER BY h, doc_id) AS rn FROM hx),
part AS (SELECT doc_id, label, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM rr JOIN q3 USING (label))"""


#: Multinomial naive Bayes on normalised TF-IDF, smoothing 1 on terms and on the labels' shares.
_NB_SQL = f"""{_split_sql('(SELECT doc_id, ' + _POLARITY + ' AS label FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)')},
train AS (SELECT * FROM part WHERE split = 'train'), {_terms('train')},
x0 AS (SELECT tf.doc_id, gram, tf.k * (ln((1.0::DOUBLE + (SELECT count(*) FROM train)) / (1.0::DOUBLE + v.df)) + 1.0::DOUBLE) AS x FROM tf JOIN vocab v USING (gram)),
x1 AS (SELECT doc_id, gram, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM x0),
mass AS (SELECT label, gram, sum(x) AS m FROM x1 JOIN train USING (doc_id) GROUP BY ALL),
den AS (SELECT label, ln(sum(m) + (SELECT count(*) FROM vocab)) AS den FROM mass GROUP BY 1),
pri AS (SELECT label, ln(count(*) + 1.0::DOUBLE) - ln((SELECT count(*) FROM train) + (SELECT count(DISTINCT label) FROM train)) AS pi FROM train GROUP BY 1),
held AS (SELECT doc_id, label FROM part WHERE split = 'test'),
own AS (SELECT doc_id, sum(x) AS s FROM x1 GROUP BY 1),
hit AS (SELECT x1.doc_id, mass.label, sum(x1.x * ln(m + 1.0::DOUBLE)) AS s FROM x1 JOIN held USING (doc_id) JOIN mass USING (gram) GROUP BY ALL),
score AS (SELECT held.doc_id, pri.label, pri.pi + coalesce(hit.s, 0) - coalesce(own.s, 0) * den.den AS s FROM held CROSS JOIN pri JOIN den ON den.label = pri.label
  LEFT JOIN own ON own.doc_id = held.doc_id LEFT JOIN hit ON hit.doc_id = held.doc_id AND hit.label = pri.label),
pred AS (SELECT doc_id, arg_max(label, s) AS pred FROM score GROUP BY 1),
res AS (SELECT held.label AS truth, pred FROM held JOIN pred USING (doc_id)),
cls AS (SELECT l, count(*) FILTER (truth = l AND pred = l) AS tp, count(*) FILTER (truth <> l AND pred = l) AS fp, count(*) FILTER (truth = l AND pred <> l) AS fn
  FROM res, (SELECT DISTINCT label AS l FROM part) GROUP BY l),
f1 AS (SELECT l, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS n FROM cls WHERE tp + fp + fn > 0)"""


def _flat(benchmark):
    return benchmark.withColumn("labels", F.array_join("labels", ", ")).select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in benchmark.dtypes if c != "labels"], "labels")


@register("bench_nb", f"""
WITH {_NB_SQL}
SELECT 'naive_bayes' AS name, (SELECT round(count(*) FILTER (truth = pred)::DOUBLE / count(*), 6) FROM res) AS accuracy,
  (SELECT round(avg(f1), 6) FROM f1) AS macro_f1, (SELECT round(sum(f1 * n) / sum(n), 6) FROM f1) AS weighted_f1,
  round(coalesce((SELECT f1 FROM f1 WHERE l = 'Positive'), 0.0), 6) AS positive_f1, round(coalesce((SELECT f1 FROM f1 WHERE l = 'Negative'), 0.0), 6) AS negative_f1,
  0.0::DOUBLE AS neutral_f1, 1 AS rank, true AS best, true AS baseline, (SELECT count(*) FROM part) AS dataset_size,
  (SELECT count(*) FROM train) AS train_size, (SELECT count(*) FROM held) AS test_size, 'Negative, Positive' AS labels""")
def q_bench_nb(spark, sf):
    return _flat(ML.benchmark_classifiers(labelled(spark, sf), "doc_id", "text", "label", ["naive_bayes"]))


@register("bench_lr")
def q_bench_lr(spark, sf):
    return _flat(ML.benchmark_classifiers(labelled(spark, sf), "doc_id", "text", "label", ["logistic_regression"]))


@register("bench_svm")
def q_bench_svm(spark, sf):
    return _flat(ML.benchmark_classifiers(labelled(spark, sf), "doc_id", "text", "label", ["linear_svm"]))


@register("classifier_benchmark")
def q_classifier_benchmark(spark, sf):
    return _flat(ML.benchmark_classifiers(labelled(spark, sf), "doc_id", "text", "label"))


@register("benchmark_suite")
def q_benchmark_suite(spark, sf):
    return _flat(ML.benchmark_suite(_suite(spark, sf)))


def _suite(spark, sf):
    tox = "CASE WHEN toxic = 1 THEN 'Negative' ELSE 'Positive' END"
    return {"documents_quality": (labelled(spark, sf), "doc_id", "text", "label"),
            "documents_toxicity": (labelled(spark, sf, tox), "doc_id", "text", "label")}


@register("benchmark_per_class")
def q_benchmark_per_class(spark, sf):
    """Per-class rows of all classifiers on both label sets."""
    return ML.suite_per_class(_suite(spark, sf))


@register("benchmark_sizes", """
WITH x AS (SELECT 'documents_quality' AS dataset, quality::VARCHAR AS label FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL
  UNION ALL SELECT 'documents_toxicity', toxic::VARCHAR FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL),
n AS (SELECT dataset, count(*) AS n FROM x GROUP BY 1)
SELECT dataset, 'naive_bayes' AS name, n AS dataset_size, n - ceil(n * 0.2::DOUBLE)::BIGINT AS train_size,
  ceil(n * 0.2::DOUBLE)::BIGINT AS test_size, 'Negative, Positive' AS labels, 1 AS rank, true AS best, true AS baseline FROM n""")
def q_benchmark_sizes(spark, sf):
    out = ML.benchmark_suite(_suite(spark, sf), ["naive_bayes"])
    return out.select("dataset", "name", "dataset_size", "train_size", "test_size", F.array_join("labels", ", ").alias("labels"), "rank", "best", "baseline")


@register("benchmark_report")
def q_benchmark_report(spark, sf):
    """The classification report of the best of the three classifiers."""
    return ML.run_benchmark(labelled(spark, sf), "doc_id", "text", "label").report()


# --------------------------------------------------------------------------- L9 / T11
@register("train_reload_score", "SELECT doc_id, true AS same_label, true AS same_confidence, true AS same_raw_scores FROM documents")
def q_train_reload_score(spark, sf):
    """Trained on one table, validated on another, saved, loaded again: the loaded model scores every document as the first."""
    import uuid

    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex[:10]}"
    parts = ML.holdout_split(labelled(spark, sf), "doc_id", 0.2, 7)
    model, labels, _ = ML.train_sentiment(parts.filter("split = 'train'"), "doc_id", "text", "label", path,
                                          validation=parts.filter("split = 'validation'"), dataset="documents")
    loaded, names, _record = ML.load_sentiment(spark, path)
    first = ML.TextModelScorer(model, labels).score(docs(spark, sf), "text", "a")
    both = ML.TextModelScorer(loaded, names).score(first, "text", "b")
    return both.select("doc_id", (F.col("a.label") == F.col("b.label")).alias("same_label"),
                       (F.col("a.confidence") == F.col("b.confidence")).alias("same_confidence"),
                       (F.col("a.raw_scores") == F.col("b.raw_scores")).alias("same_raw_scores"))


@register("train_sentiment")
def q_train_sentiment(spark, sf):
    _model, _labels, metrics = ML.train_sentiment(labelled(spark, sf), "doc_id", "text", "label")
    return metrics


@register("score_svm")
def q_score_svm(spark, sf):
    """T11 with a model that has margins instead of probabilities."""
    model, labels, _ = ML.train_sentiment(labelled(spark, sf), "doc_id", "text", "label", classifier="linear_svm")
    s = ML.TextModelScorer(model, labels).score(docs(spark, sf), "text")
    return s.select("doc_id", F.col("sentiment.label").alias("label"),
                    F.round("sentiment.confidence", 6).alias("confidence"))


@register("score_sentiment")
def q_score_sentiment(spark, sf):
    model, labels, _ = ML.train_sentiment(labelled(spark, sf), "doc_id", "text", "label")
    scorer = ML.TextModelScorer(model, labels)
    s = scorer.score(docs(spark, sf), "text")
    return s.select("doc_id", F.col("sentiment.label").alias("label"),
                    F.round("sentiment.confidence", 6).alias("confidence"))


# --------------------------------------------------------------------------- T3 language-ID signal
@register("langid_profile", f"""
WITH g AS (SELECT lang, unnest({_wb(1, 3)}) AS gram FROM documents WHERE lang IS NOT NULL)
SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL""")
def q_langid_profile(spark, sf):
    from ..operators.langid import ngram_counts
    return ngram_counts(docs(spark, sf, ("doc_id", "text", "lang")), "text", "lang", 1, 3)


def _langid_scored(spark, sf):
    from ..operators.langid import fit_langid, langid_scores
    d = docs(spark, sf, ("doc_id", "text", "lang"))
    train = ML.holdout_split(d, "doc_id", 0.2, 7).filter("split = 'train'")
    model = fit_langid(train, "text", "lang")
    return langid_scores(d, "doc_id", model, "text")


_H7 = _H.replace(":42", ":7")
_LANGID_SQL = f"""train AS (SELECT doc_id, lang, text FROM documents WHERE {_H7} % 10000 >= 2000 AND lang IS NOT NULL),
c AS (SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest({_wb(1, 3)}) AS gram FROM train) GROUP BY ALL),
den AS (SELECT lang, ln(sum(n) + (SELECT count(DISTINCT gram) FROM c)) AS den FROM c GROUP BY lang),
prior AS (SELECT lang, ln(count(*)::DOUBLE / (SELECT count(*) FROM train)) AS prior FROM train GROUP BY lang),
q AS (SELECT doc_id, gram, count(*) AS k FROM (SELECT doc_id, unnest({_wb(1, 3)}) AS gram FROM documents) GROUP BY ALL),
total AS (SELECT doc_id, sum(k) AS n FROM q GROUP BY 1),
hit AS (SELECT q.doc_id, c.lang, sum(q.k * ln(c.n + 1.0::DOUBLE)) AS s FROM q JOIN c USING (gram) GROUP BY ALL),
sc AS (SELECT t.doc_id, d.lang, p.prior + coalesce(h.s, 0) - t.n * d.den AS s FROM total t CROSS JOIN den d JOIN prior p ON p.lang = d.lang
  LEFT JOIN hit h ON h.doc_id = t.doc_id AND h.lang = d.lang),
top AS (SELECT doc_id, max(s) AS m FROM sc GROUP BY 1),
langid AS (SELECT sc.doc_id, min(sc.lang) FILTER (sc.s = top.m) AS predicted, 1.0::DOUBLE / sum(exp(sc.s - top.m)) AS prob
  FROM sc JOIN top USING (doc_id) GROUP BY 1)"""


@register("langid_top", f"""
WITH {_LANGID_SQL}
SELECT d.doc_id, d.lang, l.predicted, round(l.prob, 6) AS prob FROM documents d LEFT JOIN langid l USING (doc_id)""")
def q_langid_top(spark, sf):
    s = _langid_scored(spark, sf)
    return s.select("doc_id", "lang", F.col("langid_lang").alias("predicted"),
                    F.round("langid_prob", 6).alias("prob"))


def _signalled(kt, et, mt):
    """The cascade of detection with a language-ID signal."""
    latin = f"english >= {mt}"
    return (f"CASE WHEN _blank THEN 'unknown' WHEN kannada >= {kt} THEN 'kannada_script' WHEN {latin} AND _hits >= 1 THEN 'romanized_kannada' "
            f"WHEN {latin} AND predicted = 'en' THEN 'english' WHEN {latin} AND english >= {et} AND kannada = 0 THEN 'english' "
            f"WHEN kannada >= {mt} OR english >= {mt} THEN 'mixed' ELSE 'unknown' END")


@register("detect_with_langid", f"""
WITH {_LANGID_SQL}, {S.detection_ctes('(SELECT doc_id, lang, text FROM documents)', 'doc_id', 'text')}
SELECT d.lang, {_signalled(*(f'{v}::DOUBLE' for v in (FV.KANNADA_THRESHOLD, FV.ENGLISH_THRESHOLD, FV.MIXED_THRESHOLD)))} AS language, count(*) AS n
FROM _d3 JOIN documents d USING (doc_id) LEFT JOIN langid l USING (doc_id) GROUP BY ALL""")
def q_detect_with_langid(spark, sf):
    from ..operators.detect import detect_language
    d = detect_language(_langid_scored(spark, sf), "text", langid=("langid_lang", "langid_prob"))
    return d.groupBy("lang", F.col("detection.language").alias("language")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- S4 + S6: per-split files merged back
@register("merge_splits", f"""
SELECT doc_id, source, text, CASE WHEN {_H} % 10000 < 1000 THEN 'validation' ELSE 'train' END AS _split
FROM documents""")
def q_merge_splits(spark, sf):
    """Write the documents as one JSON-lines folder per split (S6 writer), read them back tagged."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources.readers import merge_splits, write_report
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/splits-{uuid.uuid4().hex[:10]}"
    d = ML.holdout_split(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id", 0.1, 42)
    for split in ("train", "validation"):
        write_report(d.filter(F.col("split") == split).drop("split"), f"{root}/{split}")
    m = merge_splits(spark, {s: f"{root}/{s}" for s in ("train", "validation")}, "doc_id long, source string, text string")
    return m.select("doc_id", "source", "text", "_split")


# --------------------------------------------------------------------------- S1, S5, S9: CSV by header
_CSV_SCHEMA = "doc_id long, text string, n_chars long, lang string"


def _landed_csv(spark, sf, broken: bool):
    """The documents as CSV: columns in another order than the schema, one that it lacks; numbers spoilt where ``broken``."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.readers import write_csv
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex[:10]}"
    d = table(spark, sf, "documents")
    n = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("n/a "), F.col("n_chars").cast("string"))).otherwise(F.col("n_chars").cast("string"))
    write_csv(d.select("lang", "text", "source", (n if broken else F.col("n_chars")).alias("n_chars"), "doc_id"), path)
    return path


@register("csv_by_header", "SELECT doc_id, text, n_chars, lang FROM documents")
def q_csv_by_header(spark, sf):
    from pyspark.sql.types import StructType

    from ..sources.readers import read_reviews_csv
    return read_reviews_csv(spark, _landed_csv(spark, sf, False), StructType.fromDDL(_CSV_SCHEMA))


@register("csv_quarantine", """
SELECT CASE WHEN doc_id % 9 = 0 THEN 'no value of its type: n_chars' ELSE 'good' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def q_csv_quarantine(spark, sf):
    from pyspark.sql.types import StructType

    from ..sources.readers import read_csv_by_header
    good, bad = read_csv_by_header(spark, _landed_csv(spark, sf, True), StructType.fromDDL(_CSV_SCHEMA))
    return good.select(F.lit("good").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))
