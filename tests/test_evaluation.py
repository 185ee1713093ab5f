import json
import random
import statistics
from collections import Counter

from pyspark.sql import functions as F

from vimarsha.operators import evaluation as E
from vimarsha.operators.report import numeric_summary, ranked_parts

SCRIPTS = ("Kannada Script", "Romanized Kannada", "English", None)
LABELS = ("Positive", "Negative", "Neutral")
COLUMNS = E.Columns(dataset="part", times=("t_detect", "t_total"))


def rows():
    r = random.Random(6)
    out = []
    for i in range(240):
        truth = r.choice(LABELS)
        out.append((i, r.choice(("demo", "extended")), r.choice(SCRIPTS), f"c{i % 4}", 1 + i % 5, truth, truth if r.random() < .6 else r.choice([*LABELS, None]),
                    r.choice(("kannada_script", "romanized_kannada", "english", "mixed")), r.randrange(1000) / 1000, r.choice(("", "slow; late")),
                    r.randrange(50) / 1000, None if i % 11 == 0 else r.randrange(900) / 100))
    return out


SCHEMA = ("review_id int, part string, script_type string, product_category string, rating int, ground_truth string, predicted_label string, "
          "detected_language string, confidence_score double, errors string, t_detect double, t_total double")


def long(df):
    got = {}
    for x in df.collect():
        assert (x.section, x.a, x.b, x.metric) not in got
        got[x.section, x.a, x.b, x.metric] = x.value
    return got


def test_sections_equal_plain_counts(spark):
    data = rows()
    got = long(E.Evaluation(spark.createDataFrame(data, SCHEMA).repartition(3), COLUMNS).long())
    n = len(data)
    right = [x for x in data if x[5] == x[6]]
    expected = dict(COLUMNS.expected)

    def counts(section, keys, rows, metric="n"):
        want = Counter(tuple(keys(x)) for x in rows)
        have = {(a, b): v for (s, a, b, m), v in got.items() if s == section and m == metric}
        assert have == {(*k, None)[:2] if len(k) < 2 else k: v for k, v in want.items()}, section
    counts("dataset_size", lambda x: (x[1],), data)
    counts("sentiment_distribution", lambda x: (x[5],), data)
    counts("script_distribution", lambda x: (x[2],), data)
    counts("errors_by_script", lambda x: (x[2],), [x for x in data if x[5] != x[6]])
    counts("errors_by_true_label", lambda x: (x[5],), [x for x in data if x[5] != x[6]])
    counts("misprediction_patterns", lambda x: (x[5], x[6]), [x for x in data if x[5] != x[6]])
    counts("detected_distribution", lambda x: (x[2], x[7]), [x for x in data if x[2]])
    counts("label_breakdown", lambda x: (x[2], x[5]), data)
    assert got["overall", None, None, "accuracy"] == len(right) / n
    assert got["errors", None, None, "error_rate"] == (n - len(right)) / n
    found = sum(expected.get(x[2]) == x[7] for x in data if x[2])
    assert got["detection", None, None, "correct"] == found and got["detection", None, None, "total"] == n
    for script in SCRIPTS[:3]:
        own = [x for x in data if x[2] == script]
        assert abs(got["per_script", script, None, "avg_confidence"] - statistics.mean(x[8] for x in own)) < 1e-9
        assert got["detection_per_script", script, expected[script], "correct"] == sum(x[7] == expected[script] for x in own)
    for label in LABELS:
        tp = sum(x[5] == x[6] == label for x in data)
        assert abs(got["per_class", label, None, "precision"] - tp / sum(x[6] == label for x in data)) < 1e-12
        for pred in LABELS:
            assert got["confusion_matrix", label, pred, "n"] == sum(x[5] == label and x[6] == pred for x in data)
    for name, at in (("t_detect", 10), ("t_total", 11)):
        v = [x[at] * 1000 for x in data if x[at] is not None]
        for metric, want in (("mean", statistics.mean(v)), ("median", statistics.median(v)), ("std", statistics.stdev(v)), ("min", min(v)), ("max", max(v))):
            assert abs(got["timing", name, None, metric] - want) < 1e-6, (name, metric)


def test_document_holds_every_section_and_one_scan(spark):
    data = spark.createDataFrame(rows(), SCHEMA)
    done = E.Evaluation(data, COLUMNS)
    doc = done.document("2026-01-01", {"translation_backend": "fallback"})
    row = doc.first()
    parsed = json.loads(row["document"])
    assert parsed["evaluation_date"] == "2026-01-01" and json.loads(parsed["pipeline_config"]) == {"translation_backend": "fallback"}
    assert set(parsed) >= {"dataset", "overall_metrics", "per_language_metrics", "language_detection", "confusion_matrix", "timing_statistics", "error_analysis"}
    assert parsed["dataset"]["total"] == 240 and len(parsed["confusion_matrix"]) == 9
    files = done.long().inputFiles()        # only the written cube, and what quantiles make of it, is read
    assert files and all("evaluation-cube" in f or "ranked-parts" in f for f in files)
    empty = E.Evaluation(data.limit(0), COLUMNS)
    assert json.loads(empty.document("x").first()["document"])["dataset"]["sizes"] == []


def test_row_level_tables(spark):
    data = spark.createDataFrame(rows(), SCHEMA)
    full = E.full_results(data, COLUMNS).collect()
    assert len(full) == 240 and full[0].t_detect_ms == round(rows()[0][10] * 1000, 3)
    assert E.error_details(data, COLUMNS).count() == sum(x[5] != x[6] for x in rows())


def test_parts_are_even_on_heavy_tails(spark):
    r = random.Random(2)
    values = [r.random() for _ in range(20_000)] + [1e12]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    counts = df.select(F.lit("g").alias("_vm_g"), "v").groupBy("_vm_g", "v").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [x["count"] for x in ranked_parts(counts).groupBy("b").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 6 and max(sizes) < 0.3 * len(values)
    assert numeric_summary(df, ["v"]).first().median == statistics.median(values)
