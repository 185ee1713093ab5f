"""The evaluation document from one cube of the results.

One pass counts the results by dataset, script, category, truth, prediction, detected and expected language, and, as
further grouping sets of the same pass, the values of every timing column. The cube has at most so many rows as these few
labels combine to, is written once, and feeds every section; medians come from the counted timings. Row-level parts
(wrong rows, all rows) are tables of their own and never pass through the document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..session import materialize
from . import metrics as M
from .metrics import _div
from .report import quantiles_of_counts

DIMENSIONS = ["dataset", "script", "category", "truth", "pred", "detected", "expected"]
#: Sections of the long form, in the document's order.
SECTIONS = ["dataset_size", "sentiment_distribution", "script_distribution", "category_accuracy", "overall", "per_class", "per_script",
            "label_breakdown", "detection", "detection_per_script", "detected_distribution", "confusion_matrix", "timing",
            "errors", "errors_by_script", "errors_by_true_label", "misprediction_patterns"]


@dataclass
class Columns:
    """Where a results table holds what; ``expected`` maps scripts to the language that detection should find."""

    script: str = "script_type"
    category: str = "product_category"
    truth: str = "ground_truth"
    pred: str = "predicted_label"
    detected: str = "detected_language"
    confidence: str = "confidence_score"
    dataset: str | None = None
    times: tuple[str, ...] = ()
    expected: tuple[tuple[str, str], ...] = FV.SCRIPT_LANGUAGES


def _expected(c: Columns) -> Column:
    pairs = [x for s, l in c.expected for x in (F.lit(s), F.lit(l))]
    return F.try_element_at(F.create_map(*pairs), F.col(c.script)) if pairs else F.lit(None).cast("string")


def evaluation_cube(results: DataFrame, c: Columns = Columns()) -> DataFrame:
    """(set, the dimensions, step, value, n, confidence, seconds of every timing column): ``set`` 0 holds the counts of the
    dimensions, set i the counts of the values of timing column i."""
    text = lambda name: F.col(name).cast("string")
    times = [f"_t{i}" for i in range(len(c.times))]
    rows = results.select(
        (text(c.dataset) if c.dataset else F.lit("all")).alias("dataset"), text(c.script).alias("script"), text(c.category).alias("category"),
        text(c.truth).alias("truth"), text(c.pred).alias("pred"), text(c.detected).alias("detected"), _expected(c).alias("expected"),
        F.col(c.confidence).cast("double").alias("confidence"), *[F.col(t).cast("double").alias(a) for t, a in zip(c.times, times)],
        *[F.col(t).cast("double").alias(f"_v{i}") for i, t in enumerate(c.times)])
    sums = [F.count("*").alias("n"), F.sum("confidence").alias("confidence"), *[F.sum(t).alias(t) for t in times]]
    values = [f"_v{i}" for i in range(len(c.times))]
    cols = [*DIMENSIONS, *values]
    sets = [[F.col(x) for x in DIMENSIONS], *[[F.col(v)] for v in values]]
    cube = rows.groupingSets(sets, *[F.col(x) for x in cols]).agg(*sums, F.grouping_id(*[F.col(x) for x in cols]).alias("_id"))
    all_bits = (1 << len(cols)) - 1
    ids = [all_bits & ~sum(1 << (len(cols) - 1 - cols.index(x)) for x in names) for names in [DIMENSIONS, *[[v] for v in values]]]
    which = F.coalesce(*[F.when(F.col("_id") == i, F.lit(k)) for k, i in enumerate(ids)])
    value = F.coalesce(*[F.when(F.col("_id") == i, F.col(v)) for v, i in zip(values, ids[1:])]) if values else F.lit(None).cast("double")
    return materialize(cube.select(which.alias("set"), *DIMENSIONS, value.alias("value"), "n", "confidence", *times), "evaluation-cube")


class Evaluation:
    """Sections as small tables over a cube."""

    def __init__(self, results: DataFrame, columns: Columns = Columns()):
        self.columns = columns
        self.cube = evaluation_cube(results, columns)
        self.counts = self.cube.filter("set = 0")
        self.right = F.col("truth").eqNullSafe(F.col("pred"))

    def _n(self, where: Column | None = None) -> Column:
        return F.sum(F.col("n") if where is None else F.when(where, F.col("n")).otherwise(0))

    def sizes(self) -> DataFrame:
        return self.counts.groupBy("dataset").agg(self._n().alias("n"))

    def distribution(self, by: str) -> DataFrame:
        return self.counts.groupBy(by).agg(self._n().alias("n"))

    def accuracy_by(self, by: str) -> DataFrame:
        g = self.counts.groupBy(by).agg(self._n().alias("total"), self._n(self.right).alias("correct"), F.sum("confidence").alias("_c"),
                                        *[F.sum(f"_t{i}").alias(f"_t{i}") for i in range(len(self.columns.times))])
        return g.select(by, "total", "correct", _div(F.col("correct"), F.col("total")).alias("accuracy"),
                        (F.col("_c") / F.col("total")).alias("avg_confidence"),
                        *[(F.col(f"_t{i}") / F.col("total") * 1000).alias(f"avg_{t}_ms") for i, t in enumerate(self.columns.times)])

    def overall(self) -> DataFrame:
        return self.counts.agg(self._n().alias("total"), self._n(self.right).alias("correct")).select(
            "total", "correct", _div(F.col("correct"), F.col("total")).alias("accuracy"))

    def confusion(self) -> DataFrame:
        return self.counts.groupBy("truth", "pred").agg(self._n().alias("n"))

    def per_class(self) -> DataFrame:
        return M.label_stats(self.confusion(), None, FV.LABELS).select("label", "precision", "recall", "f1", "support")

    def matrix(self) -> DataFrame:
        return M.matrix_of(self.confusion(), FV.LABELS)

    def label_breakdown(self) -> DataFrame:
        g = self.counts.filter("truth is not null").groupBy("script", "truth").agg(self._n().alias("n"), self._n(self.right).alias("_ok"))
        return g.select("script", "truth", "n", _div(F.col("_ok"), F.col("n")).alias("accuracy"))

    def detection(self) -> DataFrame:
        ok = F.col("detected").eqNullSafe(F.col("expected")) & F.col("expected").isNotNull()
        return self.counts.agg(self._n().alias("total"), self._n(ok).alias("correct")).select(
            "total", "correct", _div(F.col("correct"), F.col("total")).alias("accuracy"))

    def detection_per_script(self) -> DataFrame:
        g = self.counts.filter("expected is not null").groupBy("script", "expected").agg(
            self._n().alias("total"), self._n(F.col("detected").eqNullSafe(F.col("expected"))).alias("correct"))
        return g.select("script", "expected", "total", "correct", _div(F.col("correct"), F.col("total")).alias("accuracy"))

    def detected_distribution(self) -> DataFrame:
        return self.counts.filter("expected is not null").groupBy("script", "detected").agg(self._n().alias("n"))

    def timing(self) -> DataFrame | None:
        """Milliseconds per step: mean, median, std, min, max."""
        if not self.columns.times:
            return None
        names = F.array(*[F.lit(t) for t in self.columns.times])
        v = self.cube.filter("set > 0 and value is not null").select(
            F.element_at(names, F.col("set")).alias("step"), (F.col("value") * 1000).alias("v"), "n")
        mean = v.groupBy("step").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
        off = v.join(mean, "step").groupBy("step").agg(
            F.first("mean").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
            F.sqrt(F.try_divide(F.sum(F.pow(F.col("v") - F.col("mean"), 2) * F.col("n")), F.sum("n") - 1)).alias("std"))
        median = quantiles_of_counts(v.select(F.col("step").alias("_vm_g"), "v", "n"), {"median": 0.5}).withColumnRenamed("_vm_g", "step")
        return off.join(median, "step").select("step", "mean", "median", "std", "min", "max")

    def errors(self) -> DataFrame:
        return self.counts.agg(self._n(~self.right).alias("errors"), self._n().alias("total")).select(
            "errors", _div(F.col("errors"), F.col("total")).alias("error_rate"))

    def errors_by(self, by: str) -> DataFrame:
        return self.counts.filter(~self.right).groupBy(by).agg(self._n().alias("n"))

    def patterns(self) -> DataFrame:
        return self.counts.filter(~self.right).groupBy("truth", "pred").agg(self._n().alias("n"))

    def long(self) -> DataFrame:
        """All sections in one table (section, a, b, metric, value), for a report store or a comparison."""
        parts = [
            ("dataset_size", self.sizes(), ["dataset"]), ("sentiment_distribution", self.distribution("truth"), ["truth"]),
            ("script_distribution", self.distribution("script"), ["script"]), ("category_accuracy", self.accuracy_by("category"), ["category"]),
            ("overall", self.overall(), []), ("per_class", self.per_class(), ["label"]), ("per_script", self.accuracy_by("script"), ["script"]),
            ("label_breakdown", self.label_breakdown(), ["script", "truth"]), ("detection", self.detection(), []),
            ("detection_per_script", self.detection_per_script(), ["script", "expected"]),
            ("detected_distribution", self.detected_distribution(), ["script", "detected"]),
            ("confusion_matrix", self.matrix(), ["truth", "pred"]), ("errors", self.errors(), []),
            ("errors_by_script", self.errors_by("script"), ["script"]), ("errors_by_true_label", self.errors_by("truth"), ["truth"]),
            ("misprediction_patterns", self.patterns(), ["truth", "pred"])]
        timing = self.timing()
        if timing is not None:
            parts.append(("timing", timing, ["step"]))
        out = None
        for section, df, keys in parts:
            names = (keys + [None, None])[:2]
            metrics = [x for x in df.columns if x not in keys]
            one = df.select(F.lit(section).alias("section"), *[(F.col(k) if k else F.lit(None)).cast("string").alias(a) for k, a in zip(names, "ab")],
                            F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m"))
            one = one.select("section", "a", "b", "_m.metric", "_m.value")
            out = one if out is None else out.unionByName(one)
        return out

    def document(self, date: str | None = None, config: dict | None = None) -> DataFrame:
        """One row: every section as an array of structs in a fixed order, and ``document``, the JSON of them all. It is folded from
        the written cube alone."""
        def rows(df: DataFrame) -> Column:
            folded = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("x"))
            return folded.scalar()

        def one(df: DataFrame) -> Column:
            return df.select(F.struct(*df.columns).alias("x")).scalar()
        when = F.lit(date) if date is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
        settings = F.to_json(F.create_map(*[x for k, v in (config or {}).items() for x in (F.lit(k), F.lit(str(v)))])) if config else F.lit("{}")
        timing = self.timing()
        doc = self.cube.sparkSession.range(1).select(
            when.alias("evaluation_date"), settings.alias("pipeline_config"),
            F.struct(rows(self.sizes()).alias("sizes"), one(self.overall())["total"].alias("total"),
                     rows(self.distribution("truth")).alias("sentiment_distribution"),
                     rows(self.distribution("script")).alias("script_distribution")).alias("dataset"),
            F.struct(one(self.overall())["accuracy"].alias("accuracy"), rows(self.per_class()).alias("per_class")).alias("overall_metrics"),
            rows(self.accuracy_by("script")).alias("per_language_metrics"), rows(self.label_breakdown()).alias("label_breakdown"),
            rows(self.accuracy_by("category")).alias("per_category_metrics"),
            F.struct(one(self.detection())["accuracy"].alias("overall_accuracy"), rows(self.detection_per_script()).alias("per_script"),
                     rows(self.detected_distribution()).alias("detected_distribution")).alias("language_detection"),
            rows(self.matrix()).alias("confusion_matrix"),
            *([rows(timing).alias("timing_statistics")] if timing is not None else []),
            F.struct(one(self.errors())["errors"].alias("total_errors"), one(self.errors())["error_rate"].alias("error_rate"),
                     rows(self.errors_by("script")).alias("errors_by_script"), rows(self.errors_by("truth")).alias("errors_by_true_label"),
                     rows(self.patterns()).alias("misprediction_patterns")).alias("error_analysis"))
        return doc.withColumn("document", F.to_json(F.struct(*doc.columns)))


def full_results(results: DataFrame, c: Columns = Columns(), key: str = "review_id", rating: str | None = "rating",
                 errors: str = "errors", digits: int = 4) -> DataFrame:
    """All predictions, one row each, as the document's table ``full_results`` shows them."""
    more = [F.col(rating)] if rating else []
    return results.select(
        key, F.col(c.script).alias("script_type"), F.col(c.category).alias("product_category"), *more, F.col(c.truth).alias("ground_truth"),
        F.col(c.pred).alias("predicted_label"), F.round(c.confidence, digits).alias("confidence_score"), F.col(c.detected).alias("detected_language"),
        F.col(c.truth).eqNullSafe(F.col(c.pred)).alias("correct"), *[F.round(F.col(t) * 1000, 3).alias(f"{t}_ms") for t in c.times],
        F.col(errors).alias("pipeline_errors"))


def error_details(results: DataFrame, c: Columns = Columns(), key: str = "review_id", errors: str = "errors", digits: int = 4) -> DataFrame:
    """The wrong predictions, as the document's ``error_details`` shows them."""
    wrong = results.filter(~F.col(c.truth).eqNullSafe(F.col(c.pred)))
    return wrong.select(key, F.col(c.script).alias("script_type"), F.col(c.truth).alias("ground_truth"), F.col(c.pred).alias("predicted_label"),
                        F.round(c.confidence, digits).alias("confidence"), F.col(errors).alias("pipeline_errors"),
                        F.col(c.detected).alias("detected_language"))
