"""Report tables as grouped aggregations.

Each operator is one or two hash aggregations (partial on the map side) plus joins of tiny
aggregated tables. Totals are one-row aggregates attached as scalar subqueries, never by
collecting to the driver. Where a result is ranked, ties break on the key so the
order is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as FV
from ..functions import text as X
from ..session import materialize


def _div(a, b) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double") if isinstance(a, str) else a.cast("double"),
                                   F.col(b).cast("double") if isinstance(b, str) else b.cast("double")),
                      F.lit(0.0))


def _with_total(df: DataFrame, total: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row as scalar subqueries (computed
    once, inlined as values: no join)."""
    return df.withColumns({c: total.select(c).scalar() for c in total.columns})


# --------------------------------------------------------------------------- A1/K3
def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """A1: count and share per value, ordered by count desc then value."""
    counts = df.groupBy(col).agg(F.count("*").alias(out))
    total = counts.agg(F.sum(out).alias("_total"))  # from the grouped table: the input is read once
    j = _with_total(counts, total)
    return (j.select(col, out, _div(F.col(out), F.col("_total")).alias("share"))
            .orderBy(F.desc(out), F.asc_nulls_last(col)))


def top_k(df: DataFrame, col: str, k: int, out: str = "n") -> DataFrame:
    """K3: the k most frequent values (ties by value); the limit is the feature."""
    return df.groupBy(col).agg(F.count("*").alias(out)).orderBy(F.desc(out), F.asc(col)).limit(k)


def first_n(df: DataFrame, n: int, key: str) -> DataFrame:
    """K1: the first n rows by key (TakeOrderedAndProject)."""
    return df.orderBy(key).limit(n)


# --------------------------------------------------------------------------- A2
def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """A2: counts of row x col with the given column values, missing = 0."""
    return df.groupBy(row).pivot(col, values).count().fillna(0, subset=values)


# --------------------------------------------------------------------------- A10/A11
def script_summary(df: DataFrame, key: str = "script_type", truth: str = "ground_truth",
                   pred: str = "predicted_label", conf: str = "confidence_score",
                   time: str | None = None) -> DataFrame:
    """A10: per group total, correct, accuracy, avg confidence, avg time and recall per truth label.

    Two aggregations: (group, truth) then group; the per-label map holds <= |labels| entries.
    """
    eq = F.col(truth).eqNullSafe(F.col(pred))
    tcol = F.col(time) if time else F.lit(None).cast("double")
    per_label = df.groupBy(key, truth).agg(
        F.count("*").alias("_n"), F.count_if(eq).alias("_ok"), F.sum(conf).alias("_conf"),
        F.sum(tcol).alias("_time"), F.count(tcol).alias("_nt"))
    return per_label.groupBy(key).agg(
        F.sum("_n").alias("total"), F.sum("_ok").alias("correct"),
        _div(F.sum("_ok"), F.sum("_n")).alias("accuracy"),
        (F.sum("_conf") / F.sum("_n")).alias("avg_confidence"),
        F.try_divide(F.sum("_time"), F.sum("_nt")).alias("avg_time"),
        F.map_from_entries(F.collect_list(F.struct(F.col(truth), _div(F.col("_ok"), F.col("_n"))))).alias("label_recall"),
    )


def accuracy_by(df: DataFrame, key: str, correct: str = "correct") -> DataFrame:
    """Total, correct, accuracy per group, best first."""
    g = df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col(correct)).alias("n_correct"))
    return (g.select(key, "total", "n_correct", _div(F.col("n_correct"), F.col("total")).alias("accuracy"))
            .orderBy(F.desc("accuracy"), F.asc(key)))


# --------------------------------------------------------------------------- A12-A14, A19, A23
def _group(by: list[str]) -> Column:
    """A group's values as one text that is never NULL."""
    return F.to_json(F.struct(*by)).alias("_vm_g")


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation) of ``value`` per group as (``_vm_g``, one column per entry of ``qs``).

    Distinct values are counted first, with partial sums before the shuffle. NULLs are left out.
    """
    return quantiles_of_counts(df.filter(F.col(value).isNotNull()).select(_group(by), F.col(value).cast("double").alias("v"))
                               .groupBy("_vm_g", "v").agg(F.count("*").alias("n")), qs)


def ranked_parts(counts: DataFrame) -> DataFrame:
    """Counts of distinct values (``_vm_g``, v, n) with the part ``b`` that holds them, written once. Parts are ranges of (group,
    value) between sampled pivots, so they hold about equally many values however those are spread."""
    return materialize(counts.repartitionByRange("_vm_g", "v").withColumn("b", F.spark_partition_id()), "ranked-parts")


def quantiles_of_counts(counts: DataFrame, qs: dict[str, float]) -> DataFrame:
    """Quantiles of counted distinct values (``_vm_g``, v, n). Prefix sums over the parts' totals (parts of a group, at most as
    many as there are partitions) find the parts that hold the wanted ranks; only their values are ranked one by one."""
    g = "_vm_g"
    parts = ranked_parts(counts)
    totals = parts.groupBy(g, "b").agg(F.sum("n").alias("bn"))
    w = Window.partitionBy(g)
    before = F.coalesce(F.sum("bn").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), F.lit(side).alias("side"))
                      for name, q in qs.items() for side in (0, 1)])
    place = F.col("want.q") * (F.col("total") - 1)
    wanted = totals.withColumn("before", before).withColumn("total", F.sum("bn").over(w)).withColumn("want", F.explode(ranks)).select(
        g, "b", "bn", "before", F.col("want.name").alias("name"), F.col("want.side").alias("side"), place.alias("place"),
        F.when(F.col("want.side") == 0, F.floor(place)).otherwise(F.ceil(place)).alias("rank")).filter(
        (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("bn")))
    upto = F.sum("n").over(Window.partitionBy(g, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = parts.join(wanted.select(g, "b", "before").distinct(), [g, "b"]).withColumn(
        "last", F.col("before") + upto).withColumn("first", F.col("last") - F.col("n")).drop("before")
    found = wanted.join(inside, [g, "b"]).filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    end = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("v")))
    part = lambda name: F.max(F.when(F.col("name") == name, F.col("place") - F.floor("place")))
    return found.groupBy(g).agg(*[(end(n, 0) + (end(n, 1) - end(n, 0)) * part(n)).alias(n) for n in qs])


def _with_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float], aggs: list[Column]) -> DataFrame:
    """The aggregates and quantiles of each group, groups of NULLs included."""
    a = df.groupBy(_group(by), *by).agg(*aggs)
    return a.join(exact_quantiles(df, by, value, qs), "_vm_g", "left").drop("_vm_g")


def _moments(c: Column) -> list[Column]:
    return [F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]


def numeric_summary(df: DataFrame, cols: list[str], scale: float = 1.0) -> DataFrame:
    """Mean / exact median / sample std / min / max per column (long form), values times ``scale``."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value").withColumn("value", F.col("value") * F.lit(scale))
    out = _with_quantiles(long, ["column"], "value", {"median": 0.5}, _moments(F.col("value")))
    return out.select("column", "mean", "median", "std", "min", "max")


def numeric_summary_by(df: DataFrame, key: str, col: str, scale: float = 1.0) -> DataFrame:
    """The same five statistics per group."""
    v = df.select(F.col(key), (F.col(col).cast("double") * F.lit(scale)).alias("_vm_v"))
    out = _with_quantiles(v, [key], "_vm_v", {"median": 0.5}, _moments(F.col("_vm_v")))
    return out.select(key, "mean", "median", "std", "min", "max")


def step_means_long(df: DataFrame, key: str, cols: list[str], scale: float = 1.0) -> DataFrame:
    """Mean per step per group, wide -> long (key, step, mean)."""
    wide = df.groupBy(key).agg(*[(F.avg(F.col(c).cast("double")) * F.lit(scale)).alias(c) for c in cols])
    return wide.unpivot([key], cols, "step", "mean")


def confidence_by_outcome(df: DataFrame, correct: str = "correct", conf: str = "confidence_score") -> DataFrame:
    """Mean and median confidence for correct vs incorrect predictions."""
    out = _with_quantiles(df.select(correct, conf), [correct], conf, {"median": 0.5}, [F.avg(conf).alias("mean"), F.count("*").alias("n")])
    return out.select(correct, "mean", "median", "n")


def box_summary(df: DataFrame, col: str, by: str) -> DataFrame:
    """Quartiles (linear interpolation), mean, std, min, max per group."""
    v = df.select(F.col(by), F.col(col).cast("double").alias("_vm_v"))
    out = _with_quantiles(v, [by], "_vm_v", {"q1": 0.25, "median": 0.5, "q3": 0.75},
                          [*_moments(F.col("_vm_v")), F.count("_vm_v").alias("n")])
    return out.select(by, "n", "q1", "median", "q3", "mean", "std", "min", "max")


# --------------------------------------------------------------------------- A15
def word_accuracy(outputs: DataFrame, reference: DataFrame, word: str = "word",
                  got: str = "got", expected: str = "expected") -> DataFrame:
    """A15 + J6: join outputs to reference pairs on the word; totals and ratio (0 when empty)."""
    j = reference.select(word, expected).join(outputs.select(word, got), word)
    ok = F.col(got) == F.col(expected)
    return j.agg(F.count("*").alias("total"), F.count_if(ok).alias("correct"),
                 F.count_if(~ok).alias("incorrect"),
                 _div(F.count_if(ok), F.count("*")).alias("accuracy"))


def word_errors(outputs: DataFrame, reference: DataFrame, word: str = "word",
                got: str = "got", expected: str = "expected") -> DataFrame:
    """A15 error rows: (input, expected, got) where the output differs."""
    j = reference.select(word, expected).join(outputs.select(word, got), word)
    return j.filter(F.col(got) != F.col(expected)).select(F.col(word).alias("input"), expected, got)


# --------------------------------------------------------------------------- A16
def detection_accuracy(df: DataFrame, key: str = "script_type", detected: str = "detected_language",
                       expected: str = "expected_language") -> DataFrame:
    """Per group total, correct, accuracy and the detected-language distribution."""
    ok = F.col(detected).eqNullSafe(F.col(expected))
    per = df.groupBy(key, expected, detected).agg(F.count("*").alias("_n"), F.count_if(ok).alias("_ok"))
    return per.groupBy(key, expected).agg(
        F.sum("_n").alias("total"), F.sum("_ok").alias("correct"),
        _div(F.sum("_ok"), F.sum("_n")).alias("accuracy"),
        *[F.sum(F.when(F.col(detected) == lang, F.col("_n")).otherwise(0)).alias(f"n_{lang}") for lang in FV.LANGUAGES],
    )


# --------------------------------------------------------------------------- A17, A18, A33, J2, J3
def misprediction_pairs(df: DataFrame, truth: str = "ground_truth", pred: str = "predicted_label",
                        correct: str = "correct") -> DataFrame:
    """(truth, predicted, count) over wrong rows, most frequent first."""
    return (df.filter(~F.col(correct)).groupBy(truth, pred).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), truth, pred))


def top_messages(df: DataFrame, errors: str = "errors", correct: str = "correct", k: int = 5) -> DataFrame:
    """Messages of wrong rows, split on ';', trimmed, blanks dropped; top k by count."""
    wrong = df.filter(~F.col(correct) & (F.length(errors) > 0))
    parts = X.explode_rows(wrong, F.split(errors, ";"), "_p").select(X.py_strip("_p").alias("message"))
    return top_k(parts.filter(F.col("message") != ""), "message", k, "count")


def error_rate_by(df: DataFrame, key: str, correct: str = "correct") -> DataFrame:
    """Per group error count, total and rate; groups without errors are dropped."""
    g = df.groupBy(key).agg(F.count_if(~F.col(correct)).alias("error_count"), F.count("*").alias("total"))
    return g.filter("error_count > 0").select(key, "error_count", "total",
                                              _div(F.col("error_count"), F.col("total")).alias("error_rate"))


def error_details(df: DataFrame, cols: list[str], correct: str = "correct") -> DataFrame:
    """Wrong rows with their review text (already on the row: no join needed)."""
    return df.filter(~F.col(correct)).select(*cols)


def error_summary(df: DataFrame, key: str = "script_type", truth: str = "ground_truth",
                  correct: str = "correct") -> DataFrame:
    """Error count and rate overall, by group and by true label, in long form.

    One pass over the input: counts per (group, truth, correct) -- a small table -- then every
    section is a sum over it.
    """
    base = df.groupBy(F.col(key).cast("string").alias("_k"), F.col(truth).cast("string").alias("_t"),
                      F.col(correct).alias("_ok")).agg(F.count("*").alias("_n"))
    err = F.when(~F.col("_ok"), F.col("_n")).otherwise(0)
    overall = base.agg(F.lit("overall").alias("section"), F.lit(None).cast("string").alias("key"),
                       F.sum(err).alias("errors"), F.sum("_n").alias("total"))
    by_key = (base.groupBy(F.col("_k").alias("key")).agg(F.sum(err).alias("errors"), F.sum("_n").alias("total"))
              .withColumn("section", F.lit(key)))
    by_truth = (base.filter(~F.col("_ok")).groupBy(F.col("_t").alias("key")).agg(F.sum("_n").alias("errors"))
                .withColumn("total", F.lit(None).cast("long")).withColumn("section", F.lit(truth)))
    u = overall.unionByName(by_key).unionByName(by_truth)
    return u.withColumn("error_rate", F.try_divide(F.col("errors").cast("double"), F.col("total").cast("double")))


# --------------------------------------------------------------------------- A20-A22, A24
def kpis(df: DataFrame, status: str = "status", label: str = "sentiment_label",
         conf: str = "confidence_score", time: str = "processing_time_s") -> DataFrame:
    """Dashboard numbers in one aggregation; averages are 0.0 when nothing was processed."""
    ok = F.col(status).isin("ok", "ok_with_warnings")
    return df.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("processed"),
        (F.count("*") - F.count_if(ok)).alias("errors"),
        F.count_if(ok & (F.col(label) == "Positive")).alias("positive"),
        F.count_if(ok & (F.col(label) == "Negative")).alias("negative"),
        F.count_if(ok & (F.col(label) == "Neutral")).alias("neutral"),
        F.coalesce(F.avg(F.when(ok, F.col(conf))), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.avg(F.when(ok, F.col(time))), F.lit(0.0)).alias("avg_time"),
    )


def confidence_by(df: DataFrame, lang: str = "detected_language", label: str = "sentiment_label",
                  conf: str = "confidence_score", status: str = "status") -> DataFrame:
    """Mean confidence per language x sentiment over processed rows; empty unless >1 language.

    One pass: processed-only averages are conditional aggregates (a row filter on a derived
    column would be pushed down and recompute it), and the language count is taken from the
    small grouped result.
    """
    ok = F.col(status).isin("ok", "ok_with_warnings")
    g = (df.groupBy(lang, label).agg(F.avg(F.when(ok, F.col(conf))).alias("avg_confidence"),
                                     F.count_if(ok).alias("_ok"))
         .filter("_ok > 0").drop("_ok"))
    n_lang = g.agg(F.count_distinct(lang).alias("_langs"))
    return _with_total(g, n_lang).filter("_langs > 1").drop("_langs")


def histogram(df: DataFrame, col: str, by: str | None, lo: float, hi: float, bins: int) -> DataFrame:
    """Equal-width bins over [lo, hi]; values at or beyond the edges go to the end bins."""
    v = F.col(col).cast("double")
    b = F.least(F.greatest(F.floor((v - F.lit(lo)) * F.lit(float(bins)) / F.lit(float(hi - lo))), F.lit(0)),
                F.lit(bins - 1)).cast("int")
    keys = ([by] if by else []) + [b.alias("bin")]
    g = df.filter(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("count"))
    width = (hi - lo) / bins
    return g.select(*([by] if by else []), (F.col("bin") + 1).alias("bin"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"), "count")


def label_balance(df: DataFrame, truth: str = "ground_truth", pred: str = "predicted_label",
                  labels: list[str] = FV.LABELS) -> DataFrame:
    """True and predicted counts re-indexed on the full label list (0 filled)."""
    both = df.select(F.explode(F.array(F.struct(F.lit("true").alias("side"), F.col(truth).alias("label")),
                                       F.struct(F.lit("pred").alias("side"), F.col(pred).alias("label")))).alias("s"))
    g = both.groupBy("s.label").agg(F.count_if(F.col("s.side") == "true").alias("true_count"),
                                    F.count_if(F.col("s.side") == "pred").alias("predicted_count"))
    dim = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return dim.join(g, "label", "left").fillna(0, subset=["true_count", "predicted_count"])


# --------------------------------------------------------------------------- A25-A27
def unchanged_words(pairs: DataFrame, inp: str = "input", got: str = "got") -> DataFrame:
    """Candidates for the dictionary -- the words that came out as they went in, most frequent first."""
    return pairs.filter(F.col(got) == F.col(inp)).groupBy(F.col(inp).alias("word")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), F.asc("word"))


def translit_error_patterns(pairs: DataFrame, inp: str = "input", got: str = "got") -> DataFrame:
    """Classify failed words -- unchanged (output = input), wrong (has native chars), partial."""
    kind = (F.when(F.col(got) == F.col(inp), "unchanged").when(X.has_native(got), "wrong").otherwise("partial"))
    return pairs.withColumn("pattern", kind)


def char_frequency(df: DataFrame, col: str, k: int = 15, letters_only: bool = True, lower: bool = True) -> DataFrame:
    """Top-k characters of the (lower-cased) text, letters only by default."""
    pat = r"(\p{L})" if letters_only else r"(?s)(.)"
    src = F.lower(col) if lower else F.col(col)
    chars = X.explode_rows(df, F.regexp_extract_all(src, F.lit(pat), 1), "char")
    return top_k(chars, "char", k, "count")


def ending_frequency(df: DataFrame, col: str, n: int = 2, k: int = 5) -> DataFrame:
    """Top-k word endings (last n chars) of words with at least n chars."""
    w = df.filter(F.length(col) >= n).select(F.substring(col, -n, n).alias("ending"))
    return top_k(w, "ending", k, "count")


# --------------------------------------------------------------------------- A28/A29
def quality_summary(df: DataFrame, score: str = "score", success: str = "success") -> DataFrame:
    """Total, scored, avg/min/max score, distribution over exactly 1..5, success share."""
    s = F.col(score)
    dist = [F.count_if(s == i).alias(f"score_{i}") for i in range(1, 6)]
    return df.agg(F.count("*").alias("total"), F.count(s).alias("scored"), F.avg(s).alias("avg_score"),
                  F.min(s).alias("min_score"), F.max(s).alias("max_score"), *dist,
                  _div(F.count_if(F.col(success)), F.count("*")).alias("success_rate"))


def quality_by_category(df: DataFrame, key: str = "category", score: str = "score",
                        backend: str = "backend") -> DataFrame:
    """Mean score per category (by category); categories without scores dropped; backends used.

    Conditional aggregates instead of a row filter, so a computed score is evaluated once.
    """
    has = F.col(score).isNotNull()
    g = df.groupBy(key).agg(
        F.avg(score).alias("avg_score"), F.count(score).alias("n"),
        F.array_sort(F.collect_set(F.when(has, F.col(backend)))).alias("backends"))
    return g.filter("n > 0").orderBy(key)


# --------------------------------------------------------------------------- A30-A32
def profile_text(df: DataFrame, col: str) -> DataFrame:
    """Rows, columns and non-empty (non-null, non-blank) values of the text column."""
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  F.count_if(~X.is_blank(col)).alias("non_empty"))


def label_set(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct labels and their number (labels are a small domain)."""
    return df.filter(F.col(col).isNotNull()).agg(F.array_sort(F.collect_set(F.col(col).cast("string"))).alias("labels")
                                                 ).withColumn("n_classes", F.size("labels"))


def batch_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """Ok (incl. warnings) / error / skipped counts."""
    s = F.col(status)
    return df.agg(F.count_if(s.isin("ok", "ok_with_warnings")).alias("ok"), F.count_if(s == "error").alias("error"),
                  F.count_if(s == "skipped").alias("skipped"))


# --------------------------------------------------------------------------- T17
def _as_array(df: DataFrame, name: str) -> DataFrame:
    """A small section table folded into one row: array of its rows (sections are bounded)."""
    return df.agg(F.collect_list(F.struct(*df.columns)).alias(name))


def _as_struct(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*df.columns).alias(name))


def evaluation_document(evaluated: DataFrame, analyzed: DataFrame | None = None,
                        key: str = "script_type") -> DataFrame:
    """One row holding every report section as structs / arrays plus its JSON text.

    The few columns that the sections read are written once, so texts are read and analyzed once. Each section is a
    grouped aggregate (bounded by labels, groups or k), folded into one row and
    selected as scalar subqueries; ``document`` is ``to_json`` of all of them (write it with S6).
    """
    from . import metrics as M
    ev = materialize(evaluated.select(
        *dict.fromkeys([key, "product_category", "ground_truth", "predicted_label", "confidence_score", "errors"]),
        F.col("ground_truth").eqNullSafe(F.col("predicted_label")).alias("correct")), "evaluated")
    sections = [
        _as_struct(M.f1_summary(ev), "overall"),
        _as_array(M.per_class_metrics(ev), "per_class"),
        _as_array(M.metrics_by(ev, key), "per_script"),
        _as_array(M.confusion_matrix(ev), "confusion_matrix"),
        _as_array(label_balance(ev), "label_balance"),
        _as_array(accuracy_by(ev, "product_category"), "accuracy_by_category"),
        _as_array(misprediction_pairs(ev), "misprediction_pairs"),
        _as_array(top_messages(ev), "top_messages"),
        _as_array(error_rate_by(ev, key), "error_rate_by_script"),
        _as_array(confidence_by_outcome(ev), "confidence_by_outcome"),
        _as_array(box_summary(ev, "confidence_score", "predicted_label"), "confidence_box"),
        _as_array(value_counts(ev, "ground_truth"), "ground_truth_distribution"),
    ]
    if analyzed is not None:
        analyzed = materialize(analyzed.select("status", "sentiment_label", "confidence_score", "processing_time_s", "detected_language"), "analyzed")
        sections += [_as_struct(kpis(analyzed), "kpis"),
                     _as_array(value_counts(analyzed, "detected_language"), "detected_languages")]
    # every section is one row and one column: scalar subqueries, no joins
    spark = evaluated.sparkSession
    doc = spark.range(1).select(*[sec.scalar().alias(sec.columns[0]) for sec in sections])
    return doc.withColumn("document", F.to_json(F.struct(*doc.columns)))
