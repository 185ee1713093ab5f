"""From logits or a fitted Spark ML model to label, confidence and probabilities.

Scorers plug into :func:`vimarsha.operators.pipeline.analyze` as objects with
``score(df, text_col, out) -> df`` adding a struct(label, confidence, probabilities, raw_scores):

* :class:`LexiconScorer` -- transparent word-count logits over a small polarity word list,
  softmax, argmax. Deterministic and expressible in SQL, so end-to-end runs are checkable.
* :class:`vimarsha.operators.ml.TextModelScorer` -- a fitted Spark ML model (TF-IDF + classifier),
  probabilities from ``vector_to_array``; the label names travel with the model.
* :class:`BatchModelScorer` -- a user's own network through ``predict_batch_udf`` (Arrow batches).
* :class:`DistinctScorer` -- any of these, run once per distinct text; :class:`NeutralScorer` -- any of these with
  the neutral threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions import fixed_values as FV
from ..functions import text as X


def softmax(logits: Column) -> Column:
    """Numerically stable softmax over an array<double>."""
    m = F.array_max(logits)
    exps = F.transform(logits, lambda z: F.exp(z - m))
    total = F.aggregate(exps, F.lit(0.0), lambda a, e: a + e)
    return F.transform(exps, lambda e: e / total)


def argmax_index(probs: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def label_of(index: Column, label_map: list[str]) -> Column:
    """Class index -> label, unmapped -> Neutral."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in label_map]), index + 1), F.lit("Neutral"))


def label_probabilities(probs: Column, label_map: list[str]) -> Column:
    """map<label, prob>: classes mapped to the same label have their probabilities summed."""
    order = list(dict.fromkeys(label_map))
    entries = []
    for lab in order:
        idx = [i for i, x in enumerate(label_map) if x == lab]
        total = None
        for i in idx:
            term = F.try_element_at(probs, F.lit(i + 1))
            total = term if total is None else total + term
        entries += [F.lit(lab), total]
    # classes beyond the map are Neutral
    n = len(label_map)
    extra = F.aggregate(F.filter(probs, lambda p, i: i >= n), F.lit(0.0), lambda a, p: a + p)
    if "Neutral" not in order:
        entries += [F.lit("Neutral"), extra]
        mp = F.create_map(*entries)
        return F.map_filter(mp, lambda k, v: (k != "Neutral") | (F.size(probs) > n))
    return F.transform_values(F.create_map(*entries),
                              lambda k, v: F.when(k == "Neutral", v + extra).otherwise(v))


def from_probs(probs: Column, logits: Column, label_map: list[str]) -> Column:
    return F.struct(
        label_of(argmax_index(probs), label_map).alias("label"),
        F.array_max(probs).alias("confidence"),
        label_probabilities(probs, label_map).alias("probabilities"),
        logits.alias("raw_scores"),
    )


def from_logits(df: DataFrame, logits_col: str, label_map: list[str], out: str = "sentiment") -> DataFrame:
    """X8/X9 as an operator: struct(label, confidence, probabilities, raw_scores) from logits."""
    tmp = df.withColumn("_vm_probs", softmax(F.col(logits_col)))
    return tmp.withColumn(out, from_probs(F.col("_vm_probs"), F.col(logits_col), label_map)).drop("_vm_probs")


def apply_neutral_threshold(result: Column, threshold: float = FV.NEUTRAL_THRESHOLD) -> Column:
    """Label becomes Neutral when confidence < threshold; everything else is kept."""
    return result.withField("label", F.when(result["confidence"] < threshold, F.lit("Neutral"))
                            .otherwise(result["label"]))


# ---------------------------------------------------------------------------
# scorers
# ---------------------------------------------------------------------------
# Transparent baseline polarity words (this project's own choice, not a model).
POSITIVE_WORDS = ["good", "great", "excellent", "love", "like", "best", "nice", "happy", "amazing",
                  "awesome", "wonderful", "perfect", "recommend", "satisfied", "fantastic", "beautiful",
                  "worth", "superb"]
NEGATIVE_WORDS = ["bad", "worst", "poor", "terrible", "awful", "hate", "waste", "broken", "disappointed",
                  "defective", "useless", "horrible", "problem", "not", "never", "cheap", "slow", "wrong"]
NEUTRAL_BIAS = 0.5


class LexiconScorer:
    """logits (Negative, Neutral, Positive) = (#negative words, 0.5, #positive words)."""

    label_map = FV.MODEL_LABEL_MAPS[3]

    def __init__(self, positive=None, negative=None, neutral_bias: float = NEUTRAL_BIAS):
        self.positive = positive or POSITIVE_WORDS
        self.negative = negative or NEGATIVE_WORDS
        self.neutral_bias = neutral_bias

    def logits(self, c: Column) -> Column:
        counts = B.word_counts(c, [self.negative, self.positive])
        return X.let(counts, lambda n: F.array(n[0], F.lit(self.neutral_bias), n[1]))

    def score(self, df: DataFrame, text_col: str, out: str = "sentiment") -> DataFrame:
        # logits and probabilities materialised once, then read by the result struct
        tmp = df.withColumn("_vm_logits", self.logits(F.col(text_col)))
        tmp = tmp.withColumn("_vm_probs", softmax(F.col("_vm_logits")))
        res = from_probs(F.col("_vm_probs"), F.col("_vm_logits"), self.label_map)
        return tmp.withColumn(out, res).drop("_vm_logits", "_vm_probs")


class BatchModelScorer:
    """T11 slot for a user's own network, run through ``predict_batch_udf``.

    ``make_predict_fn()`` is called once per Python worker and returns a function from a numpy
    array of texts to a 2-D array of logits (one row per text). Texts travel in Arrow batches of
    ``batch_size``; softmax, label map and confidence are then native expressions.
    """

    def __init__(self, make_predict_fn, label_map: list[str], batch_size: int = 64):
        self.make_predict_fn, self.label_map, self.batch_size = make_predict_fn, label_map, batch_size

    def score(self, df: DataFrame, text_col: str, out: str = "sentiment") -> DataFrame:
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import ArrayType, DoubleType
        udf = predict_batch_udf(self.make_predict_fn, return_type=ArrayType(DoubleType()),
                                batch_size=self.batch_size)
        tmp = df.withColumn("_vm_logits", udf(F.coalesce(F.col(text_col), F.lit(""))))
        tmp = tmp.withColumn("_vm_probs", softmax(F.col("_vm_logits")))
        res = from_probs(F.col("_vm_probs"), F.col("_vm_logits"), self.label_map)
        return tmp.withColumn(out, res).drop("_vm_logits", "_vm_probs")


#: A text that stands in so large a share of the rows that have one is met by a broadcast join; at most 1 / share texts do.
HOT_SHARE = 0.001


class DistinctScorer:
    """Any scorer, run once for each distinct text.

    The distinct texts are counted (with partial aggregation, so a hot text is counted where it is read), scored, and their
    results written under a SHA-256 of the text: the network runs once per text, also where a later stage is repeated.
    Results are joined back by that key. Texts in ``HOT_SHARE`` of the rows or more come back by a broadcast join, of at
    most 1 / ``HOT_SHARE`` results, and take no part in the shuffle join, where a stand-in key spreads them.
    """

    def __init__(self, scorer, hot_share: float = HOT_SHARE):
        self.scorer, self.hot_share = scorer, hot_share

    def results(self, texts: DataFrame, text_col: str) -> tuple[DataFrame, int]:
        """((_vm_key, n, _vm_result) of the distinct texts, all rows with a text)."""
        from ..session import materialize
        counted = texts.select(F.col(text_col).alias("_vm_text")).filter("_vm_text is not null").groupBy("_vm_text").agg(F.count("*").alias("_vm_n"))
        scored = self.scorer.score(counted, "_vm_text", "_vm_result")
        table = materialize(scored.select(F.unhex(F.sha2("_vm_text", 256)).alias("_vm_key"), "_vm_n", "_vm_result"), "distinct-scores")
        return table, table.agg(F.sum("_vm_n")).first()[0] or 0

    def score(self, df: DataFrame, text_col: str, out: str = "sentiment") -> DataFrame:
        table, n = self.results(df, text_col)
        often = F.col("_vm_n") >= max(2.0, self.hot_share * n)
        hot = table.filter(often).select(F.col("_vm_key"), F.col("_vm_result").alias("_vm_hot"))
        rest = table.filter(~often).select(F.col("_vm_key").alias("_vm_far"), F.col("_vm_result").alias("_vm_cold"))
        keyed = df.withColumn("_vm_key", F.unhex(F.sha2(F.col(text_col), 256))).join(F.broadcast(hot), "_vm_key", "left")
        # rows that have their result get a key that no text has, each its own
        spread = F.encode(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")), "UTF-8")
        keyed = keyed.withColumn("_vm_far", F.when(F.col("_vm_hot").isNull() & F.col("_vm_key").isNotNull(), F.col("_vm_key")).otherwise(spread))
        return keyed.join(rest, "_vm_far", "left").withColumn(out, F.coalesce("_vm_hot", "_vm_cold")).drop(
            "_vm_key", "_vm_far", "_vm_hot", "_vm_cold")


class NeutralScorer:
    """X10 around any scorer: a label of less confidence than the threshold becomes Neutral, all else is kept."""

    def __init__(self, scorer, threshold: float = FV.NEUTRAL_THRESHOLD):
        self.scorer, self.threshold = scorer, threshold

    def score(self, df: DataFrame, text_col: str, out: str = "sentiment") -> DataFrame:
        return self.scorer.score(df, text_col, out).withColumn(out, apply_neutral_threshold(F.col(out), self.threshold))
