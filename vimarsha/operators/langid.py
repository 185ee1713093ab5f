"""A language-ID signal learned from a labelled table (character n-gram naive Bayes).

Fit: n-grams of every text (``char_wb``, 1-3 by default) counted per language -- one
aggregation; the profile holds one row per n-gram with its weights of all languages in an array.
Score: each row's n-grams meet the profile (broadcast where its counted rows are few, else by a join of the counts per
row and n-gram) and are summed per row for all languages at a time:

    score(row, lang) = log prior(lang) + sum_g count(g) * log(c_lang(g) + 1) - N_row * log(T_lang + V)

which is the Laplace-smoothed log likelihood with unseen n-grams folded into the last term.
Catalyst chooses the join by size; AQE splits frequent n-grams. The per-row softmax runs over at
most |languages| values. The output plugs into ``detect_language`` through
``langid=(lang_col, prob_col)``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage


@dataclass
class LangIdModel:
    profile: DataFrame            # (gram, weights: array of log(count + 1) in the order of languages)
    languages: list[tuple[str, float, float]]  # (lang, log_prior, log_denominator) -- |languages| rows
    n_min: int
    n_max: int
    n_grams: int | None = None    # rows of the profile, where they were counted


#: A profile of so many counted rows at most (a gram and one weight per language each) is broadcast.
BROADCAST_GRAMS = 200_000


def ngram_counts(df: DataFrame, text: str, lang: str, n_min: int = 1, n_max: int = 3) -> DataFrame:
    """(lang, gram, n): n-gram frequencies per language. An n-gram lies inside one word, so the words of a language are counted
    first and each distinct one is cut once."""
    words = X.explode_rows(df, X.split_ws(X.py_strip(F.lower(text))), "_vm_word", lang).filter("_vm_word <> ''")
    counted = words.groupBy(lang, "_vm_word").agg(F.count("*").alias("_vm_n"))
    padded = F.concat(F.lit(" "), F.col("_vm_word"), F.lit(" "))
    g = X.explode_rows(counted, X.padded_ngrams(padded, n_min, n_max), "gram", lang, "_vm_n")
    return g.groupBy(lang, "gram").agg(F.sum("_vm_n").alias("n"))


def fit_langid(df: DataFrame, text: str = "text", lang: str = "lang", n_min: int = 1, n_max: int = 3) -> LangIdModel:
    known = df.filter(F.col(lang).isNotNull())
    counts = cut_lineage(ngram_counts(known, text, lang, n_min, n_max))
    vocab = counts.select("gram").distinct().count()
    per_lang = counts.groupBy(lang).agg(F.sum("n").alias("t"))
    docs = known.groupBy(lang).agg(F.count("*").alias("d"))
    # one row per language: a model parameter, not row data
    stats = per_lang.join(docs, lang).collect()
    n_docs = sum(r["d"] for r in stats)
    languages = sorted((r[lang], math.log(r["d"] / n_docs), math.log(r["t"] + vocab)) for r in stats)
    weight = lambda l: F.log(F.sum(F.when(F.col(lang) == l, F.col("n")).otherwise(0)) + 1.0)
    profile = counts.groupBy("gram").agg(F.array(*[weight(l) for l, _, _ in languages]).alias("weights"))
    return LangIdModel(profile, languages, n_min, n_max, vocab)


def langid_scores(df: DataFrame, key: str, model: LangIdModel, text: str = "text",
                  out_lang: str = "langid_lang", out_prob: str = "langid_prob") -> DataFrame:
    """Adds the top language (ties: the first by name) and its probability to every row; a row without text gets NULL."""
    grams = X.explode_rows(df.select(key, X.char_wb_ngrams(text, model.n_min, model.n_max).alias("_g")), F.col("_g"), "gram", key)
    if model.n_grams is not None and model.n_grams <= BROADCAST_GRAMS:
        # nothing but the sums of a row leaves the task that reads it
        per_gram, profile = grams.withColumn("_c", F.lit(1)), F.broadcast(model.profile)
    else:
        per_gram, profile = grams.groupBy(key, "gram").agg(F.count("*").alias("_c")), model.profile
    matched = per_gram.join(profile, "gram", "left").groupBy(key).agg(
        F.sum("_c").alias("_N"), *[F.sum(F.col("_c") * F.coalesce(F.col("weights")[i], F.lit(0.0))).alias(f"_m{i}")
                                   for i in range(len(model.languages))])
    scores = F.array(*[F.lit(prior) + F.col(f"_m{i}") - F.col("_N") * F.lit(den) for i, (_, prior, den) in enumerate(model.languages)])
    names = F.array(*[F.lit(l) for l, _, _ in model.languages])
    scored = matched.select(key, scores.alias("_s"))
    top = F.array_max("_s")
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    res = scored.select(key, F.element_at(names, F.array_position("_s", top).cast("int")).alias(out_lang), (1.0 / total).alias(out_prob))
    return df.join(res, key, "left")
