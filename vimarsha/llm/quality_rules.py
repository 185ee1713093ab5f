"""Quality rules as a short-circuit cascade.

A rule rejects a document by a predicate over a few columns. The rules' costs and rejection shares are
estimated on a bounded sample of the table, then the rules run in the order of rejections per cost, each
only on the documents that all earlier ones let pass (``CASE WHEN`` branches in one narrow projection, no
shuffle). The order changes the time, never the verdict.

Defined cases: a NULL or blank text has no words and fails the base rule; NULLs in other columns and
extra columns pass through; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, words

#: Rows of the sample on which costs and rejections are estimated.
SAMPLE_ROWS = 400
SYMBOLS = "#*$%&|<>"
#: Up to so many recurring windows are looked up one by one, more by sorting all windows; same result.
FEW = 200


@dataclass(frozen=True)
class Rule:
    """``rejects`` may use the text and the base columns of :func:`base_features`."""
    name: str
    rejects: Column


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the base rule and the query report:

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_lines`` (lines with a word),
    ``n_dup_lines`` (those equal to an earlier one), ``n_repeat_words`` (words inside 3-word windows that
    occur twice or more in the text) and ``base_failed``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w, h, s = F.col("_words"), F.col("_windows"), F.col("_sorted")
    df = docs.withColumn("_words", words(text))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = df.withColumn("_windows", F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    # hashes of windows that recur; only texts that have some look for their places
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)))
    df = df.withColumn("_twice", F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
    at = F.sequence(F.lit(0), F.size(h) - 1)
    df = df.withColumn("_pairs", F.when(F.size("_twice") > FEW, F.array_sort(F.arrays_zip(h.alias("h"), at.alias("at")))))
    z = F.col("_pairs")
    df = df.withColumn("_places", F.when(F.size("_twice") <= FEW, F.filter(
        at, lambda i: F.array_contains(F.col("_twice"), F.get(h, i)))).otherwise(F.sort_array(F.transform(F.filter(
            z, lambda x, i: (F.coalesce(x["h"] == F.get(z, i - 1)["h"], F.lit(False))
                             | F.coalesce(x["h"] == F.get(z, i + 1)["h"], F.lit(False)))), lambda x: x["at"]))))
    p = F.col("_places")
    # a recurring window covers three words, fewer if the next one starts inside it
    covered = F.coalesce(F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct(
        (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"]), F.lit(0))
    df = (df.withColumn("n_words", F.size(w).cast("long"))
          .withColumn("word_chars", F.char_length(F.array_join(w, "")).cast("long"))
          .withColumn("n_symbols", F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"))
          .withColumn("n_lines", F.size("_lines").cast("long"))
          .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
          .withColumn("n_repeat_words", covered.cast("long")))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.drop("_words", "_lines", "_windows", "_sorted", "_twice", "_pairs", "_places")


def default_rules(text: str = "text") -> list[Rule]:
    """Web-text rules in the style of published corpus filters; thresholds in whole numbers."""
    n, t = F.col("n_words"), F.col(text)
    return [
        Rule("mean_word_length", (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 14 * n)),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("shouting", t.contains("!!") & (10 * F.regexp_count(t, F.lit(r"!!(?=[\x20\x09-\x0D]|$)")) > n)),
        Rule("capitals", 2 * F.regexp_count(t, F.lit(r"\p{Lu}")) > F.col("word_chars")),
        Rule("ellipsis_lines", (t.contains("...") | t.contains("…")) & (10 * F.regexp_count(
            t, F.lit(r"(?:\.\.\.|…)[\x20\x09\x0B-\x0D]*(?:\n|$)")) > 3 * F.col("n_lines"))),
        Rule("bullet_lines", 10 * F.regexp_count(
            F.concat(F.lit("\n"), t), F.lit(r"\n[\x20\x09\x0B-\x0D]*[-*•]")) > 9 * F.col("n_lines")),
        Rule("digits", 5 * F.regexp_count(t, F.lit("[0-9]")) > F.col("word_chars")),
        Rule("placeholder", F.lower(t).contains("lorem ipsum")),
        Rule("braces", t.contains("{") & (10 * F.regexp_count(t, F.lit("[{}]")) > n)),
    ]


def rule_costs(sample: DataFrame, rules: list[Rule], loops: int = 20) -> list[dict]:
    """Seconds and rejections of each rule on a small kept sample with the base columns.

    A predicate is evaluated ``loops`` times a row, so that its own time stands out from a job's; the time
    of a constant predicate is taken off."""
    def run(rejects: Column) -> tuple[float, int]:
        t0 = time.perf_counter()
        hits = sample.select(F.sum(F.aggregate(F.sequence(F.lit(1), F.lit(loops)), F.lit(0), lambda a, _: a + F.when(
            rejects, 1).otherwise(0))).alias("n")).first()["n"]
        return time.perf_counter() - t0, (hits or 0) // loops

    n = max(1, sample.count())
    run(F.lit(True))
    idle = run(F.lit(True))[0]
    out = []
    for rule in rules:
        took, hits = run(rule.rejects)
        out.append({"rule": rule.name, "cost": max(took - idle, 1e-3), "rejects": hits / n})
    return out


def order_rules(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per cost, highest first."""
    rows = docs.take(sample_rows)       # a bounded number of rows, from the first input splits only
    sample = base_features(docs.sparkSession.createDataFrame(rows, docs.schema), text).coalesce(1).cache()
    try:
        found = {x["rule"]: x["rejects"] / x["cost"] for x in rule_costs(sample, rules)}
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: (-found[r.name], r.name))


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None,
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The table with the base columns and ``kept`` added. A rule whose predicate is NULL does not reject."""
    clash = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    docs = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in clash])
    df = base_features(docs, text)
    rules = default_rules(text) if rules is None else rules
    kept = F.when(F.col("base_failed"), False)
    for rule in order_rules(docs, rules, text, sample_rows):
        kept = kept.when(F.coalesce(rule.rejects, F.lit(False)), False)
    return df.withColumn("kept", kept.otherwise(True))
