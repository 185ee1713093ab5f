"""URL filter: domain and path rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host, which also covers its subdomains, and the start of a path; the longest rule that fits
decides. URLs that no rule fits are judged by a gradient-boosted classifier trained from labelled URLs: length,
depth, digit ratio, character entropy, parameter counts and statistics of the host's suffixes, which are smoothed
shares of allowed URLs computed over all labelled rows. A URL's own suffix statistics in training leave its own
label out, so that a suffix seen once cannot tell it.

The rules are a fixed list of literals in one projection; the trees are fitted by Spark on a bounded sample of the
labelled rows chosen by a hash of the URL. Suffix statistics are a table joined by suffix, one row for each.

Defined cases: a NULL URL or one without ``://`` has an empty host and path and no rule; extra white space is part of
the URL; ties between rules of one length cannot occur, as two rules of one length that fit are equal; repeated rows
are judged alike; without labelled rows of both classes every URL gets the only class there is (allow
if there is none); an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small

#: Labelled rows that the trees are fitted on, chosen by the hash of the URL.
FIT_ROWS = 50_000
TREES = 12
DEPTH = 3
#: Weight of the overall share in a suffix's smoothed share.
SMOOTHING = 5.0
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "letters_entropy", "host_entropy",
            "parameters", "query_length", "fragment", "hyphens", "dots", "percents", "extension", "secure",
            "suffix1", "suffix2", "suffix3", "suffix_rows"]


@dataclass(frozen=True)
class Rule:
    verdict: str             # allow or block
    rule: str                # host and path, such as example.org/en/

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return self.rule[len(self.host):]


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased), ``path`` and ``_tail`` (from ``?`` or ``#`` on)."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    df = df.withColumn("_rest", rest)
    # (?s): line breaks are characters of the URL like others
    host = F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1)
    return (df.withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            .withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1))
            .withColumn("_tail", F.regexp_extract("_rest", r"(?s)^[^?#]*(.*)$", 1)).drop("_rest"))


def fitting_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``, or NULLs."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.rule)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character of a string."""
    n = F.char_length(text).cast("double")
    share = lambda c: (F.char_length(text) - F.char_length(F.replace(text, c))) / n
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - F.when(
        (c != "") & (share(c) > 0), share(c) * F.log2(share(c))).otherwise(0.0))


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features and the host's last one, two and three labels; needs :func:`split_url`."""
    u = F.coalesce(F.col(url), F.lit(""))
    size = F.greatest(F.length(u), F.lit(1))
    parts = F.split("host", r"\.")
    query = F.regexp_extract("_tail", r"(?s)^\?([^#]*)", 1)
    last = lambda k: F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k), ".")
    number = {
        "length": F.length(u), "host_length": F.length("host"), "path_length": F.length("path"),
        "depth": F.regexp_count("path", F.lit("/[^/]")), "labels": F.size(parts),
        "digits": F.regexp_count(u, F.lit("[0-9]")) / size,
        "host_digits": F.regexp_count("host", F.lit("[0-9]")) / F.greatest(F.length("host"), F.lit(1)),
        "letters_entropy": _entropy(F.col("path")), "host_entropy": _entropy(F.col("host")),
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1), "query_length": F.length(query),
        "fragment": F.instr("_tail", "#") > 0, "hyphens": F.regexp_count(u, F.lit("[-_]")), "dots": F.regexp_count("path", F.lit(r"\.")),
        "percents": F.regexp_count(u, F.lit("%")), "extension": F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1) != "",
        "secure": F.lower(F.substring(u, 1, 8)) == "https://",
    }
    return df.withColumns({k: v.cast("double") for k, v in number.items()} | {f"_s{k}": last(k) for k in (1, 2, 3)})


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(k, suffix, rows, good): labelled rows and allowed ones by the last k labels of the host."""
    each = labelled.select("label", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(f"_s{k}").alias("suffix")) for k in (1, 2, 3)])).alias("s"))
    return each.groupBy("s.k", "s.suffix").agg(F.count("*").alias("rows"), F.sum("label").alias("good"))


def _with_suffixes(df: DataFrame, stats: DataFrame, share: float, own: Column) -> DataFrame:
    """Adds the suffix features; ``own`` is a row's own label if it is among the counted rows, else NULL."""
    stats = small(stats)
    out = df
    mine = F.when(own.isNull(), 0).otherwise(1)
    for k in (1, 2, 3):
        s = stats.filter(F.col("k") == k).select(F.col("suffix").alias(f"_s{k}"), F.col("rows").alias(f"_r{k}"), F.col("good").alias(f"_g{k}"))
        out = out.join(s, f"_s{k}", "left")
        rows = F.coalesce(f"_r{k}", F.lit(0)) - mine
        good = F.coalesce(f"_g{k}", F.lit(0)) - F.coalesce(own, F.lit(0))
        out = out.withColumn(f"suffix{k}", (good + SMOOTHING * share) / (rows + SMOOTHING))
        if k == 3:
            out = out.withColumn("suffix_rows", F.log1p(rows.cast("double")))
    return out


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", labels: DataFrame | None = None,
               fit_rows: int = FIT_ROWS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """The table with ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (share of trust of the trees; NULL
    where a rule decides) added.

    ``labels``: further labelled URLs (url, label 1 allow or 0 block). Without them the trees learn from the
    distinct URLs of the table that a rule decides.
    """
    clash = {"host", "path", "rule", "verdict", "score"}
    pages = pages.select(*[pages[f"`{c}`"] for c in pages.columns if c.lower() not in clash])
    columns = pages.columns
    rule, verdict = fitting_rule(rules)
    ruled = split_url(pages, url).withColumn("rule", rule).withColumn("_ruled", verdict)
    if labels is None:
        source = ruled.filter("_ruled is not null").select(F.col(url).alias("url"), (F.col("_ruled") == "allow").cast("int").alias("label"))
    else:
        source = labels.select("url", F.col("label").cast("int").alias("label")).filter("label in (0, 1)")
    labelled = saved(lexical(split_url(source.distinct(), "url"), "url"), "labelled-urls")
    size = {x["label"]: x["count"] for x in labelled.groupBy("label").count().collect()}
    if len(size) < 2:
        known = "block" if 0 in size else "allow"
        return ruled.select(*columns, "host", "path", "rule", F.coalesce("_ruled", F.lit(known)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    total = sum(size.values())
    share = size[1] / total
    stats = saved(suffix_statistics(labelled), "suffixes")
    keep = min(1.0, fit_rows / total)
    sample = labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1_000_000 * keep))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = saved(assembler.transform(_with_suffixes(sample, stats, share, F.col("label"))).select(
        F.col("label").cast("double").alias("label"), "features"), "url-vectors").coalesce(4)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=7).fit(rows)
    # the trees judge each distinct URL that no rule fits
    ask = ruled.filter("_ruled is null").select(F.col(url).alias("url")).distinct()
    judged = model.transform(assembler.transform(_with_suffixes(lexical(split_url(ask, "url"), "url"), stats, share, F.lit(None).cast("int"))))
    scores = saved(judged.select(F.col("url").alias("_url"), vector_to_array("probability")[1].alias("score")), "url-scores")
    open_rows = ruled.filter("_ruled is null").join(scores, ruled[f"`{url}`"].eqNullSafe(scores["_url"]), "left").select(
        *[ruled[f"`{c}`"] for c in columns], "host", "path", "rule",
        F.when(scores["score"] >= 0.5, "allow").otherwise("block").alias("verdict"), scores["score"].alias("score"))
    return ruled.filter("_ruled is not null").select(
        *columns, "host", "path", "rule", F.col("_ruled").alias("verdict"), F.lit(None).cast("double").alias("score")).union(open_rows)
