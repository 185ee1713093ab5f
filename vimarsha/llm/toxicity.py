"""Toxicity by maximum-scoring segment search.

Token scores: log-odds of toxic against clean labelled texts with an informative Dirichlet prior (the tokens'
shares of all labelled texts); a token whose log-odds stand ``Z`` standard deviations above zero scores their lower bound,
any other token costs ``DRIFT``. In a text, the linear-time scan for all maximal scoring segments gives
the passages; extreme-value statistics of the clean texts turn a passage's score S in n tokens into
lambda * S - log(K * n), and those with an expected count under ``EXPECT`` are significant. A text's
evidence is their sum; a logistic curve of it, fitted on a histogram of all training texts, is the score.

Counts and calibration cover every labelled training row; exact copies of a text count once. The model holds
significant tokens only: chance adds a few in a hundred thousand of the vocabulary.
Scoring is one pass without a shuffle. Labels, language, source and ids are never inputs of a score.

Defined cases: a NULL or empty text has no tokens and no passage; rows with a NULL label are not learned
from; without rows of both classes no token is significant and every score is the share of toxic rows (0 if
there is none); ties in a text go to the leftmost segment; repeated rows get equal scores; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import saved
from .nbsvm import logistic

Z = 4.0
DRIFT = 0.05
PRIOR = 0.02            # the prior's weight as a share of all counted tokens
EXPECT = 0.05
_BIN = 0.25             # width of the calibration's histogram
_TOP = 50.0             # evidence above it makes no difference


def maximal_segments(places: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last place, score) of a sequence in which ``places`` (ascending)
    have positive ``scores`` and every other place costs ``drift``: the linear-time algorithm of Ruzzo and
    Tompa over the positive places, the gaps between them taken in one step."""
    done: list[list] = []            # [left sum, right sum, first, last, previous with a lower left sum]
    total, last = 0.0, -1
    for p, s in zip(places.tolist(), scores.tolist()):
        total -= drift * (p - last - 1)
        left, total, last = total, total + s, p
        piece = [left, total, p, p, -1]
        while True:
            j = len(done) - 1
            while j >= 0 and done[j][0] >= piece[0]:
                j = done[j][4]
            if j < 0 or done[j][1] >= piece[1]:
                piece[4] = j
                done.append(piece)
                break
            piece = [done[j][0], piece[1], done[j][2], piece[3], -1]
            del done[j:]
    return [(a, b, r - x) for x, r, a, b, _ in done]


@dataclass
class Model:
    hashes: np.ndarray       # sorted token hashes
    scores: np.ndarray
    drift: float
    scale: float = 1.0       # lambda of the extreme-value law
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -30.0

    def segments(self, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
        """(row, tokens, segments) of every text, in order."""
        for w in tv.words(texts, gaps=tv.SIGNS):
            place = np.minimum(np.searchsorted(self.hashes, w.hashes), max(0, len(self.hashes) - 1))
            hit = np.flatnonzero(self.hashes[place] == w.hashes) if len(self.hashes) else np.zeros(0, np.int64)
            bounds = np.searchsorted(hit, w.bounds)
            for i in range(len(w.bounds) - 1):
                a, b = bounds[i], bounds[i + 1]
                at = hit[a:b]
                found = maximal_segments(at - w.bounds[i], self.scores[place[at]], self.drift) if b > a else []
                yield w.first + i, int(w.bounds[i + 1] - w.bounds[i]), found

    def passages(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Significant segments with their normalised scores."""
        level = self.log_k + np.log(max(n, 1))
        least = -np.log(EXPECT)
        return [(a, b, self.scale * s - level) for a, b, s in found if self.scale * s - level > least]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -30, 30)))


def _odds(counts: DataFrame, n1: int, n0: int, z: float, prior: float) -> DataFrame:
    """(h, score) of the tokens of (h, toxic, clean) whose log-odds are significant."""
    mass = prior * (n1 + n0)
    a = (F.col("toxic") + F.col("clean")) * prior
    y1, y0 = F.col("toxic") + a, F.col("clean") + a
    odds = F.log(y1 / (n1 + mass - y1)) - F.log(y0 / (n0 + mass - y0))
    return counts.withColumn("odds", odds).withColumn("sd", F.sqrt(1 / y1 + 1 / y0)).filter(F.col("odds") > z * F.col("sd")).select(
        "h", (F.col("odds") - F.col("sd")).alias("score"))


def _table(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = found.toArrow()
    h, s = table.column("h").to_numpy().view(np.uint64), table.column("score").to_numpy()
    order = np.argsort(h)
    return h[order], s[order]


def token_scores(rows: DataFrame, z: float = Z, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and scores of significant tokens of rows (text, label): first by the texts that hold a token, then,
    for those found, by its distinct contexts (the words beside it), so that near copies of a toxic text
    do not vouch for its harmless words."""
    def texts_of(batches):
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for w in tv.words(b.column(0), gaps=tv.SIGNS):
                doc, h = tv.distinct(w.doc_of(), w.hashes)
                for c in (0, 1):
                    u, n = np.unique(h[label[w.first:w.first + len(w.bounds) - 1][doc] == c], return_counts=True)
                    zero = np.zeros(len(u), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n if c else zero), pa.array(zero if c else n)],
                                                     ["h", "toxic", "clean"])
    counts = saved(rows.mapInArrow(texts_of, "h long, toxic long, clean long").groupBy("h").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "token-counts")
    n1, n0 = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not n1 or not n0:
        return np.zeros(0, np.uint64), np.zeros(0)
    known = _table(_odds(counts, n1, n0, z, prior))[0]
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def contexts(batches):
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for w in tv.words(b.column(0), gaps=tv.SIGNS):
                doc, h = w.doc_of(), w.hashes
                at = np.flatnonzero(np.isin(h, shared.value))
                before = np.where(at > w.bounds[doc[at]], h[np.maximum(at - 1, 0)], 0)
                after = np.where(at + 1 < w.bounds[doc[at] + 1], h[np.minimum(at + 1, len(h) - 1)], 0) if len(h) else before
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[at].view(np.int64)), pa.array(tv.mix(before + tv.mix(after)).view(np.int64)),
                    pa.array(label[w.first + doc[at]].astype(np.int32))], ["h", "context", "label"])
    seen = rows.mapInArrow(contexts, "h long, context long, label int").distinct().groupBy("h").agg(
        F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))
    return _table(_odds(seen, n1, n0, z, prior))


def _law(model: Model, rows: DataFrame) -> tuple[float, float]:
    """lambda and log K from the clean texts: lambda solves E[exp(lambda * score)] = 1 over their tokens, K
    makes the expected number of top segments fit their count."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tokens, hits = 0, np.zeros(len(shared.value.hashes), np.int64)
        for b in batches:
            for w in tv.words(b.column(0), gaps=tv.SIGNS):
                tokens += len(w.hashes)
                place = np.minimum(np.searchsorted(shared.value.hashes, w.hashes), max(0, len(hits) - 1))
                if len(hits):
                    hits += np.bincount(place[shared.value.hashes[place] == w.hashes], minlength=len(hits))
        at = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(hits[at], tokens))], ["i", "n"])
    table = rows.filter("label = 0").select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(table.column("i").to_pylist(), table.column("n").to_pylist()))
    total = max(1, n.pop(-1, 0))
    # half a count for tokens that no clean text holds, spread over all of them
    p = np.full(len(model.scores), 0.5 / max(1, len(model.scores)) / total)
    for i, c in n.items():
        p[i] = c / total
    rest = 1 - p.sum()
    lo, hi = 1e-6, 1.0
    f = lambda x: (p * np.exp(np.minimum(x * model.scores, 600))).sum() + rest * np.exp(-x * model.drift) - 1
    while f(hi) < 0 and hi < 1e3:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    # renewal form of K for rare positive steps: rate of excursions times their mean weight
    return lo, float(np.log(max(1e-12, (p * np.exp(np.minimum(lo * model.scores, 600))).sum())))


def evidence(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns with ``evidence`` and ``n_passages``. The text comes last."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes) + ", evidence double, n_passages int"

    def run(batches):
        m = shared.value
        for b in batches:
            found = [m.passages(n, s) for _, n, s in m.segments(b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [
                pa.array([sum(x[2] for x in f) for f in found], pa.float64()), pa.array([len(f) for f in found], pa.int32())],
                [*keep, "evidence", "n_passages"])
    return rows.select(*keep, "text").mapInArrow(run, schema)


def fit(rows: DataFrame, z: float = Z, drift: float = DRIFT) -> Model:
    """Fits on labelled rows (text, label 0 or 1)."""
    labelled = rows.select("text", F.col("label").cast("int").alias("label"), F.xxhash64("text", "label").alias("h")).filter(
        "label in (0, 1) and text is not null")
    rows = saved(labelled.dropDuplicates(["h"]), "labelled")
    model = Model(*token_scores(rows, z), drift)
    if len(model.hashes):
        model.scale, model.log_k = _law(model, rows)
    bins = evidence(rows, model, ["label"]).groupBy("label", F.round(F.col("evidence") / _BIN).cast("long").alias("bin")).count().toArrow()
    y = np.where(bins.column("label").to_numpy() == 1, 1.0, -1.0)
    if len(np.unique(y)) < 2:
        model.offset = 30.0 if len(y) and y[0] > 0 else -30.0
        return model
    model.slope, model.offset = logistic(np.minimum(bins.column("bin").to_numpy() * _BIN, _TOP), y, bins.column("count").to_numpy())
    return model


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, n_passages) for every row."""
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text}`"].alias("text"))
    out = evidence(rows, model, ["id"])
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), model.slope * F.least("evidence", F.lit(_TOP)) + model.offset))))
    return out.select(F.col("id").alias(id_col), score.alias("score"), "n_passages")


def toxic_passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each significant passage: id, first and last token, normalised score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            rows = [(i, *x) for i, n, s in m.segments(b.column(1)) for x in m.passages(n, s)]
            if rows:
                i, first, last, score = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(first, pa.int32()), pa.array(last, pa.int32()),
                                                  pa.array(score, pa.float64())], [id_col, "first_token", "last_token", "score"])
    return docs.select(docs[f"`{id_col}`"].cast("long"), docs[f"`{text}`"]).mapInArrow(
        run, f"`{id_col}` long, first_token int, last_token int, score double")
