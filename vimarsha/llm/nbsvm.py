"""Quality classifier: naive Bayes features in a linear support vector machine (NB-SVM).

Features are indicators of hashed word unigrams, word bigrams, word shapes and words said twice or thrice in a
row in a whole text. Their class
counts over all labelled training rows are summed by Spark; a feature's log-count ratio scales its
indicator. A linear hinge-loss model is then fitted by dual coordinate descent on a bounded sample of the
labelled rows, and its margins are turned into probabilities by a logistic curve fitted on the same rows out of
their fold. Scoring is one pass over the table without a shuffle; the model is an array of fixed size.

Labels, language, source and ids are never features. Defined cases: a NULL or empty text has no features and
gets the score of the bare intercept; rows with a NULL label are not learned from; a labelled id that repeats
counts as often as it occurs; without rows of both classes every score is the share of label 1 (0.5 if there is
none); repeated rows get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import crc32_text, saved

#: The model has 2 ** FEATURE_BITS weights (4 bytes each).
FEATURE_BITS = 18
#: Rows of the fit by dual coordinate descent: those whose key hashes lowest.
FIT_ROWS = 8_000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12


def _shapes() -> np.ndarray:
    """Class of a byte: lower, upper, digit, ASCII sign by itself, or a byte of a longer character."""
    out = np.arange(256, dtype=np.uint64) + np.uint64(1000)
    out[ord("a"):ord("z") + 1] = 1
    out[ord("A"):ord("Z") + 1] = 2
    out[ord("0"):ord("9") + 1] = 3
    out[128:] = 1
    return out


_SHAPE = tv.mix(_shapes())


def features(texts: pa.Array, bits: int = FEATURE_BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each feature, feature) of chunks: distinct features by row."""
    for w in tv.words(texts, lower=False):
        doc = w.doc_of()
        lower = tv._LOWER[w.data]
        one = tv.run_hashes(tv._byte_values()[lower], w.starts, w.ends)
        two = tv.combine(one, 2)
        same = doc[1:] == doc[:-1] if len(doc) > 1 else np.zeros(0, bool)
        # the word's last two bytes and its first, by class: capitals, digits and signs that stick to words
        head, last = _SHAPE[w.data[w.starts]], _SHAPE[w.data[w.ends - 1]]
        prior = _SHAPE[w.data[np.maximum(w.ends - 2, w.starts)]]
        shape = tv.mix(head + last * np.uint64(3) + prior * np.uint64(7))
        # a word said twice in a row, by how often the run goes on
        again = np.flatnonzero(same & (one[1:] == one[:-1]))
        run = again[1:][np.diff(again) == 1] if len(again) else again
        d = np.concatenate([doc, doc[:-1][same], doc, doc[again], doc[run]])
        h = np.concatenate([one, two[same] + np.uint64(1), shape + np.uint64(2), np.full(len(again), 3, np.uint64), np.full(len(run), 4, np.uint64)])
        order = np.argsort(d, kind="stable")
        d, f = tv.distinct(d[order], tv.mix(h[order]) >> np.uint64(64 - bits))
        yield w.first, len(w.bounds) - 1, d, f.astype(np.int64)


def class_counts(rows: DataFrame, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of label 1 and of label 0 that have each feature, over all rows (text, label)."""
    def run(batches):
        total = np.zeros((2, 1 << bits), np.int64)
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for first, n, d, f in features(b.column(0), bits):
                y = label[first:first + n][d]
                for c in (0, 1):
                    total[c] += np.bincount(f[y == c], minlength=1 << bits)
        at = np.flatnonzero(total.sum(0))
        for i in range(0, len(at), 1 << 16):
            x = at[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(total[1][x]), pa.array(total[0][x])], ["f", "pos", "neg"])
    summed = rows.mapInArrow(run, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    table = summed.toArrow()                # at most 2 ** bits rows
    at = table.column("f").to_numpy()
    pos, neg = np.zeros(1 << bits), np.zeros(1 << bits)
    pos[at], neg[at] = table.column("pos").to_numpy(), table.column("neg").to_numpy()
    return pos, neg


def log_ratios(pos: np.ndarray, neg: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of smoothed counts; 0 for a feature that never occurs."""
    p, q = pos + smoothing, neg + smoothing
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[pos + neg == 0] = 0
    return r


def _vectors(texts: pa.Array, ratios: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, features and values of unit vectors, one for each text."""
    bounds, fs, vs = [np.zeros(1, np.int64)], [], []
    for _, n, d, f in features(texts, bits):
        v = ratios[f]
        norm = np.sqrt(tv.sums(v * v, d, n))
        bounds.append(bounds[-1][-1] + np.searchsorted(d, np.arange(1, n + 1)))
        fs.append(f)
        vs.append(v / np.maximum(norm[d], 1e-12))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return np.concatenate(bounds), join(fs, np.int64), join(vs, float)


def descend(bounds: np.ndarray, f: np.ndarray, v: np.ndarray, y: np.ndarray, size: int, cost: float = COST,
            epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-loss linear SVM by dual coordinate descent; both classes weigh alike."""
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    share = np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())])
    upper = np.where(y > 0, cost * len(y) / (2 * share[1]), cost * len(y) / (2 * share[0]))
    square = np.add.reduceat(np.append(v * v, 0), np.minimum(bounds[:-1], len(v))) * (np.diff(bounds) > 0) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)).tolist():
            x, z = f[bounds[i]:bounds[i + 1]], v[bounds[i]:bounds[i + 1]]
            gradient = y[i] * (w[x] @ z + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[x] += step * z
                b += step
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, b


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 100) -> tuple[float, float]:
    """(a, c) of 1 / (1 + exp(-(a * margin + c))) by damped Newton steps on smoothed targets (Platt)."""
    weight = np.ones(len(y)) if weight is None else weight.astype(float)
    n1, n0 = weight[y > 0].sum(), weight[y < 0].sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, float(np.sqrt((weight * margin ** 2).sum() / max(1e-9, weight.sum()))))
    x = np.stack([margin / scale, np.ones(len(y))])

    def loss(at: np.ndarray) -> float:
        m = at @ x
        return float((weight * (np.logaddexp(0, m) - t * m)).sum())
    at, now = np.zeros(2), loss(np.zeros(2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + 1e-9 * np.eye(2), x @ (weight * (p - t)))
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > now:
            size /= 2
        at = at - size * step
        now, before = loss(at), now
        if before - now < 1e-9 * max(1.0, before):
            break
    return float(at[0] / scale), float(at[1])


@dataclass
class Model:
    """Score of a text: logistic(slope * (weights . features / norm + intercept) + offset)."""
    ratios: np.ndarray       # float32
    weights: np.ndarray      # float32, by feature, ratios multiplied in
    intercept: float
    slope: float
    offset: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out, bits = [np.zeros(0)], int(np.log2(len(self.weights)))
        for _, n, d, f in features(texts, bits):
            r = self.ratios[f].astype(float)
            norm = np.sqrt(np.maximum(tv.sums(r * r, d, n), 0))
            m = tv.sums(self.weights[f].astype(float), d, n) / np.maximum(norm, 1e-12) + self.intercept
            out.append(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))))
        return np.concatenate(out)


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, bits: int = FEATURE_BITS) -> Model:
    """Fits on labelled rows (key, text, label 0 or 1)."""
    rows = saved(rows.select("key", "text", F.col("label").cast("int").alias("label")).filter("label in (0, 1)"), "labelled")
    pos, neg = class_counts(rows.select("text", "label"), bits)
    ratios = log_ratios(pos, neg)
    size = {x["label"]: x["count"] for x in rows.groupBy("label").count().collect()}
    if len(size) < 2:
        share = 0.5 if not size else float(1 in size)
        return Model(np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32), 0.0, 0.0, float(np.clip(30 * (2 * share - 1), -30, 30)))
    # a bounded sample, chosen by key alone: the same at every run
    keep = min(1.0, fit_rows / sum(size.values()))
    hashed = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    sample = rows.filter(hashed < int(1_000_000 * keep)).select("text", "label", hashed.alias("fold")).toArrow()
    bounds, f, v = _vectors(sample.column("text").combine_chunks(), ratios, bits)
    y = np.where(sample.column("label").to_numpy() == 1, 1.0, -1.0)
    fold = sample.column("fold").to_numpy() % 2 == 0
    margin = np.zeros(len(y))
    for out in (fold, ~fold):               # margins of rows that the fit has not seen
        if len(np.unique(y[~out])) < 2 or not out.any():
            continue
        w, b = descend(*_rows(bounds, f, v, ~out), y[~out], 1 << bits)
        at, g, z = _rows(bounds, f, v, out)
        margin[out] = tv.sums(w[g] * z, np.repeat(np.arange(len(at) - 1), np.diff(at)), len(at) - 1) + b
    slope, offset = logistic(margin, y)
    w, b = descend(bounds, f, v, y, 1 << bits)
    return Model(ratios.astype(np.float32), (w * ratios).astype(np.float32), float(b), slope, offset)


def _rows(bounds: np.ndarray, f: np.ndarray, v: np.ndarray, keep: np.ndarray):
    count = np.diff(bounds)
    mask = np.repeat(keep, count)
    return np.concatenate([[0], np.cumsum(count[keep])]), f[mask], v[mask]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1)))], [id_col, "score"])
    return docs.select(docs[f"`{id_col}`"].cast("long"), docs[f"`{text}`"]).mapInArrow(run, f"`{id_col}` long, score double")


def fold(column: Column | str, parts: int, which: int) -> Column:
    """Whether an id falls into a fold by the CRC-32 of its decimal text; a NULL id does not."""
    return F.coalesce(crc32_text(column) % parts == which, F.lit(False))
