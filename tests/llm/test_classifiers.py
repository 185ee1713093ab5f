import random

import numpy as np
import pyarrow as pa
import pytest

from vimarsha.llm import nbsvm, toxicity


def test_dual_coordinate_descent_reaches_the_optimum():
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) + .3 * r.normal(size=80) > 0, 1.0, -1.0)
    bounds, f, v = np.arange(0, 401, 5), np.tile(np.arange(5), 80), x.ravel()
    w, b = nbsvm.descend(bounds, f, v, y, 5, cost=1.0, epochs=400)
    upper = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    primal = lambda w, b: .5 * (w @ w + b * b) + (upper * np.maximum(0, 1 - y * (x @ w + b))).sum()
    best = primal(w, b)
    for _ in range(300):
        assert primal(w + .05 * r.normal(size=5), b + .05 * r.normal()) >= best - 1e-3


def test_log_ratios_and_logistic():
    r = nbsvm.log_ratios(np.array([3.0, 0, 0]), np.array([0.0, 1, 0]))
    assert r[0] > 0 > r[1] and r[2] == 0
    assert np.isclose(r[0], np.log(4 / 6) - np.log(1 / 4))
    m = np.array([-3.0, -2, 2, 3, -2.5, 2.5] * 40)
    a, c = nbsvm.logistic(m, np.sign(m))
    assert a > 0 and 1 / (1 + np.exp(-(a * 2 + c))) > .9


def reviews(seed, n, bad=("rubbish", "awful")):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(20, 60))]
        label = int(r.random() < .3)
        if label:
            for _ in range(r.randint(1, 3)):
                t.insert(r.randrange(len(t)), r.choice(bad))
        out.append((i, " ".join(t), label))
    return out


def test_quality_classifier_on_held_out_texts_and_edge_cases(spark):
    rows = reviews(1, 600)
    df = spark.createDataFrame([(i, t, 1 - y) for i, t, y in rows] + [(None, None, 1), (9999, "x", None)], "key long, text string, label int")
    model = nbsvm.fit(df)
    test = reviews(2, 200)
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in test] + [(None, None, "z"), (500, "", None)], "doc_id long, text string, SCORE string")
    got = nbsvm.score_documents(docs, model).collect()
    assert len(got) == 202 and all(0 <= x.score <= 1 for x in got)
    score = {x.doc_id: x.score for x in got}
    assert score[None] == score[500]
    assert np.mean([(score[i] >= .5) == (y == 0) for i, _, y in test]) > .95


def test_quality_classifier_without_two_classes(spark):
    none = nbsvm.fit(spark.createDataFrame([], "key long, text string, label int"))
    one = nbsvm.fit(spark.createDataFrame([(1, "a b", 1)], "key long, text string, label int"))
    assert none.score(pa.array(["a", None]))[0] == pytest.approx(.5) and one.score(pa.array(["a"]))[0] > .99
    assert nbsvm.score_documents(spark.createDataFrame([], "doc_id long, text string"), one).count() == 0


def brute_segments(scores):
    """All maximal scoring segments by the definition: recursively the leftmost longest best one, then both sides."""
    n = len(scores)
    best = None
    for a in range(n):
        for b in range(a, n):
            s = sum(scores[a:b + 1])
            if s > 1e-9 and (best is None or s > best[0] + 1e-9 or abs(s - best[0]) < 1e-9 and b - a < best[2] - best[1]):
                best = (s, a, b)
    if best is None:
        return []
    s, a, b = best
    return brute_segments(scores[:a]) + [(a, b, s)] + [(x + b + 1, y + b + 1, z) for x, y, z in brute_segments(scores[b + 1:])]


def test_maximal_segments_equal_the_definition():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(0, 14)
        scores = [r.choice([-1.0, -1.0, -1.0, r.uniform(.1, 4)]) for _ in range(n)]
        at = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(np.array(at, int), np.array([scores[i] for i in at]), 1.0)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity_on_held_out_texts_and_edge_cases(spark):
    rows = reviews(4, 900)
    copies = [(5000 + i, "harmless copied words of one toxic text rubbish", 1) for i in range(30)]
    df = spark.createDataFrame([(t, y) for _, t, y in rows + copies] + [(None, 1), ("x", None)], "text string, label int")
    model = toxicity.fit(df)
    known = {int(h) for h in model.hashes}
    from vimarsha.llm import textvec as tv
    word = lambda x: int(next(tv.words(pa.array([x]), gaps=tv.SIGNS)).hashes[0])
    assert word("rubbish") in known and word("awful") in known and word("harmless") not in known
    test = reviews(5, 200)
    docs = spark.createDataFrame([(i, t + ".") for i, t, _ in test] + [(None, None), (500, ""), (501, "so AWFUL, rubbish!")], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.score_documents(docs, model).collect()}
    assert got[None].n_passages == 0 and got[None].score < .5 and got[501].score >= .5
    assert np.mean([(got[i].score >= .5) == (y == 1) for i, _, y in test]) > .97
    spans = toxicity.toxic_passages(docs.filter("doc_id = 501"), model).collect()
    assert [(x.first_token, x.last_token) for x in spans] == [(1, 2)]


def test_toxicity_without_two_classes(spark):
    for rows, want in (([], 0), ([("a b", 0)], 0), ([("a b", 1)], 1)):
        model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
        docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
        assert round(toxicity.score_documents(docs, model).first().score) == want
