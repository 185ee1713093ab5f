import math
import random

import numpy as np
import pytest

from vimarsha.llm.topk import Shard, int_vectors, top_k


def brute(rows, k):
    whole = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [max(-(1 << 24), min(1 << 24, math.floor(1024 * x))) for x in v]
        whole[i] = min(whole.get(i, ints), ints)
    out = set()
    for q, a in whole.items():
        if q % 10 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q)
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def told(spark, rows, k, **sizes):
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "vec_id long, embedding array<float>, Embedding double")
    vectors = int_vectors(df).cache()
    got = top_k(vectors, vectors.filter("vec_id % 10 = 0"), k, **sizes).collect()
    return {tuple(r) for r in got}, len(got)


@pytest.mark.parametrize("sizes", [{}, {"cell_vectors": 30, "block_queries": 4}])
def test_equals_brute_force(spark, sizes):
    r = random.Random(11)
    centres = [[r.gauss(0, 0.2) for _ in range(9)] for _ in range(4)]
    rows = []
    for i in range(220):
        v = [x + r.gauss(0, 0.05) for x in r.choice(centres)] if i % 3 else [r.choice([0.0, 0.0, 0.25, -0.25]) for _ in range(9)]
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(900, None), (None, [1.0] * 9), (901, [None] + [0.5] * 8), (902, [float("nan")] * 9), (903, [float("inf")] + [0.0] * 8)]
    rows += [(910, []), (911, [0.5]), (920, [0.25] * 12), (930, [1e30, -1e30]), rows[20], rows[40], (50, [9.0] * 9), (940, [-0.5] * 9)]
    for k in (1, 10, 500):
        want = brute(rows, k)
        got, n = told(spark, rows, k, **sizes)
        assert n == len(got) and got == want


def test_small_tables(spark):
    assert told(spark, [], 10) == (set(), 0)
    assert told(spark, [(10, [1.0])], 10) == (set(), 0)
    assert told(spark, [(10, [1.0]), (11, [-1.0])], 10) == ({(10, 1, 11, -1024 * 1024)}, 1)


def test_all_equal_scores_go_to_the_smallest_ids(spark):
    rows = [(i, [0.5, -0.5]) for i in range(60)]
    assert told(spark, rows, 3, cell_vectors=7)[0] == brute(rows, 3)


def test_vectors_outside_essential_lists_are_never_scored():
    """With a threshold, the weak terms' lists alone open no vector; the answer stays exact."""
    r = np.random.default_rng(5)
    v = np.where(r.random((800, 30)) < 0.15, r.integers(-400, 400, (800, 30)), 0)
    shard = Shard(np.arange(800), v)
    q = np.where(r.random(30) < 0.6, r.integers(-300, 300, 30), 0)
    scores = v @ q
    floor = int(np.sort(scores)[-10])
    got, ids = shard.best(-1, q, 10, floor)
    assert sorted(got.tolist(), reverse=True) == sorted(scores, reverse=True)[:10]
    assert (scores[ids] == got).all()
    met = []
    shard.v = _Watched(shard.v, met)
    shard.best(-1, q, 10, floor)
    in_a_list = ((v * q) > 0).any(1).sum()
    assert 0 < max(met) < 0.7 * in_a_list and min(met) < 20


class _Watched:
    """The components, noting how many vectors each probe reads."""

    def __init__(self, v, met):
        self.v, self.met = v, met

    def __len__(self):
        return len(self.v)

    def __getitem__(self, key):
        self.met.append(len(key[1]))
        return self.v[key]
