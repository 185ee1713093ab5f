import random
import re
import zlib
from collections import Counter

import pytest

from vimarsha.llm import spelling
from vimarsha.llm.spelling import count_words, group_variants, one_edit


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_words(rows, damage):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(n):
    out = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and distance(v, w) == 1]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = [n[w], len(near), form, n[form] if form else None]
    for w in n:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def told(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def random_text(r, size):
    stems = ["banana", "bandana", "cabana", "été-ans", "naïveté", "ÉTÉBANA", "abcabcabc", "aaaaaaaa", "x" * 300]
    words = []
    for _ in range(size):
        w = r.choice(stems)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("abnÉé") + w[i:], w[:i] + r.choice("abnÉé") + w[i + 1:]])
        words.append(w if r.random() < 0.8 else w.upper())
    return r.choice([" ", ", ", "1", "× "]).join(words)


@pytest.mark.parametrize("shard_words", [50_000, 3])
def test_equals_brute_force(spark, monkeypatch, shard_words):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard_words)
    r = random.Random(shard_words)
    rows = [(i if i else None, random_text(r, r.randrange(90)), "x") for i in range(60)] + [(70, None, ""), (71, "", ""), (None, "banana " * 40, "")]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string, TEXT string").repartition(5)
    want = brute_words([x[:2] for x in rows], 7)
    got = count_words(df, damage=7)
    assert {x.word: x.n for x in got.collect()} == want
    assert told(group_variants(got)) == brute(want)


def test_chains_ties_and_empty_tables(spark):
    n = {"abcdef": 5, "abcdeg": 25, "abcdeh": 25, "abcdegh": 125, "abcdxgh": 625, "zzzzzz": 9, "zzzzzzz": 10, "unlike": 5}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = told(group_variants(words))
    assert got == brute(n)
    assert got["abcdef"] == (5, 2, "abcdeg", 25, "abcdxgh")
    empty = count_words(spark.createDataFrame([], "doc_id long, text string"))
    assert told(group_variants(empty)) == {}


def test_one_edit_equals_distance_one():
    r = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in "ab")
        a, b = sorted((a, b), key=len, reverse=True)
        assert one_edit(a, b) == (distance(a, b) == 1)


def test_held_counts_are_handed_on(spark, monkeypatch):
    docs = [(i, "alphabet%s betabeta" % chr(97 + i % 9)) for i in range(60)]
    want = brute_words(docs, 10**9)
    batches = spelling._counts(0, 6)
    import pyarrow as pa
    monkeypatch.setattr(spelling, "HELD", 4)
    table = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in docs])
    total = Counter()
    parts = list(batches([table]))
    for part in parts:
        total.update(dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist())))
    assert len(parts) > 3 and {w: k for w, k in total.items() if k >= 5} == want
