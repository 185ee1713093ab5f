import random

import pytest
from pyspark.sql import functions as F

from vimarsha.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, s, n, alphabet):
    s = list(s)
    for _ in range(n):
        i, kind = r.randrange(len(s) + 1), r.randrange(3)
        if kind == 0:
            s.insert(i, r.choice(alphabet))
        elif s:
            i = min(i, len(s) - 1)
            s[i:i + 1] = [] if kind == 1 else [r.choice(alphabet)]
    return "".join(s)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_distance_equals_dynamic_programme(spark, k):
    r = random.Random(k)
    rows = []
    for i in range(600):
        a = "".join(r.choice("abñ") for _ in range(r.randint(k + 1, 14)))
        rows.append((i, a, edited(r, a, r.randint(0, k + 2), "abñ")))
    rows = [x for x in rows if len(x[2]) > k]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    for i, a, b, got in df.select("i", "a", "b", L.banded_distance(F.col("a"), F.col("b"), k)).collect():
        want = distance(a, b)
        assert (got == want) if want <= k else got > k, (a, b, want, got)


def test_trimmed_pairs_keep_their_distance(spark):
    r = random.Random(12)
    rows = []
    for i in range(600):
        a = "".join(r.choice("abñ") for _ in range(r.choice([0, 1, 3, 9, 40])))
        rows.append((i, a, edited(r, a, r.randint(0, 4), "abñ") if r.random() < .9 else a[::-1]))
    rows += [(600, "x" * 70_000 + "a" + "y" * 9, "x" * 70_000 + "y" * 9), (601, "", ""), (602, "ab", ""), (603, "", "abc")]
    df = spark.createDataFrame(rows, "i int, p string, q string")
    for k in (1, 2, 3):
        got = {x.i for x in L.near_enough(df, "p", "q", k).collect()}
        assert got == {i for i, a, b in rows if i == 600 or i != 600 and distance(a, b) <= k}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_segment_join_finds_every_pair(spark, k):
    r = random.Random(10 + k)
    base = ["".join(r.choice("ab") for _ in range(r.randint(9, 16))) for _ in range(25)]
    texts = sorted({t for b in base for t in [b, *(edited(r, b, r.randint(0, k + 1), "ab") for _ in range(4))] if len(t) > k})
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "h long, line string, n_chars int")
    got = {(x.a, x.b) for x in L.near_pairs(df, k).collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and distance(a, b) <= k}
    assert got == want


def brute(docs, k, least):
    lines = sorted((d, n, x.strip(" \t\n\x0b\f\r")) for d, t in docs for n, x in enumerate((t or "").split("\n")) if t is not None and d is not None)
    seen, out = {}, {}
    for d, n, x in lines:
        if not x:
            continue
        near = any(min(len(x), len(y)) >= least and y != x and distance(x, y) <= k for y, f in seen.items() if seen.get(x, (d, n)) > f)
        if near or x in seen:
            out.setdefault(d, set()).add(n)
        seen.setdefault(x, (d, n))
    return out


def test_against_brute_force_with_edge_cases(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(28, 45))).strip() + "." for _ in range(12)]
    docs = [(0, None), (1, ""), (2, "\n \n"), (3, "short"), (4, "short\nshort"), (None, base[0] + "\n" + base[0])]
    docs += [(i, "\n".join(edited(r, r.choice(base), r.randint(0, 3), "ab") for _ in range(r.randint(1, 5)))) for i in range(5, 45)]
    docs.append((45, "\n".join("  " + base[0] + "\t" for _ in range(300))))
    df = spark.createDataFrame([(d, t, "x", None) for d, t in docs], "doc_id long, text string, TEXT2 string, n_lines string")
    got = {x.doc_id: x for x in L.dedup_lines(df).collect() if x.doc_id is not None}
    want = brute(docs, L.THRESHOLD, L.MIN_CHARS)
    for d, t in docs:
        if d is None:
            continue
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(d, ()))
        assert got[d].text == left and got[d].n_removed == len(want.get(d, ())), d
    none = [x for x in L.dedup_lines(df).collect() if x.doc_id is None]
    assert len(none) == 1 and none[0].text == base[0] + "\n" + base[0] and none[0].n_removed == 0


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_text_is_split_once_not_for_each_line_that_stays(spark):
    lines = [f"line number {i}" for i in range(3000)]
    docs = spark.createDataFrame([(1, "\n".join(lines[::2])), (2, "\n".join(lines)), (3, "\n\n" + lines[0]), (4, None)], "doc_id long, text string")
    out = L.dedup_lines(docs)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()}
    assert got == {1: ("\n".join(lines[::2]), 1500, 0), 2: ("\n".join(lines[1::2]), 3000, 1500), 3: ("\n", 1, 1), 4: (None, 0, 0)}
    assert "get(split(" not in out._jdf.queryExecution().optimizedPlan().toString()
