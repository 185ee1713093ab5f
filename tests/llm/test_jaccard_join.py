import random
import re

from vimarsha.llm.components import components
from vimarsha.llm.jaccard_join import drop_near_copies, jaccard_classes, of_several_sets


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes(docs, percent=80):
    sets = [(i, shingle_set(t)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n_bases=12, copies=14, words=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(25))
    out = [None, "", " \n\t", "one two", "One TWO", "one two three four", "é è É", "é è é"]
    for _ in range(n_bases):
        base = [r.choice(vocabulary) for _ in range(r.randint(20, words))]
        if r.random() < .5:
            base += passage.split()
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                i = r.randrange(len(w))
                w[i:i + 1] = r.choice([[], [r.choice(vocabulary)], [w[i], "new"]]) or ["x"]
            out.append(r.choice([" ", "\n", "\t "]).join(w).title() if r.random() < .3 else " ".join(w))
    return list(enumerate(out))


def test_classes_equal_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(i, t, 7, None) for i, t in docs], "doc_id long, text string, n long, fp string").repartition(5)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_classes(df, bits=15).collect()}
        assert got == classes(docs)


def test_large_group_of_near_copies_and_repeated_rows(spark):
    r = random.Random(3)
    base = [f"v{i}" for i in range(80)]
    docs = []
    for i in range(300):
        w = list(base)
        for j in r.sample(range(80), r.choice([0, 1, 1, 2, 3])):
            w[j] = f"x{r.randrange(5)}"
        docs.append((i, " ".join(w)))
    rows = docs + docs[:40] + [(None, docs[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_classes(df, bits=15).collect()
    assert len(out) == len(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in out if x.doc_id is not None} == classes(docs)
    kept = {x.doc_id for x in drop_near_copies(df).collect()}
    assert kept == {c for _, c in classes(docs).values()} | {None}


def test_empty_table(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string"), bits=15).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 150)] + [(200, 200), (300, 301), (301, 300)]
    r.shuffle(links)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 150)} | {300: 300, 301: 300}
    assert got == want


def test_prefix_tokens_are_exchanged_once(spark):
    rows = [(1, 10, 5, 0), (1, 11, 5, 0), (1, 11, 5, 0), (2, 10, 5, 1), (2, 10, 5, 1), (3, 12, 7, 2), (4, 12, 7, 3), (4, 10, 5, 2)]
    out = of_several_sets(spark.createDataFrame(rows, "token long, fp long, n int, pos int"))
    assert sorted(map(tuple, out.collect())) == sorted({r for r in rows if r[0] in (1, 4)})
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_tokens_of_one_document_with_two_texts_are_dropped(spark):
    rows = [(1, 10, 5, 0, 3), (1, 11, 9, 0, 3), (2, 10, 5, 1, 3), (2, 12, 5, 1, 4), (3, 10, 5, 2, 3), (3, 10, 5, 2, 6), (4, 13, 7, 0, 13), (4, 14, 7, 0, 14)]
    out = of_several_sets(spark.createDataFrame(rows, "token long, fp long, n int, pos int, owner long"))
    assert sorted(map(tuple, out.collect())) == sorted(x[:4] for x in rows if x[0] in (2, 4))


def test_second_texts_of_documents_equal_brute_force(spark):
    for seed in (5,):
        r = random.Random(seed)
        docs = [(i, t) for i, t in corpus(seed, n_bases=6, copies=10) if t]
        also, kept = [], []
        for i, t in docs:
            w = t.split()
            if r.random() < .6 and len(w) > 12:         # what is left of it: most of it, or another document's words
                also.append((i, t))
                cut = r.choice([1, 3, len(w) // 2, len(w) - 6])
                w = w[cut:] if r.random() < .7 else r.choice(docs)[1].split()
            kept.append((i, " ".join(w)))
        more = [kept[20], (kept[15][0], kept[9][1]), (None, kept[10][1]), (kept[-1][0], None)]
        rows, second = kept + more, also + [also[2], (also[4][0], also[7][1]), (None, also[5][1]), (10 ** 6, also[6][1])]
        sets = [(i, s) for i, s in ((i, shingle_set(t)) for i, t in rows + second if i is not None) if s]
        low = [i for i, _ in sets]
        near = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a][1] & sets[b][1]) >= 80 * len(sets[a][1] | sets[b][1])]
        for _ in sets:
            for a, b in near:
                low[a] = low[b] = min(low[a], low[b])
        gone = {i for (i, _), c in zip(sets, low) if c < i}
        assert 5 < len(gone) < len(docs)
        left, further = (spark.createDataFrame(x, "doc_id long, text string").repartition(3) for x in (rows, second))
        got = [tuple(x) for x in drop_near_copies(left, also=further).collect()]
        assert sorted(got, key=str) == sorted([x for x in rows if x[0] not in gone], key=str)
