import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from vimarsha.llm import textvec as tv
from vimarsha.llm.decontaminate import RADIUS, Index, drop_leaks, find_leaks


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def word_hash(word):
    return int(next(tv.words(pa.array([word]))).hashes[0])


def simhash(ws, hashes):
    return sum(1 << b for b in range(64) if sum(1 if hashes[w] >> b & 1 else -1 for w in ws) > 0)


def bag(ws):
    k = min(5, len(ws))
    return Counter(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))


def weighted(a, b):
    weight = lambda s: sum(len(w.encode()) for w in s)
    keys = set(a) | set(b)
    return sum(weight(s) * min(a[s], b[s]) for s in keys) / sum(weight(s) * max(a[s], b[s]) for s in keys)


def brute(docs, items, radius=RADIUS, least=.8):
    hashes = {w: word_hash(w) for _, t in docs + items for w in words(t)}
    out = {}
    for d, t in docs:
        ws = words(t)
        for i, x in items:
            it = words(x)
            for s in range(len(ws) - len(it) + 1 if it else 0):
                win = ws[s:s + len(it)]
                sim = weighted(bag(win), bag(it))
                bits = (simhash(win, hashes) ^ simhash(it, hashes)).bit_count() if sim >= least else 64
                if bits <= radius and (d, i) not in out or bits <= radius and sim > out[d, i][0] + 1e-12:
                    out[d, i] = (sim, s, len(it), bits)
    return out


def sample():
    r = random.Random(1)
    vocabulary = ["w%d" % i for i in range(40)] + ["Été", "über", "z"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(12, 40))) for i in range(12)] + [(12, "Tiny item"), (13, None), (14, ""), (15, text(30))]
    items.append((16, items[0][1]))
    docs = [(0, None), (1, ""), (2, "tiny ITEM"), (3, text(300)), (4, "a tiny\nitem here")]
    for d in range(5, 90):
        ws = words(r.choice(items)[1]) or ["x"]
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            at = r.choice([0, len(ws) - 1, r.randrange(len(ws))])
            ws[at:at + 1] = r.choice([[], [r.choice(vocabulary)], [ws[at], "more"]]) or ["y"]
        docs.append((d, text(r.randint(0, 30)) + "\n " + r.choice([" ", "\t"]).join(ws).upper() + " " + text(r.randint(0, 30))))
    return docs, items


def test_search_equals_brute_force(spark):
    docs, items = sample()
    want = brute(docs, items)
    assert len(want) > 15
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, ITEM_ID int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (10 ** 6, 300):
        got = {(x.doc_id, x.item_id): (x.similarity, x.first_word, x.n_words, x.bits) for x in find_leaks(df, bench, block_chars=size).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert abs(got[k][0] - v[0]) < 1e-9 and got[k][2:] == v[2:] and got[k][1] == v[1], (k, got[k], v)
    clean = {x.doc_id for x in drop_leaks(df, bench).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}
    assert drop_leaks(df, bench).columns == df.columns


def test_multi_index_finds_all_within_the_default_radius_and_compares_few():
    r = np.random.default_rng(1)
    index = Index([(i, " ".join(f"a{i}b{j}" for j in range(10))) for i in range(50)])
    fp = index.lengths[10][1]
    probe = np.repeat(fp, 40)
    for i in range(len(probe)):
        for b in r.choice(64, i % 40, replace=False):
            probe[i] ^= np.uint64(1) << np.uint64(b)
    win, own = index._near(probe, 10)
    want = {(int(i), int(j)) for i, j in np.argwhere(np.bitwise_count(probe[:, None] ^ fp) <= RADIUS)}
    assert set(zip(win.tolist(), own.tolist())) == want and len(want) > 40 * RADIUS
    assert 0 < index.looked_up < 0.35 * len(probe) * len(fp)


def test_matches_come_from_the_multi_index():
    """Without the blocks' answers there is no match, so nothing else finds any."""
    docs, items = sample()
    index = Index(items)
    assert list(index.search(pa.array([t for _, t in docs]))) and index.looked_up > 0
    index._near = lambda fp, n: (np.zeros(0, int), np.zeros(0, int))
    assert not list(index.search(pa.array([t for _, t in docs])))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(None, "a b c d e f g")], "doc_id long, text string")
    assert find_leaks(docs, items).count() == 0 and find_leaks(one, items).count() == 0 and drop_leaks(one, items).count() == 1
    bench = spark.createDataFrame([(5, "b c d e f")], "item_id long, text string")
    assert [(x.doc_id, x.item_id) for x in find_leaks(one, bench).collect()] == [(None, 5)]


def test_recall_by_similarity_alone():
    r = random.Random(3)
    vocabulary = ["%x" % r.getrandbits(r.choice([12, 20, 32])) for _ in range(3000)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(r.randint(12, 60)))) for i in range(60)]
    docs = []
    for d in range(600):
        ws = words(items[d % 60][1])
        if d % 3 == 0:                                   # without context: some are shorter than the item
            cut = r.randint(0, 3)
            ws = ws[cut:len(ws) - r.randint(0, 2)]
        else:
            for _ in range(r.randint(1, 3)):
                ws[r.choice([0, 1, len(ws) - 1, r.randrange(len(ws))])] = r.choice(vocabulary)
            if d % 3 == 1:                               # the last words replaced
                n = (len(ws) - 4) // 9
                ws = words(items[d % 60][1])[:len(ws) - n] + some(n)
            ws = some(r.randint(0, 20)) + ws + some(r.randint(0, 20))
        docs.append((d, " ".join(ws)))
    want = {}
    for d, t in docs:
        ws, it = words(t), words(items[d % 60][1])
        n = min(len(it), len(ws))
        sim = max(weighted(bag(ws[s:s + n]), bag(it)) for s in range(len(ws) - n + 1))
        if sim >= .8:
            want[d, d % 60] = n < len(it)
    got = {(row, item): (n, bits) for row, item, _, n, bits, _ in Index(items).search(pa.array([t for _, t in docs]))}
    assert got.keys() == want.keys() and len(want) > 200 and sum(want.values()) > 30
    assert sum(bits > 7 for _, bits in got.values()) > 20
    assert all((n < len(words(items[i][1]))) == want[d, i] for (d, i), (n, _) in got.items())
    seven = sum(1 for _ in Index(items, radius=7).search(pa.array([t for _, t in docs])))
    print("matches", len(want), "shorter documents", sum(want.values()), "found at radius 7", seven, "most bits", max(b for _, b in got.values()))
