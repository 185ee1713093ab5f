import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vimarsha.llm.bpe import Encoder
from vimarsha.llm.packing import best_fit, local_search, pack_documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizers_library(tokenizer):
    import pyarrow as pa
    r = random.Random(1)
    texts = ["don't we'll I've 'stuff ''s  's x'", "  lead", "a \n b\n\nc \t d   ", "1a2 33 x  y", "'re're'", "<|endoftext|> hi",
             "\x1c\x1d a", "\x85b  \x85c", "12'34's", "", "\n", "é" * 9000]
    texts += ["".join(r.choice(" \n\t'asdtlervm1.!é   ñx　😀") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    got = []
    for _, ids, b in Encoder(RANKS).batches(pa.array(texts)):
        got += [ids[b[i]:b[i + 1]].tolist() for i in range(len(b) - 1)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_an_exact_round_trip(spark, tokenizer):
    r = random.Random(2)
    texts = [None, "", "x"] + [" ".join(r.choice(["alpha", "beta's", "été", "\n", "42"]) for _ in range(r.randint(1, 900))) for _ in range(60)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(7, texts[7], None), (None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, OFFSET string").repartition(4)
    out = pack_documents(df, RANKS, size=256).collect()
    want = {}
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) - 256 * (-(-len(ids) // 256) - 1)
        cuts = [0, *range(head, len(ids) + 1, 256)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            key = (i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for x in out:
        key = (x.doc_id, x.piece, x.start, x.length, x.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    bins = {}
    for x in out:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 256
    assert len(bins) <= -(-sum(x.length for x in out) // 256) + 3


def test_local_search_empties_bins_that_best_fit_leaves():
    better = 0
    for seed in range(200):
        r = np.random.default_rng(seed)
        n = r.integers(100, 500, r.integers(8, 60))
        first = best_fit(n, 1024)
        after = local_search([list(b) for b in first], n, 1024)
        assert sorted(i for b in after for i in b) == list(range(len(n))) and all(n[b].sum() <= 1024 for b in after)
        assert len(after) <= len(first)
        better += len(after) < len(first)
    assert better > 20


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0
