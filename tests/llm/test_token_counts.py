import re

import pytest
from pyspark.sql import functions as F

from vimarsha.llm.common import scratch
from vimarsha.llm.token_counts import KEYS, Rollup, count_tokens

SCHEMA = "source string, lang string, version string, op string, n_tokens long, old_tokens long"


def totals(rollup):
    return {tuple(x[k] for k in KEYS): (x.n_docs, x.n_tokens) for x in rollup.totals().collect()}


def test_deltas_commit_once_and_cancel_out(spark):
    r = Rollup(spark, scratch(spark, "rollup"))
    assert totals(r) == {}
    load = spark.createDataFrame([("a", "en", "v1", "insert", 10, None), ("a", "en", "v1", "insert", 5, None), (None, None, "v1", "insert", None, None),
                                  ("b", "de", "v1", "insert", 7, None)], SCHEMA)
    assert r.commit("1", load) and not r.commit("1", load)
    assert totals(r) == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 0), ("b", "de", "v1"): (1, 7)}
    assert r.commit("2", spark.createDataFrame([("b", "de", "v1", "delete", 7, None), ("a", "en", "v1", "revise", 8, 10)], SCHEMA))
    assert totals(r) == {("a", "en", "v1"): (2, 13), (None, None, "v1"): (1, 0)}
    assert r.commit("3", spark.createDataFrame([], SCHEMA)) and r.committed() == ["1", "2", "3"]
    assert totals(r) == {("a", "en", "v1"): (2, 13), (None, None, "v1"): (1, 0)}


def test_broken_batch_counts_once_after_a_retry(spark):
    r = Rollup(spark, scratch(spark, "rollup"))
    bad = spark.createDataFrame([("a", "en", "v1", "upsert", 10, None)], SCHEMA)
    with pytest.raises(Exception, match="unknown op"):
        r.commit("1", bad)
    assert totals(r) == {} and not r.is_committed("1")
    # remains of a write without the success mark are not read, and are written over
    spark.createDataFrame([("a", "en", "v1", 9, 9)], "source string, lang string, version string, n_docs long, n_tokens long").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").mode("overwrite").parquet(f"{r.root}/batch-1")
    assert totals(r) == {}
    assert r.commit("1", spark.createDataFrame([("a", "en", "v1", "insert", 10, None)], SCHEMA))
    assert totals(r) == {("a", "en", "v1"): (1, 10)}
    with pytest.raises(ValueError):
        r.commit("../x", bad)


def test_counts_equal_the_tokenizers_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "one two -- ### é ñ! 3", "a\tb\n\nc  -", "long " * 5000]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, Words int").repartition(2)
    for x in count_tokens(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[x.doc_id] or "")
        assert (x.words, x.named) == (len(w), sum(any(c.isalnum() or ord(c) > 127 for c in y) for y in w))
        assert x.bpe == len(t.encode(texts[x.doc_id] or "", add_special_tokens=False).ids)


def test_query_equals_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from conftest import SF
    from vimarsha.llm.plans import plans
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want, seen = {}, set()
    for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        if x.text in seen:
            continue
        seen.add(x.text)
        w = re.findall(r"[^\x20\x09-\x0D]+", x.text or "")
        for version, n in (("words", sum(any(c.isascii() and c.isalnum() or ord(c) > 127 for c in y) for y in w)),
                           ("byte_bpe_50k", len(t.encode(x.text or "", add_special_tokens=False).ids))):
            d, s = want.get((x.source, x.lang, version), (0, 0))
            want[x.source, x.lang, version] = (d + 1, s + n)
    got = {tuple(x[k] for k in KEYS): (x.n_docs, x.n_tokens) for x in plans()["op1_token_counts"][0](spark, SF).collect()}
    assert got == want


def test_extra_columns_that_clash(spark):
    r = Rollup(spark, scratch(spark, "rollup"))
    df = spark.createDataFrame([("a", "en", "v", "insert", 1, None, 5)], SCHEMA + ", n_docs long")
    assert r.commit("1", df) and r.totals().agg(F.sum("n_docs")).first()[0] == 1
