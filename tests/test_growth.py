"""Steps whose cost must follow the input: classes of characters, lookups of a text's items, n-grams, memories, blocks, scans."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import one_col
from vimarsha.functions import text as X
from vimarsha.operators import linear as L
from vimarsha.operators.langid import ngram_counts
from vimarsha.operators.lookup import _beside, with_values
from vimarsha.operators.translate import translate_with
from vimarsha.session import SCAN_PARTITIONS, spread


def test_fast_classes_hold_the_same_characters(spark):
    chars = spark.range(0x3100).filter("id < 55296").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    odd = chars.filter((F.col("c").rlike(X.WS) != F.col("c").rlike(X.FAST_WS)) | (F.col("c").rlike(X.NON_WS) != F.col("c").rlike(X.FAST_NON_WS)))
    assert odd.count() == 0 and chars.filter(F.col("c").rlike(X.FAST_WS)).count() == 29


def test_script_counts_of_every_class(spark):
    df = one_col(spark, ["ab 12 ಕ೧　!é", "", " \t", None, "a1ಕa1ಕ"])
    got = [tuple(r.n) for r in df.select("id", X.script_counts("text").alias("n")).orderBy("id").collect()]
    assert got == [(8, 2, 2, 2, 2), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (None,) * 5, (6, 2, 2, 2, 0)]


def test_values_stand_beside_their_items(spark):
    df = one_col(spark, ["b a b c", "b a b c", "", None, "q", "a"])
    table = spark.createDataFrame([("a", 1), ("b", 2)], "item string, value int")
    got = with_values(df, "text", F.split("text", " "), lambda w: w.join(table, "item"), "out", "items", lambda t: t != "c").orderBy("id").collect()
    assert [r.out for r in got] == [[2, 1, 2, None], [2, 1, 2, None], [None], None, [None], [1]]
    assert got[0]["items"] == ["b", "a", "b", "c"]


def test_items_of_two_texts_under_one_hash(spark):
    df = spark.sql("SELECT array('b', NULL, 'a', 'b') AS items, from_json('[{\"item\":\"a\",\"value\":1},{\"item\":\"b\",\"value\":2},{\"item\":\"z\",\"value\":3}]', "
                   "'array<struct<item:string,value:int>>') AS known")
    assert df.select(_beside(F.col("items"), F.col("known")).alias("out")).first().out == [2, None, 1, 2]
    own = df.withColumn("known", F.slice("known", 1, 2))
    assert own.select(_beside(F.col("items"), F.col("known")).alias("out")).first().out == [2, None, 1, 2]


def test_ngrams_of_distinct_words(spark):
    df = spark.createDataFrame([("x", "Ab ab　ab"), ("x", " ab"), ("y", "ab"), ("y", None), ("y", " ")], "lang string, text string")
    got = {(r.lang, r.gram): r.n for r in ngram_counts(df, "text", "lang", 1, 3).collect()}
    assert got == {("x", g): 4 for g in ("a", "b", " a", "ab", "b ", " ab", "ab ")} | {("y", g): 1 for g in ("a", "b", " a", "ab", "b ", " ab", "ab ")} | {
        ("x", " "): 8, ("y", " "): 2}
    assert "_vm_word" in ngram_counts(df, "text", "lang")._jdf.queryExecution().optimizedPlan().toString()


def test_memories_meet_texts_by_a_number_first(spark):
    df = one_col(spark, [" a ", "b", " ", None, "a"])
    memory = spark.createDataFrame([("a", "2"), (" a", "1"), ("", "zz"), (None, "n")], "source_text string, translated_text string")
    out = translate_with(df, "text", [("m", memory)])
    assert [(r.translated, r.backend) for r in out.orderBy("id").collect()][:2] == [("1", "m"), ("b", "fallback")]
    assert [r.translated for r in out.orderBy("id").collect()][2:] == [" ", None, "1"]
    assert "xxhash64" in out._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_bounded_by_entries(monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ENTRIES", 10, raising=False)
    sizes = [4, 4, 4, 30, 0, 1, 9, 1]
    lists = pa.array([list(range(n)) for n in sizes], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([lists, lists.cast(pa.list_(pa.float64())), pa.array([1] * len(sizes), pa.int32())], ["at", "v", "y"])
    for given in (batch, pa.concat_batches([batch, batch]).slice(len(sizes))):
        blocks = [np.frombuffer(b.column(0)[0].as_py(), np.int64) for b in L._blocks(30)([given])]
        assert [list(np.diff(b)) for b in blocks] == [[4, 4], [4], [30], [0, 1, 9], [1]]


def test_a_scan_of_few_row_groups_is_dealt_out(spark, tmp_path):
    one_col(spark, ["a"] * 50).coalesce(1).write.parquet(str(tmp_path / "one"))
    had = spark.conf.get(SCAN_PARTITIONS, "0")
    spark.conf.set(SCAN_PARTITIONS, "0")
    try:
        scan = spark.read.parquet(str(tmp_path / "one"))
        cores = spark.sparkContext.defaultParallelism
        assert spread(scan).rdd.getNumPartitions() >= min(cores, 2)
    finally:
        spark.conf.set(SCAN_PARTITIONS, had)
