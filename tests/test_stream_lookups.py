import uuid

from pyspark.sql import functions as F

from vimarsha.operators.langid import fit_langid
from vimarsha.session import ensure_checkpoint_dir
from vimarsha.streaming.lookups import Lookups, analyze_stream_with, analyze_with

SCHEMA = "id long, text string, lang string"


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def folder(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex[:10]}"


def memory(spark, text):
    return [("m", spark.createDataFrame([("ತುಂಬಾ", text)], "source_text string, translated_text string"))]


def test_stream_equals_batch_over_micro_batches(spark):
    root = folder(spark)
    rows = [(i, ["tumba raama", "ತುಂಬಾ", "a plain text", "modal illa", None, " ", "ಒಳ್ಳೆ ತುಂಬಾ"][i % 7], ["en", "kn"][i % 2]) for i in range(40)]
    for part in range(4):
        land(spark, f"{root}/in", rows[part::4])
    lookups = Lookups(spark, f"{root}/tables")
    assert lookups.current() == {}
    train = spark.createDataFrame([(1, "the plain text of a day", "en"), (2, "tumba olle raama illa", "kn")], SCHEMA)
    lookups.publish_langid(fit_langid(train, "text", "lang"))
    lookups.publish_memories(memory(spark, "very much"))
    lookups.publish("words", spark.createDataFrame([("modal", "ಮಾದರಿ")], "src string, dst string"))
    sdf = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    name = uuid.uuid4().hex
    out = analyze_stream_with(sdf, lookups, "text", "id", name, scheme=True, details=True)
    got = spark.read.parquet(f"{out}/rows")
    assert got.select("batch").distinct().count() >= 3
    want = analyze_with(spark.createDataFrame(rows, SCHEMA), lookups, "text", "id", scheme=True, details=True)
    assert sorted(map(str, got.drop("batch").collect())) == sorted(map(str, want.collect()))
    assert {r.translation_sources for r in got.collect()} >= {"m", "fallback"}


def test_refreshed_tables_take_effect_with_the_next_micro_batch(spark):
    root = folder(spark)
    lookups, name = Lookups(spark, f"{root}/tables"), uuid.uuid4().hex
    for version, said in ((1, "first"), (2, "second")):
        assert lookups.publish_memories(memory(spark, said)) == version
        land(spark, f"{root}/in", [(version, "ತುಂಬಾ", "kn")])
        sdf = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        out = analyze_stream_with(sdf, lookups, "text", "id", name)
    got = {r.id: (r.batch, r.translated_text) for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == {1: (0, "first"), 2: (1, "second")}
    used = {(r.batch, r.version) for r in spark.read.parquet(f"{out}/versions").filter(F.col("name") == "memory").collect()}
    assert used == {(0, 1), (1, 2)}
