import os

from pyspark.sql import functions as F

from conftest import one_col
from vimarsha.operators.lookup import with_hits
from vimarsha.operators.pipeline import analyze
from vimarsha.operators.score import BatchModelScorer, DistinctScorer, LexiconScorer, NeutralScorer
from vimarsha.operators.translate import memory_table, score_translations, translate_by_segments
from vimarsha.operators.translit import transliterate


def memory(spark, pairs):
    return spark.createDataFrame(pairs, "source_text string, translated_text string")


def test_maps_of_hits(spark):
    df = one_col(spark, ["a b a", "b c", "", None, "b c", "zz"])
    table = spark.createDataFrame([("a", 1), ("b", 2), ("q", 3)], "item string, value int")
    got = with_hits(df, "text", F.split("text", " "), table, "hits").orderBy("id").collect()
    assert [r.hits for r in got] == [{"a": 1, "b": 2}, {"b": 2}, None, None, {"b": 2}, None]


def test_segments_mix_sources_in_order(spark):
    long = "ತುಂಬಾ. " + "ಒಳ್ಳೆ " * 12 + "."
    df = one_col(spark, ["ತುಂಬಾ", long, "ಒಳ್ಳೆ", " ", None, "ಗೊತ್ತಿಲ್ಲದ"])
    human = memory(spark, [(" ತುಂಬಾ ", "very much"), ("ತುಂಬಾ", "zz"), ("ಒಳ್ಳೆ", None), ("", "blank")])
    machine = memory(spark, [("ತುಂಬಾ", "machine"), ("ಒಳ್ಳೆ", "fine")])
    got = translate_by_segments(df, "text", [("human", human), ("machine", machine)], max_len=30).orderBy("id").select("translation.*").collect()
    assert [r.translated for r in got][0] == "very much" and got[0].backend == "human" and got[0].sources == ["human"]
    assert got[1].translated.startswith("very much ") and got[1].sources == ["human", "fallback"] and got[1].backend == "fallback"
    assert [s.source for s in got[1].segments] == ["human"] + ["fallback"] * (len(got[1].segments) - 1)
    assert (got[2].translated, got[2].backend) == ("fine", "machine")
    assert (got[3].translated, got[3].segments, got[4].translated) == (" ", [], None)
    assert (got[5].translated, got[5].backend, got[5].success) == ("ಗೊತ್ತಿಲ್ಲದ", "fallback", True)


def test_without_fallback_a_missing_segment_fails_the_text(spark):
    df = one_col(spark, ["ತುಂಬಾ", " ಒಳ್ಳೆ "])
    t = translate_by_segments(df, "text", [("human", memory(spark, [("ತುಂಬಾ", "very")]))], auto_fallback=False).orderBy("id")
    a, b = t.select("translation.*").collect()
    assert (a.success, a.error, a.translated) == (True, None, "very")
    assert (b.success, b.translated, b.segments, b.backend) == (False, "ಒಳ್ಳೆ", [], "human")
    assert b.error == "Translation failed: segments in no memory: 1"
    scored = score_translations(df.withColumn("c", F.lit("x")), "id", "text", "c", native="text", auto_fallback=False,
                                memories=[("human", memory(spark, [("ತುಂಬಾ", "very")]))]).orderBy("id").collect()
    assert [(r.backend, r.success, r.score is None) for r in scored] == [("human", True, False), ("human", False, True)]


def test_repeated_rows_of_a_memory_multiply_nothing(spark):
    table = memory_table([("m", memory(spark, [("a", "2"), ("a", "1"), ("b", "3")] * 3))])
    assert {r.item: tuple(r.value) for r in table.collect()} == {"a": ("1", "m"), "b": ("3", "m")} and table.count() == 2


def test_methods_of_spelling(spark):
    words = spark.createDataFrame([("modal", "ಮಾದರಿ"), ("modal", "ಮಾದ"), ("tumba", "ಟುಂಬ")], "src string, dst string")
    df = one_col(spark, ["modal modal", "modal xyzz", "tumba", "raama", "olle raama", "olle", "123 !", "", None])
    got = {r.id: r.t for r in transliterate(df, "text", "t", scheme=True, words=words).collect()}
    assert [got[i].method for i in range(9)] == ["model", "mixed", "model", "scheme", "mixed", "fallback", "unchanged", "unchanged", "unchanged"]
    assert got[0].transliterated == "ಮಾದ ಮಾದ" and got[2].transliterated == "ಟುಂಬ"
    assert [m.src for m in got[4].word_mappings] == ["olle", "raama"]
    # without the scheme, a model's word beside one that stays is mixed too
    one = transliterate(one_col(spark, ["modal zz"]), "text", "t", words=words).collect()[0].t
    assert (one.transliterated, one.method) == ("ಮಾದ zz", "mixed")


def test_analyze_spells_unknown_words_and_asks_memories(spark):
    df = one_col(spark, ["tumba raama", "ತುಂಬಾ", "a plain english text", None, " ", "tumba"])
    plain = {r.id: r for r in analyze(df, "text", keep=["id"]).collect()}
    got = {r.id: r for r in analyze(df, "text", keep=["id"], scheme=True, details=True,
                                    memories=[("m", memory(spark, [("ತುಂಬಾ", "good")]))]).collect()}
    assert got[0].transliteration_method == "mixed" and "raama" in plain[0].transliterated_text
    assert "raama" not in got[0].transliterated_text and got[0].translation_sources == "fallback"
    assert (got[1].translated_text, got[1].translation_sources, got[1].sentiment_label) == ("good", "m", "Positive")
    for i in (2, 3, 4):
        assert got[i].asDict() | {"transliteration_method": 0, "translation_sources": 0} == plain[i].asDict() | {
            "transliteration_method": 0, "translation_sources": 0}
        assert (got[i].transliteration_method, got[i].translation_sources) == (None, None)


def test_each_distinct_text_is_scored_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def network():
        import numpy as np

        def predict(texts):
            rows = [t.decode() if isinstance(t, bytes) else str(t) for t in texts]
            fd = os.open(calls, os.O_CREAT | os.O_APPEND | os.O_WRONLY)
            os.write(fd, "".join(f"{len(r)}\n" for r in rows).encode())
            os.close(fd)
            return np.array([[len(r), 1.0, 0.5 * r.count("x")] for r in rows])
        return predict
    texts = ["hot"] * 300 + ["x" * (i % 40) for i in range(400)] + [None, "é"]
    df = one_col(spark, texts).repartition(7)
    inner = BatchModelScorer(network, ["Negative", "Neutral", "Positive"])
    got = DistinctScorer(inner, hot_share=0.1).score(df, "text").collect()
    lines = open(calls).read().split()
    assert len(lines) == len({t for t in texts if t is not None})
    assert len(got) == len(texts)
    for r in got:
        if r.text is None:
            assert r.sentiment is None
        else:
            assert r.sentiment.raw_scores == [len(r.text), 1.0, 0.5 * r.text.count("x")]
    want = {r.id: r.sentiment for r in inner.score(df.filter("text is not null"), "text").collect()}
    assert {r.id: r.sentiment for r in got if r.text is not None} == want


def test_analyze_with_distinct_and_neutral_scorers(spark):
    df = one_col(spark, ["a good day", "a good day", "nothing here", None])
    plain = analyze(df, "text", keep=["id"]).orderBy("id").collect()
    assert analyze(df, "text", keep=["id"], scorer=DistinctScorer(LexiconScorer())).orderBy("id").collect() == plain
    strict = analyze(df, "text", keep=["id"], scorer=NeutralScorer(LexiconScorer(), 0.99)).orderBy("id").collect()
    assert [r.sentiment_label for r in strict] == ["Neutral"] * 4 and [r.confidence_score for r in strict] == [r.confidence_score for r in plain]
