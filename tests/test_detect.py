import pytest
from pyspark.sql import functions as F

from conftest import PHRASES, one_col
from vimarsha.operators.detect import detect_language, detect_simple, is_kannada


def _detect(spark, texts, **kw):
    df = detect_language(one_col(spark, texts), **kw)
    return [r.detection for r in df.orderBy("id").collect()]


def test_fixture_phrases(spark, phrases):
    rows = {r.pid: r.detection for r in detect_language(phrases).collect()}
    for pid, _text, lang, kn, en in PHRASES:
        d = rows[pid]
        assert d.language == lang, (pid, d)
        assert d.script_proportions.kannada == pytest.approx(kn, abs=1e-6)
        assert d.script_proportions.english == pytest.approx(en, abs=1e-6)


def test_shares_sum_to_one(spark, phrases):
    for r in detect_language(phrases).collect():
        p = r.detection.script_proportions
        total = p.kannada + p.english + p.numeric + p.other
        assert total == pytest.approx(1.0, abs=1e-9) or total == 0.0


def test_romanized_confidence_from_hits(spark):
    d = _detect(spark, ["tumba chennagide", "tumba chennagide olle"])
    assert d[0].confidence == pytest.approx(0.7 * 2 / 3)
    assert d[1].confidence == pytest.approx(0.7)


def test_word_in_two_groups_counts_twice(spark):
    from vimarsha.functions.text import lexicon_hits
    df = one_col(spark, ["idu", "IDU idu", "idukki"])
    hits = [r.h for r in df.select("id", lexicon_hits("text").alias("h")).orderBy("id").collect()]
    assert hits == [2, 4, 0]


def test_blank_and_null(spark):
    d = _detect(spark, ["", " \t\n", None])
    assert all(x.language == "unknown" and x.confidence == 0.0 for x in d)
    assert d[0].details == "Empty or whitespace-only input"


def test_single_native_char_and_tabs(spark):
    d = _detect(spark, ["ಕ", "ತುಂಬಾ\nಚೆನ್ನಾಗಿದೆ\tಮತ್ತು", "A"])
    assert d[0].language == "kannada_script"
    assert d[1].language == "kannada_script"
    assert d[2].language in ("english", "unknown")


def test_langid_signal_mode(spark):
    df = spark.createDataFrame([(0, "Hello!!! World??? Great!!!!", "en", 0.99),
                                (1, "tumba chennagide", "ro", 0.9)],
                               "id int, text string, top string, p double")
    rows = {r.id: r.detection for r in detect_language(df, langid=("top", "p")).collect()}
    assert rows[0].language == "english"
    assert rows[0].confidence == pytest.approx(0.99 * 0.6)
    assert rows[1].language == "romanized_kannada"
    assert rows[1].confidence == pytest.approx(min(0.7 * 2 / 3 + 0.3 * 0.9, 1.0))


def test_thresholds_are_configurable(spark):
    d = _detect(spark, ["ಈ product ತುಂಬಾ good ಆಗಿದೆ"], kannada=0.5)
    assert d[0].language == "kannada_script"


def test_devanagari_not_kannada(spark):
    d = _detect(spark, ["नमस्ते"])
    assert d[0].language != "kannada_script"


def test_simple_and_is_kannada(spark):
    df = detect_simple(one_col(spark, ["tumba chennagide", "This product is excellent and I love it"]))
    rows = df.orderBy("id").select(is_kannada(F.col("language")).alias("k")).collect()
    assert [r.k for r in rows] == [True, False]
