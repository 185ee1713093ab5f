import pytest

from conftest import one_col
from vimarsha.functions import lexicon as LX
from vimarsha.operators.translit import transliterate

KNOWN = [("namaskara", "ನಮಸ್ಕಾರ"), ("chennagide", "ಚೆನ್ನಾಗಿದೆ"), ("tumba", "ತುಂಬ"), ("tumbaa", "ತುಂಬಾ"),
         ("olle", "ಒಳ್ಳೆ"), ("olleyadu", "ಒಳ್ಳೆಯದು"), ("ketta", "ಕೆಟ್ಟ"), ("illa", "ಇಲ್ಲ"), ("ide", "ಇದೆ"),
         ("agide", "ಆಗಿದೆ"), ("beku", "ಬೇಕು"), ("naanu", "ನಾನು"), ("bengaluru", "ಬೆಂಗಳೂರು"),
         ("karnataka", "ಕರ್ನಾಟಕ"), ("mattu", "ಮತ್ತು"), ("delivery", "ಡೆಲಿವರಿ"), ("product", "ಪ್ರಾಡಕ್ಟ್"),
         ("okay", "ಓಕೆ")]


def _tl(spark, texts, **kw):
    return [r.transliteration for r in transliterate(one_col(spark, texts), **kw).orderBy("id").collect()]


def test_dictionary_size():
    assert len(LX.roman_pairs()) == 167
    assert len(LX.roman_lookup()) == 165
    assert len(LX.native_lookup()) == 47


def test_known_pairs_and_uppercase(spark):
    words = [k for k, _ in KNOWN] + [k.upper() for k, _ in KNOWN]
    out = _tl(spark, words)
    expected = [v for _, v in KNOWN] * 2
    assert [o.transliterated for o in out] == expected
    assert all(o.method == "fallback" for o in out)


def test_sentence_and_whitespace(spark):
    out = _tl(spark, ["tumba chennagide", "tumba  chennagide", "TUMBA  CHENNAGIDE, olle!"])
    assert out[0].transliterated == "ತುಂಬ ಚೆನ್ನಾಗಿದೆ"
    assert "  " in out[1].transliterated
    assert out[2].transliterated == "ತುಂಬ  ಚೆನ್ನಾಗಿದೆ, ಒಳ್ಳೆ!"
    assert [tuple(m) for m in out[0].word_mappings] == [("tumba", "ತುಂಬ"), ("chennagide", "ಚೆನ್ನಾಗಿದೆ")]


@pytest.mark.parametrize("token", ["1234", "@#$", "!!!", "---", "...", "👍", "ನಮಸ್ಕಾರ"])
def test_pass_through_tokens(spark, token):
    out = _tl(spark, [token])[0]
    assert out.transliterated == token
    assert out.method == "unchanged"


def test_keys_with_punctuation_and_stripping(spark):
    out = _tl(spark, ["yenu?", "ide.", "olle!!", "ketta,"])
    assert [o.transliterated for o in out] == ["ಯೇನು?", "ಇದೆ.", "ಒಳ್ಳೆ!!", "ಕೆಟ್ಟ,"]


def test_unknown_words_and_emoji_sentence(spark):
    out = _tl(spark, ["xyz qwerty blorp", "tumba chennagide 👍🎉", "5 stars tumba olle", ""])
    assert out[0].method == "unchanged" and out[0].transliterated == "xyz qwerty blorp"
    assert "ಚೆನ್ನಾಗಿದೆ" in out[1].transliterated
    assert "5" in out[2].transliterated
    assert out[3].transliterated == "" and out[3].method == "unchanged"


def test_custom_dictionary_overrides(spark):
    out = _tl(spark, ["tumba blorp"], dictionary={"BLORP": "ಬ್ಲಾರ್ಪ್", "tumba": "ತುಂ"})
    assert out[0].transliterated == "ತುಂ ಬ್ಲಾರ್ಪ್"


def test_join_path_equals_inline(spark):
    texts = ["tumba chennagide", "TUMBA  CHENNAGIDE, olle!", "xyz 1234 ನಮಸ್ಕಾರ", "", "  ", "yenu? blorp"]
    added = spark.createDataFrame([("BLORP", "ಬ್ಲಾರ್ಪ್")], "src string, dst string")
    df = one_col(spark, texts)
    joined = {r.id: r.transliteration for r in transliterate(df, dictionary=added, key="id").collect()}
    inline = {r.id: r.transliteration for r in transliterate(df, dictionary={"blorp": "ಬ್ಲಾರ್ಪ್"}).collect()}
    assert joined == inline


def test_scheme_for_unknown_words(spark):
    out = {r.id: r.transliteration for r in
           transliterate(one_col(spark, ["tumba raama", "xyz 123", "olle"]), key="id", scheme=True).collect()}
    assert out[0].transliterated == "ತುಂಬ ರಾಮ" and out[0].method == "mixed"
    assert out[1].method == "scheme" and out[1].transliterated.endswith(" 123")
    assert out[2].method == "fallback"
