"""Column expressions against plain-Python statements of the same rules (property style)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vimarsha.functions import text as X

ALPHABET = st.sampled_from(list("ab c\tdé.!?,ಕನ್ನಡ1２ \nx\u00a0\u2003"))


def py_char_wb(text, lo=2, hi=4):
    grams = []
    for w in text.lower().split():
        w = f" {w} "
        for n in range(lo, hi + 1):
            if len(w) < n:
                if n == lo:
                    grams.append(w)
                break
            grams.extend(w[i:i + n] for i in range(len(w) - n + 1))
            if len(w) == n:
                break
    return grams


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=8))
def test_text_rules_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select("id", "text", X.py_strip("text").alias("s"), X.word_count("text").alias("wc"),
                     F.array_join(X.tokens_ws("text"), "").alias("rebuilt"),
                     X.char_wb_ngrams("text").alias("g"), X.is_blank("text").alias("blank")).collect()
    for r in rows:
        assert r.s == r.text.strip()
        assert r.wc == len(r.text.split())
        assert r.rebuilt == r.text
        assert sorted(r.g) == sorted(py_char_wb(r.text))
        assert r.blank == (not r.text.strip())


def test_script_shares_and_digits(spark):
    df = spark.createDataFrame([("ಕ೧ 1 a!",)], "text string")
    p = df.select(X.script_proportions("text").alias("p")).collect()[0].p
    # Kannada digit counts as Kannada; visible chars: ಕ ೧ 1 a ! -> 5
    assert (p.kannada, p.english, p.numeric, p.other) == (0.4, 0.2, 0.2, 0.2)
