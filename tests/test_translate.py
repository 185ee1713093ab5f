from pyspark.sql import functions as F

from conftest import one_col
from vimarsha.functions import text as X
from vimarsha.operators.translate import translate, translate_segments, translate_with, translated_text


def test_dictionary_translation(spark):
    df = translate(one_col(spark, ["ತುಂಬಾ ಚೆನ್ನಾಗಿದೆ", "ಇದು ಕೆಟ್ಟ.", "ಮನೆ  ಕೆಲಸ", "  ", "ಹೊಸ product"]), "text", "out")
    out = [r.out for r in df.orderBy("id").collect()]
    assert out == ["very is good", "this bad.", "house work", "  ", "ಹೊಸ product"]


def test_leading_mark_quirk(spark):
    # word[len(clean):] is appended: for "!ಇದೆ." that is the tail after 3 code points
    df = translate(one_col(spark, ["!ಇದೆ."]), "text", "out")
    assert df.collect()[0].out == "is" + "!ಇದೆ."[3:]


def _py_segments(text, max_len=500):
    """Plain-Python statement of the segmentation rule, for comparison."""
    import re
    if len(text) <= max_len:
        return [text]
    sentences = [s.strip() for s in re.split(r"[.!?।॥]\s*", text) if s.strip()]
    segs, cur = [], ""
    for s in sentences:
        if len(s) > max_len:
            if cur:
                segs.append(cur.strip())
                cur = ""
            ws = ""
            for w in s.split():
                if len(ws) + len(w) + 1 > max_len:
                    if ws:
                        segs.append(ws.strip())
                    ws = w
                else:
                    ws = f"{ws} {w}".strip()
            if ws:
                segs.append(ws.strip())
        elif len(cur) + len(s) + 1 > max_len:
            if cur:
                segs.append(cur.strip())
            cur = s
        else:
            cur = f"{cur} {s}".strip()
    if cur:
        segs.append(cur.strip())
    return segs


def test_segmentation_matches_rule(spark):
    long_word = "x" * 700
    texts = ["short text.", ("ಇದು ಒಳ್ಳೆ. " * 80).strip(), ("word " * 300).strip(), f"a. {long_word} b. c!",
             ("sentence one is here! " * 40).strip()]
    df = one_col(spark, texts).withColumn("segs", X.segment_text(X.py_strip("text"), 500))
    got = [r.segs for r in df.orderBy("id").collect()]
    assert got == [_py_segments(t) for t in texts]


def test_segment_translation_equals_flat(spark):
    texts = [("ಇದು ಒಳ್ಳೆ. ತುಂಬಾ ಚೆನ್ನಾಗಿದೆ! " * 40).strip(), "ಮತ್ತು ಇದು.", ""]
    df = translate_segments(one_col(spark, texts), "text", "tr").withColumn("flat", translated_text("text"))
    for r in df.collect():
        assert r.tr.translated == r.flat


def test_translation_memory_first(spark):
    mem = spark.createDataFrame([("ತುಂಬಾ ಚೆನ್ನಾಗಿದೆ", "very good indeed")], "source_text string, translated_text string")
    df = translate_with(one_col(spark, ["ತುಂಬಾ ಚೆನ್ನಾಗಿದೆ ", "ಇದು"]), "text", [("memory", mem)])
    rows = df.orderBy("id").collect()
    assert (rows[0].translated, rows[0].backend) == ("very good indeed", "memory")
    assert (rows[1].translated, rows[1].backend) == ("this", "fallback")


def test_similarity(spark):
    df = spark.createDataFrame([("the product is good", "The product is very good"), ("x", ""), ("a", "b c d e f")],
                               "t string, e string")
    got = [r.s for r in df.select(X.similarity_score("t", "e").alias("s")).collect()]
    assert got == [4.0, 0.0, 1.0]
    _ = F
