from pyspark.sql import functions as F

from vimarsha.functions import batches as B
from vimarsha.functions import text as X
from vimarsha.operators import wordjoin
from vimarsha.operators.pipeline import analyze
from vimarsha.operators.scheme import scheme_spelling, spelling
from vimarsha.operators.score import LexiconScorer
from vimarsha.operators.translate import score_translations, translated_text
from vimarsha.operators.translit import transliterate, transliterated_text


def _one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def test_words_are_gone_through_without_lambdas(spark):
    df = spark.createDataFrame([(1, "tumba chennagide!", "s"), (2, None, "s")], "id long, text string, source string")
    for out in (analyze(df, "text", keep=["id"]).select("detected_language", "pipeline_steps"),
                score_translations(df, "id", "text", "source").select("score")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # what is left are the few values of a row: its steps and messages
        assert "split(" not in plan and "regexp_extract_all(" not in plan and "array_intersect(" not in plan


def test_null_and_blank_texts(spark):
    assert tuple(_one(spark, None, X.script_counts("t"))) == (None,) * 5
    assert tuple(_one(spark, None, X.script_proportions("t"))) == (0.0,) * 4
    assert _one(spark, None, X.lexicon_hits("t")) is None and _one(spark, None, transliterated_text("t")) is None
    assert _one(spark, None, LexiconScorer().logits(F.col("t"))) == [None, 0.5, None]
    assert [_one(spark, x, translated_text("t")) for x in (None, "", " \u3000\n")] == [None, "", " \u3000\n"]
    assert _one(spark, " \u1680 ", transliterated_text("t")) == " \u1680 "
    assert _one(spark, None, X.similarity_score(F.lit("a"), "t")) == 1.0 and _one(spark, " ", X.similarity_score(F.lit("a"), "t")) == 0.0
    assert _one(spark, None, X.similarity_score("t", F.lit("a"))) == 1.0
    assert _one(spark, " ", B.by_length(F.col("t"), ["a", "b"])) == "a" and _one(spark, "x yy", B.by_length(F.col("t"), ["a", "b"])) == "b a"


def test_marks_around_words(spark):
    lookup = {"ab": "X", "c d": "no"}
    assert _one(spark, " Ab,!  ab\tabc ,ab", B.transliterated(F.col("t"), lookup)) == " X,!  X\tabc ,ab"
    # a leading mark shifts what is put back, as in the reference
    assert _one(spark, "ab, ,ab ,, abc", B.translated(F.col("t"), lookup, 500)) == "X, Xb ,, abc"
    assert _one(spark, "ab. ab! " + "c" * 500, B.translated(F.col("t"), lookup, 500)) == "X X " + "c" * 500
    assert _one(spark, "\u0c85a1\u0967\u00b2 \n", X.script_counts("t")).asDict() == dict(total=5, kannada=1, english=1, numeric=2, other=1)


def test_a_spelled_text_is_translated(spark):
    df = spark.createDataFrame([(1, "Tumba, chennagide! xyz"), (2, " \t"), (3, None)], "id long, text string")
    t = transliterate(df).select("id", F.col("transliteration.transliterated").alias("tl"))
    got = {r.id: r.x for r in t.select("id", translated_text("tl").alias("x")).collect()}
    assert got[2] == " \t" and got[3] is None and got[1].endswith(" xyz") and "chennagide" not in got[1]


def test_the_scheme_inside_a_task(spark):
    words = ["kammi", "K", "hubli", "sha~Na", "a.n", "xQ9", "ké", "", "aakk", ".n", "123", "ss\U0001f600", "Mm", "kk"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.x for r in df.select("w", scheme_spelling("w").alias("x")).collect()} == {w: spelling(w) for w in words}


def test_tables_sent_to_the_tasks_spell_as_joined_ones(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Hubli kammi, AB  cd!\tq 12"), (2, "hubli"), (3, None), (4, " "), (5, "ಕ ab, zz")], "id long, text string")
    words = spark.createDataFrame([("hubli", "M"), ("hubli", "L"), ("AB", None), (None, "x"), ("unused", "y")], "src string, dst string")
    own = spark.createDataFrame([("Ab", "X"), ("cd", "Y")], "src string, dst string")
    kw = dict(dictionary=own, words=words, scheme=True)

    def spelled():
        out = transliterate(df, **kw)
        return "Join" in out._jdf.queryExecution().optimizedPlan().toString(), sorted(out.collect(), key=lambda r: r.id)
    joined, got = spelled()
    assert not joined and got[0].transliteration.transliterated.startswith("Hubli ") is False
    monkeypatch.setattr(wordjoin, "TASK_ENTRIES", -1)
    assert spelled() == (True, got)


def test_texts_travel_in_small_batches(spark):
    try:
        spark.conf.unset(B.BATCH_ROWS)
        X.lexicon_hits("t")
        assert spark.conf.get(B.BATCH_ROWS) == B.TEXT_ROWS
        spark.conf.set(B.BATCH_ROWS, "77")
        X.lexicon_hits("t")
        assert spark.conf.get(B.BATCH_ROWS) == "77"
    finally:
        spark.conf.unset(B.BATCH_ROWS)


def test_slices_and_odd_bytes(spark, monkeypatch):
    monkeypatch.setattr(B, "SLICE_BYTES", 3)
    texts = spark.createDataFrame([(1, "Good bad_good GOOD!"), (2, ""), (3, None), (4, "१ aಅ \U0001d7d8")], "id int, t string")
    raw = texts.unionByName(spark.sql("SELECT 5 AS id, CAST(X'676F6F64FF20676F6F64' AS STRING) AS t"))
    out = raw.coalesce(1).select("id", B.word_weights(F.col("t"), {"good": 2}).alias("w"), B.script_counts(F.col("t")).alias("n"))
    got = {r.id: (r.w, None if r.n.total is None else tuple(r.n)) for r in out.collect()}
    assert got[1] == (4, (17, 0, 15, 0, 2)) and got[2] == (0, (0,) * 5) and got[3] == (None, None)
    assert got[4] == (0, (4, 1, 1, 2, 0)) and got[5] == (4, (9, 0, 8, 0, 1))


def test_turns_of_words(spark):
    assert _one(spark, "a bb c", B.by_length(F.col("t"), ["x", "y"], 2)) == "y bb y" and _one(spark, " ", B.by_length(F.col("t"), ["x"], 2)) == "x"
