import random
import re

from pyspark.sql import functions as F

from vimarsha.llm.quality_rules import FEW, Rule, base_features, judge, order_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + o for i, x in enumerate(windows) if windows.count(x) > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_base_features_equal_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t", "a a a a", "a b c a b c", "a b c\na b c\n\na b c ", "#|x <y>", "\x0bé\x0c ñ\r\n", "x" * 5000]
    texts += [" ".join(r.choice("abcd") for _ in range(r.randint(0, 30))) + r.choice(["", "\n", "\nq\nq"]) for _ in range(120)]
    texts += [" ".join(f"w{r.randrange(FEW * 2)}" for _ in range(900)) + " " + " ".join(f"z{i % 400}" for i in range(1200))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for x in base_features(df).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(texts[x.doc_id]), texts[x.doc_id]


def test_order_does_not_change_verdicts_and_clashing_columns_pass(spark):
    r = random.Random(2)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(n))
    texts = [words(80), words(30), words(60).upper(), " | ".join(words(60).split()), words(60) + " lorem ipsum", None, words(70) * 1]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)] * 2, "doc_id long, text string, KEPT string, extra int")
    out = judge(df).collect()
    assert len(out) == 14 and "KEPT" not in judge(df).columns
    assert {x.doc_id: x.kept for x in out} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: True}
    rules = [Rule("never", F.lit(None).cast("boolean")), Rule("many", F.col("n_words") > 75)]
    assert {x.doc_id for x in judge(df, rules=rules).collect() if x.kept} == {2, 4, 6}
    assert [x.name for x in order_rules(df, rules)] == ["many", "never"]


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
