import json
import os
import tempfile

from pyspark.sql import functions as F

from vimarsha.sources import readers as RD
from vimarsha.sources.columns import guess_text_column


def test_csv_and_json_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="vm-src-")
    df = spark.createDataFrame([(1, 'good, "quoted"\nline', "cat", 5, "English")], RD.REVIEW_SCHEMA)
    RD.write_csv(df.withColumn("tags", F.array(F.lit("a"), F.lit("b"))), f"{d}/csv")
    back = RD.read_reviews_csv(spark, f"{d}/csv", RD.REVIEW_SCHEMA).collect()[0]
    assert back.review == 'good, "quoted"\nline' and back.rating == 5
    with open(f"{d}/reviews.json", "w", encoding="utf-8") as fh:
        json.dump([{"review_id": 1, "review": "ತುಂಬಾ", "product_category": "x", "rating": 4,
                    "script_type": "Kannada Script"}], fh, ensure_ascii=False)
    j = RD.read_reviews_json(spark, f"{d}/reviews.json").collect()[0]
    assert j.review == "ತುಂಬಾ" and j.rating == 4


def test_labelled_jsonl_line_numbers(spark):
    d = tempfile.mkdtemp(prefix="vm-src-")
    lines = [json.dumps({"INDIC REVIEW": "ಒಳ್ಳೆ", "LABEL": " positive ", "_split": "test"}, ensure_ascii=False),
             "",
             json.dumps({"INDIC REVIEW": "ಕೆಟ್ಟ", "LABEL": ""}, ensure_ascii=False),
             json.dumps({"INDIC REVIEW": "ಸರಿ", "LABEL": "Negative", "CATEGORY": "c"}, ensure_ascii=False)]
    with open(f"{d}/kn.jsonl", "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")
    rows = {r.review_id: r for r in RD.read_labelled_jsonl(spark, f"{d}/kn.jsonl").collect()}
    assert set(rows) == {"indic_1", "indic_4"}
    assert rows["indic_1"].ground_truth == "Positive" and rows["indic_1"].split == "test"
    assert rows["indic_4"].product_category == "c" and rows["indic_4"].split == "unknown"


def test_line_numbers_over_many_splits(spark):
    d = tempfile.mkdtemp(prefix="vm-src-")
    n = 4000
    with open(f"{d}/kn.jsonl", "w", encoding="utf-8") as fh:
        for i in range(1, n + 1):
            fh.write("\n" if i % 7 == 0 else json.dumps({"INDIC REVIEW": f"r{i}", "LABEL": "Positive"}) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = RD.read_labelled_jsonl(spark, f"{d}/kn.jsonl")
        rows = df.select("review_id", "review").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == n - n // 7 and all(r.review_id == "indic_" + r.review[1:] for r in rows)


def test_merge_splits_and_report(spark):
    d = tempfile.mkdtemp(prefix="vm-src-")
    for split in ("train", "test"):
        os.makedirs(f"{d}/{split}")
        with open(f"{d}/{split}/part.jsonl", "w") as fh:
            fh.write(json.dumps({"INDIC REVIEW": split, "LABEL": "Positive"}) + "\n")
    m = RD.merge_splits(spark, {"train": f"{d}/train", "test": f"{d}/test"}, "`INDIC REVIEW` string, LABEL string")
    assert sorted(r._split for r in m.collect()) == ["test", "train"]
    RD.write_report(m, f"{d}/report", alias=f"{d}/latest")
    assert spark.read.json(f"{d}/latest").count() == 2


def test_guess_text_column(spark):
    assert guess_text_column(spark.createDataFrame([(1, "x")], "id int, Review string")) == "Review"
    assert guess_text_column(spark.createDataFrame([(1, "x")], "id int, my_text_col string")) == "my_text_col"
    assert guess_text_column(spark.createDataFrame([(1, "x")], "id int, body string")) == "id"
    assert guess_text_column(spark.createDataFrame([(1, "x", "y")], "id int, text string, review string")) == "text"
    assert guess_text_column(spark.createDataFrame([(1, "x", "y")], "id int, my_review string, text string")) == "text"


def _files(d, **texts):
    for name, text in texts.items():
        os.makedirs(f"{d}/{name}", exist_ok=True)
        with open(f"{d}/{name}/a.csv", "w", encoding="utf-8") as fh:
            fh.write(text)


def test_csv_columns_are_bound_by_name(spark, tmp_path):
    d = str(tmp_path)
    _files(d, permuted='review,extra,review_id,rating\n nice ,x,3, 5\n"two\nlines, ""quoted""",y,4,\n')
    rows = RD.read_reviews_csv(spark, f"{d}/permuted", RD.REVIEW_SCHEMA).orderBy("review_id").collect()
    assert [r.asDict() for r in rows] == [
        {"review_id": 3, "review": " nice ", "product_category": None, "rating": 5, "script_type": None},
        {"review_id": 4, "review": 'two\nlines, "quoted"', "product_category": None, "rating": None, "script_type": None}]


def test_bad_rows_go_to_quarantine(spark, tmp_path):
    d = str(tmp_path)
    _files(d, mixed="review_id,review,rating\n1,good,5\nx,bad id,4\n2,too,3,many\n3,few\n4,fine,high\n5,ok,\n")
    good = RD.read_reviews_csv(spark, f"{d}/mixed", RD.REVIEW_SCHEMA, quarantine=f"{d}/bad")
    assert sorted((r.review_id, r.review) for r in good.collect()) == [(1, "good"), (5, "ok")]
    assert good.select("review").count() == 2 and good.count() == 2      # also where few columns are read
    bad = spark.read.json(f"{d}/bad").collect()
    assert sorted(r.reason for r in bad) == ["another number of fields than the header"] * 2 + ["no value of its type: rating", "no value of its type: review_id"]
    assert all(r.file.endswith("a.csv") and r.record for r in bad)


def test_training_files_by_header(spark, tmp_path):
    d = str(tmp_path)
    _files(d, train="id,label,review\n7,Positive,great\n8,Negative,poor\n", val="review,label\nfair,Neutral\n")
    train, val = RD.load_training(spark, f"{d}/train", f"{d}/val", text_column="review")
    assert sorted(map(tuple, train.collect())) == [("great", "Positive"), ("poor", "Negative")] and train.columns == ["text", "label"]
    assert [tuple(r) for r in val.collect()] == [("fair", "Neutral")]
    try:
        RD.load_training(spark, f"{d}/train")
        raise AssertionError("a missing column must raise")
    except ValueError as e:
        assert str(e) == "Column 'text' not found in DataFrame. Available columns: ['id', 'label', 'review']"


def test_csv_roundtrip_keeps_blanks_and_reads_empty_fields_as_null(spark, tmp_path):
    rows = [(1, " lead", "a", None, "x"), (2, "trail ", None, 3, ""), (3, "", "\t", 1, None), (4, None, "new\nline", 2, "q\"uo,te")]
    df = spark.createDataFrame(rows, RD.REVIEW_SCHEMA)
    RD.write_csv(df.select("rating", "script_type", "review", "review_id", "product_category"), str(tmp_path / "c"))
    back = RD.read_reviews_csv(spark, str(tmp_path / "c"), RD.REVIEW_SCHEMA)
    assert sorted(map(tuple, back.collect())) == [tuple(None if x == "" else x for x in r) for r in rows]
