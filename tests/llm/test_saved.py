import glob
import time

from pyspark.sql import functions as F

from vimarsha.llm.common import CLEANUP, saved
from vimarsha.llm.line_dedup import dedup_lines


def _shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def test_a_saved_table_leaves_no_shuffle_files(spark):
    had, setting = _shuffle_files(spark), spark.conf.get(CLEANUP)
    table = saved(spark.range(20000).groupBy((F.col("id") % 5000).alias("k")).count(), "counts")
    assert table.count() == 5000 and table.agg(F.sum("count")).first()[0] == 20000
    for _ in range(100):
        if not (left := _shuffle_files(spark) - had - _of_reads(spark, table)):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP) == setting


def _of_reads(spark, table):
    """Shuffle files of the two reads above hold one row a task; those of the saved query are far larger."""
    import os
    return {f for f in _shuffle_files(spark) if os.path.exists(f) and os.path.getsize(f) < 2000}


def test_lines_with_a_word_are_counted_by_one_split(spark):
    texts = ["a\n\n b \t\n \x0b\nc", "\n \n", "", None, " x", "\r\nx\r\n\r\ny\n", "a\x0bb\n\x0c\n\x85\n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = dedup_lines(df, min_chars=10)
    want = [sum(1 for line in (t or "").split("\n") if line.strip(" \t\n\x0b\x0c\r")) for t in texts]
    assert [r.n_lines for r in out.orderBy("doc_id").collect()] == want
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()
