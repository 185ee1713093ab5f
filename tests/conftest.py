import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"

# Fixture phrases (FIXTURES.md section 2) with their expected detection in no-signal mode.
PHRASES = [
    (0, "ಈ ಉತ್ಪನ್ನ ತುಂಬಾ ಚೆನ್ನಾಗಿದೆ", "kannada_script", 1.0, 0.0),
    (1, "ಈ ಉತ್ಪನ್ನಕ್ಕೆ 5 ರೇಟಿಂಗ್", "kannada_script", 0.95, 0.0),
    (2, "ಈ product ತುಂಬಾ good ಆಗಿದೆ", "mixed", 0.5, 0.5),
    (3, "tumba chennagide", "romanized_kannada", 0.0, 1.0),
    (4, "TUMBA  CHENNAGIDE, olle!", "romanized_kannada", 0.0, 0.904762),
    (5, "idu product tumba ketta. sariyilla", "romanized_kannada", 0.0, 0.966667),
    (6, "This product is excellent and I love it", "english", 0.0, 1.0),
    (7, "Hello!!! World??? Great!!!!", "mixed", 0.0, 0.6),
    (8, "This is a great ಉತ್ಪನ್ನ for daily use", "mixed", 0.233333, 0.766667),
    (9, "नमस्ते यह बहुत अच्छा है", "unknown", 0.0, 0.0),
    (10, "123456789", "unknown", 0.0, 0.0),
    (11, "   ", "unknown", 0.0, 0.0),
]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[*]").appName("vimarsha-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from vimarsha.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def phrases(spark):
    return spark.createDataFrame([(p[0], p[1]) for p in PHRASES], "pid int, text string")


def one_col(spark, values, name="text"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} string")
