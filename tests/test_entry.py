"""Driver contract: the flagship entry, the registry, and Spark-vs-DuckDB agreement on a few plans."""

import math

import pytest

from conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def test_entry_runs_with_stable_schema(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["detected_language", "sentiment_label", "n", "share"]
    rows = df.collect()
    assert rows and all(0.0 <= r["share"] <= 1.0 for r in rows)


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["value_counts", "confusion_matrix", "detect_language", "char_frequency"])
def test_query_matches_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as E
    got = E.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(E.oracle_sql()[name])
    want_cols = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(want_cols)
    assert _rows(got.columns, got.collect()) == _rows(want_cols, cur.fetchall())
