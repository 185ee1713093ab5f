"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, read_table  # noqa: F401

#: ASCII white space; a word is a run of anything else.
BLANKS = " \t\n\x0b\f\r"
#: Spark's setting for removing a query's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of at most about 24 bytes that may be broadcast; above it the plans shuffle instead.
BROADCAST_ROWS = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors. Nothing reads the shuffles of its query
    again, so their files go when it is written and do not add up over an operator's steps."""
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    had = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEANUP) if had is None else conf.set(CLEANUP, had)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Empties tables that ``saved`` wrote and that no later plan reads: their files leave the shared folder."""
    for df in tables:
        files = df.inputFiles()
        if files:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rsplit("/", 1)[0])


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a saved narrow table for broadcast if its counted rows stay within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def rows_where(df: DataFrame, flag: Column) -> DataFrame:
    """The rows whose computed flag is true, the flag computed once. A plain filter would be pushed below the projections
    that make its inputs and repeat them, lambdas included; nothing is pushed below a generated column."""
    return df.withColumn("_stay", F.explode_outer(F.when(flag, F.array(F.lit(True))))).filter("_stay").drop("_stay")


def trimmed(text: Column | str) -> Column:
    return F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(BLANKS))


def words(text: Column | str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; NULL has none."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def crc32_text(column: Column | str) -> Column:
    """CRC-32 of a value's decimal text, for folds."""
    return F.crc32((F.col(column) if isinstance(column, str) else column).cast("string").cast("binary"))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, each found by its exact name first, else but for case. Columns are renamed by their places
    before, so that extra columns whose names differ in case only do not clash."""
    names, lower = df.columns, [c.lower() for c in df.columns]
    at = [names.index(c) if c in names else lower.index(c.lower()) for c in columns]
    return df.toDF(*[f"_{i}" for i in range(len(names))]).select(*[F.col(f"_{i}").alias(c) for i, c in zip(at, columns)])
