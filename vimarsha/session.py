"""Session helpers: build a local session for tests, resolve the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "vimarsha") -> SparkSession:
    """Return the active session, or build one with AQE on (tests, bench, local runs).

    On a cluster the session is created by the submitter; this only fills in what is unset.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(SCAN_PARTITIONS, cpus)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Only a local session (tests, bench) gets a scratch folder of
    its own when that is unset; on a cluster executors could not read one another's files, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="vimarsha-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared checkpoint folder: computed once, read as often as needed, survives lost
    executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Optional setting: so many partitions for scans of files too small to be split (bench on one machine).
SCAN_PARTITIONS = "spark.vimarsha.scan.partitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deals rows over ``partitions`` tasks, as the caller or the session's setting asks; else a batch over two tasks a core
    where the scan has fewer than cores, as of files of few row groups, and leaves any other scan as it is."""
    n = partitions or int(df.sparkSession.conf.get(SCAN_PARTITIONS, "0"))
    if not n and not df.isStreaming:
        cores = df.sparkSession.sparkContext.defaultParallelism
        n = 2 * cores if df.rdd.getNumPartitions() < cores else 0
    return df.repartition(n) if n else df
