"""The batch operators on Structured Streaming.

``analyze`` is stateless and row-local, so the same function runs on a streaming DataFrame
(R1). ``running_counts`` keeps state bounded by the four status values (R2) and needs no
watermark. Sinks checkpoint under the cluster's shared ``spark.checkpoint.dir`` so a restarted
query resumes exactly where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pipeline import analyze
from ..session import ensure_checkpoint_dir, spread

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def read_stream(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_SCHEMA,
                max_files_per_trigger: int | None = None, partitions: int | None = None) -> DataFrame:
    """Parquet files arriving under ``path`` as a stream (explicit schema, as streams require).

    ``path`` may be a directory or a glob; a single file is read through a glob on its name so
    the directory holding it is the base path. ``partitions`` deals each micro-batch over so many tasks.
    """
    import os
    r = spark.readStream.schema(schema)
    if path.endswith(".parquet") and "*" not in path and "[" not in path:
        head, tail = os.path.split(path.rstrip("/"))
        path = f"{head}/{tail[:-1]}[{tail[-1]}]"
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return spread(r.parquet(path), partitions)


def analyze_stream(sdf: DataFrame, text_col: str = "text", keep: list[str] | None = None, **kw) -> DataFrame:
    """The batch ``analyze`` on a stream (no state, append mode)."""
    return analyze(sdf, text_col, keep=keep, **kw)


def running_counts(sdf: DataFrame, text_col: str = "text") -> DataFrame:
    """R2: rows per status so far (complete mode; state = 4 keys)."""
    return analyze(sdf, text_col).groupBy("status").agg(F.count("*").alias("n"))


def run_to_table(sdf: DataFrame, name: str | None = None, mode: str = "append",
                 checkpoint: str | None = None) -> DataFrame:
    """Drain everything available (``availableNow``) into a Parquet table in the shared folder and read it back.

    Append mode uses the file sink, whose log makes each micro-batch appear once; a complete-mode result
    replaces the table with every micro-batch. Nothing passes through the driver.
    """
    spark = sdf.sparkSession
    name = name or f"vm_stream_{uuid.uuid4().hex[:8]}"
    root = ensure_checkpoint_dir(spark).rstrip("/")
    ckpt, table = checkpoint or f"{root}/streams/{name}", f"{root}/stream-tables/{name}"
    writer = sdf.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", table).start()
    else:
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(table)).start()
    q.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(table)
