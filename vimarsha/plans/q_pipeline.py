"""Plans for the end-to-end operators (T12-T14, P3-P5, A32) over the whole documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.pipeline import analyze, validate_text
from . import sqlfrag as S
from .catalog import register, table
from .views import TEXTS_SQL, in_every_script, texts

ANALYZE_SQL = S.analyze_sql(TEXTS_SQL, "doc_id", "text")


def analyzed(spark, sf):
    return analyze(texts(spark, sf), "text", keep=["doc_id"])


@register("analyze", ANALYZE_SQL)
def q_analyze(spark, sf):
    return analyzed(spark, sf)


@register("route_text", f"""
WITH a AS ({ANALYZE_SQL})
SELECT detected_language, pipeline_steps, errors, count(*) AS n FROM a GROUP BY ALL""")
def q_route_text(spark, sf):
    return analyzed(spark, sf).groupBy("detected_language", "pipeline_steps", "errors").agg(F.count("*").alias("n"))


@register("pipeline_steps", f"""
WITH a AS ({ANALYZE_SQL}), s AS (SELECT unnest(string_split(pipeline_steps, ', ')) AS step FROM a WHERE pipeline_steps <> '')
SELECT step, count(*) AS n FROM s GROUP BY step""")
def q_pipeline_steps(spark, sf):
    steps = F.when(F.col("pipeline_steps") != "", F.split("pipeline_steps", ", ")).otherwise(F.array())
    from ..functions.text import explode_rows
    return explode_rows(analyzed(spark, sf), steps, "step").groupBy("step").agg(F.count("*").alias("n"))


@register("batch_counts", f"""
WITH a AS ({ANALYZE_SQL})
SELECT count(*) FILTER (WHERE status IN ('ok', 'ok_with_warnings')) AS ok,
       count(*) FILTER (WHERE status = 'error') AS error, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM a""")
def q_batch_counts(spark, sf):
    from ..operators.report import batch_counts
    return batch_counts(analyzed(spark, sf))


@register("validate_text", f"""
SELECT doc_id, CASE WHEN text IS NULL THEN 'Expected str, got NoneType'
                    WHEN {S.is_blank('text')} THEN 'Empty or whitespace-only string' END AS skip_reason
FROM (SELECT doc_id, text FROM documents UNION ALL
      SELECT -1 - conv_id * 1000 - turn AS doc_id, CASE WHEN role = 'system' THEN NULL ELSE text END FROM conversations)""")
def q_validate_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    c = table(spark, sf, "conversations").select(
        (F.lit(-1) - F.col("conv_id") * 1000 - F.col("turn")).alias("doc_id"),
        F.when(F.col("role") == "system", F.lit(None).cast("string")).otherwise(F.col("text")).alias("text"))
    return validate_text(d.unionByName(c), "text").select("doc_id", "skip_reason")


# --------------------------------------------------------------------------- R1 / R2 (structured streaming)
@register("analyze_stream", ANALYZE_SQL)
def q_analyze_stream(spark, sf):
    from ..streaming.stream import analyze_stream, read_stream, run_to_table
    sdf = in_every_script(read_stream(spark, f"{sf.rstrip('/')}/documents.parquet"))
    return run_to_table(analyze_stream(sdf, "text", keep=["doc_id"]), mode="append")


@register("running_counts", f"""
WITH a AS ({ANALYZE_SQL}) SELECT status, count(*) AS n FROM a GROUP BY 1""")
def q_running_counts(spark, sf):
    from ..streaming.stream import read_stream, run_to_table, running_counts
    sdf = in_every_script(read_stream(spark, f"{sf.rstrip('/')}/documents.parquet"))
    return run_to_table(running_counts(sdf), mode="complete")
