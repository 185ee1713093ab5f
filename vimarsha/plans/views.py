"""Derived views over the given tables, in Spark and as DuckDB SQL.

The review view (FIXTURES section 3): documents joined with labels; review columns renamed
from document columns; rating, ground truth and prediction derived by fixed arithmetic.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import rating_to_sentiment
from ..session import spread
from .catalog import table

REVIEW_SQL = """rv AS (
  SELECT d.doc_id AS review_id, d.text AS review, d.source AS product_category, d.lang AS script_type,
         1 + d.doc_id % 5 AS rating,
         CASE WHEN 1 + d.doc_id % 5 >= 4 THEN 'Positive' WHEN 1 + d.doc_id % 5 <= 2 THEN 'Negative'
              ELSE 'Neutral' END AS ground_truth,
         CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive' ELSE 'Neutral' END AS predicted_label,
         (d.n_chars % 1000)::DOUBLE / 1000.0::DOUBLE AS confidence_score,
         CASE WHEN d.doc_id % 7 = 0 THEN 'Language is ''mixed''; slow' ELSE '' END AS errors,
         CASE WHEN d.doc_id % 11 = 0 THEN 'skipped' WHEN d.doc_id % 13 = 0 THEN 'error'
              WHEN d.doc_id % 7 = 0 THEN 'ok_with_warnings' ELSE 'ok' END AS status,
         CASE WHEN l.toxic = 1 THEN 'Negative' WHEN l.quality = 1 THEN 'Positive' ELSE 'Neutral' END
           = CASE WHEN 1 + d.doc_id % 5 >= 4 THEN 'Positive' WHEN 1 + d.doc_id % 5 <= 2 THEN 'Negative'
              ELSE 'Neutral' END AS correct
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def review_view(spark, sf, with_text: bool = True):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    if not with_text:
        d = d.drop("text")
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id")
    rating = (F.col("doc_id") % 5 + 1).cast("int")
    pred = (F.when(F.col("toxic") == 1, "Negative").when(F.col("quality") == 1, "Positive").otherwise("Neutral"))
    errors = F.when(F.col("doc_id") % 7 == 0, F.lit("Language is 'mixed'; slow")).otherwise(F.lit(""))
    out = j.select(
        F.col("doc_id").alias("review_id"),
        *([F.col("text").alias("review")] if with_text else []),
        F.col("source").alias("product_category"), F.col("lang").alias("script_type"),
        rating.alias("rating"), rating_to_sentiment(rating).alias("ground_truth"), pred.alias("predicted_label"),
        ((F.col("n_chars") % 1000).cast("double") / 1000.0).alias("confidence_score"),
        errors.alias("errors"),
        F.when(F.col("doc_id") % 11 == 0, "skipped").when(F.col("doc_id") % 13 == 0, "error")
         .when(F.col("doc_id") % 7 == 0, "ok_with_warnings").otherwise("ok").alias("status"),
    )
    return out.withColumn("correct", F.col("ground_truth").eqNullSafe(F.col("predicted_label")))


def docs(spark, sf, cols=("doc_id", "text")):
    return spread(table(spark, sf, "documents").select(*cols))


# --------------------------------------------------------------------------- texts in every script
# The given documents hold Latin prose only. Each document, whole, becomes a text that takes one of the routes, by its
# id: as it is; in Kannada script and in romanized Kannada, word by word through the dictionaries' entries; half and
# half; without letters.
def _entries() -> tuple[list[str], list[str]]:
    from ..functions import lexicon as LX
    return list(LX.native_lookup()), list(LX.roman_lookup())


def _texts_sql() -> str:
    from . import sqlfrag as S
    native, roman = _entries()
    words = S.split_ws(S.strip("text"))

    def through(entries):
        items = ", ".join("'" + e.replace("'", "''") + "'" for e in entries)
        return f"array_to_string(list_transform({words}, lambda w: [{items}][1 + length(w) % {len(entries)}]), ' ')"
    return f"""(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN {through(native)} WHEN 2 THEN {through(roman)}
      WHEN 3 THEN text || ' ' || {through(native)} ELSE regexp_replace(text, '\\pL+', '', 'g') END AS text FROM documents) AS texts"""


TEXTS_SQL = _texts_sql()


def in_every_script(df):
    """(doc_id, text) of documents or a stream of them, each text in the script of its route."""
    from ..functions import batches as B
    native, roman = _entries()
    v = F.col("doc_id") % 5
    in_native = B.by_length(F.when(v.isin(1, 3), F.col("text")), native)
    text = (F.when(v == 0, F.col("text")).when(v == 1, in_native).when(v == 2, B.by_length(F.when(v == 2, F.col("text")), roman))
            .when(v == 3, F.concat("text", F.lit(" "), in_native)).otherwise(F.regexp_replace("text", r"\p{L}+", "")))
    return df.select("doc_id", text.alias("text"))


def texts(spark, sf):
    return in_every_script(docs(spark, sf))
