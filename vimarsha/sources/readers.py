"""Readers and writers for review tables.

Schemas are explicit at both ends (no inference in production paths). Everything is a Spark
reader or writer; nothing is read into the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as FV
from ..functions.labels import normalize_label, rating_to_sentiment
from .columns import missing_column

REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("review", T.StringType()),
    T.StructField("product_category", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("script_type", T.StringType()),
])

LABELLED_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in
                                ["INDIC REVIEW", "ENGLISH REVIEW", "CATEGORY", "SUB-CATEGORY", "PRODUCT", "BRAND",
                                 "LABEL", "_split"]])


_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "lineSep": "\n"}
_BAD = "_vm_record"


def read_csv_by_header(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """CSV columns found by their names in the header and cast to the schema: (good rows, bad rows).

    Columns that the schema does not name go; those that the header lacks are NULL, but for ``required`` ones, whose absence
    raises S7's error. An empty field is NULL, quoted or not. Bad rows (record, reason, file) have another number of fields than the header or a value that does
    not fit its type. Files of one path share a header; a file with another one is an error, not a misread column.
    """
    header = [h.lstrip("\ufeff") for h in spark.read.options(**_CSV).csv(path).columns]
    for name in required or []:
        if name not in header:
            raise ValueError(missing_column(name, header))
    text = T.StructType([T.StructField(h, T.StringType()) for h in header] + [T.StructField(_BAD, T.StringType())])
    raw = spark.read.schema(text).options(**_CSV, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD, enforceSchema=False,
                                          columnPruning=False).csv(path)
    def field(f):
        if f.name not in header:
            return F.lit(None).cast(f.dataType)
        c = F.col(f"`{f.name}`")
        return c if isinstance(f.dataType, T.StringType) else F.btrim(c).try_cast(f.dataType)
    values = F.struct(*[field(f).alias(f.name) for f in schema])
    odd = [f.name for f in schema if f.name in header and not isinstance(f.dataType, T.StringType)]
    unfit = F.concat_ws(", ", *[F.when(F.col(f"`{n}`").isNotNull() & (F.btrim(F.col(f"`{n}`")) != "") & values[n].isNull(), F.lit(n)) for n in odd])
    reason = (F.when(F.col(_BAD).isNotNull(), "another number of fields than the header")
              .when(unfit != "", F.concat(F.lit("no value of its type: "), unfit)))
    record = F.coalesce(F.col(_BAD), F.to_json(F.struct(*[F.col(f"`{h}`") for h in header])))
    checked = raw.select(values.alias("_v"), reason.alias("_r"), record.alias("_rec"), F.col("_metadata.file_path").alias("_f"))
    good = checked.filter("_r IS NULL").select("_v.*")
    bad = checked.filter("_r IS NOT NULL").select(F.col("_rec").alias("record"), F.col("_r").alias("reason"), F.col("_f").alias("file"))
    return good, bad


def read_reviews_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, quarantine: str | None = None,
                     required: list[str] | None = None) -> DataFrame:
    """CSV with header; quoted fields may span lines. With a schema, columns are bound by their names and bad rows are
    left out (see ``read_csv_by_header``); ``quarantine`` names a folder that gets them."""
    if schema is None:
        return spark.read.options(**_CSV, inferSchema=True).csv(path)
    good, bad = read_csv_by_header(spark, path, schema, required)
    if quarantine:
        bad.write.mode("append").json(quarantine)
    return good


def read_reviews_json(spark: SparkSession, path: str, schema: T.StructType = REVIEW_SCHEMA) -> DataFrame:
    """A JSON array of review objects per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_labelled_jsonl(spark: SparkSession, path: str, source: str = "IndicSentiment") -> DataFrame:
    """S3: JSON lines; blank lines and records with an empty LABEL are skipped.

    The id is ``indic_<physical line number>`` (1-based, blank lines counted). Lines are numbered in the JVM: a
    file's splits are counted, their prefix sums are a table of one row per split, and a line's number is its
    split's offset plus its place in the split, which its generated id holds.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(splits.withColumn("before", before), ["file", "block"]).select(
        "line", (F.col("before") + F.col("id") - F.col("first")).alias("idx"))
    parsed = lines.filter(F.regexp_replace("line", r"^\s+|\s+$", "") != "").select(
        (F.col("idx") + 1).alias("line_no"), F.from_json("line", LABELLED_SCHEMA).alias("r"))
    parsed = parsed.filter(F.col("r.LABEL").isNotNull() & (F.col("r.LABEL") != ""))
    out = parsed.select(
        F.concat(F.lit("indic_"), F.col("line_no").cast("string")).alias("review_id"),
        F.col("r.`INDIC REVIEW`").alias("review"),
        *[F.coalesce(F.col(f"r.`{src}`"), F.lit("")).alias(dst) for src, dst in FV.LABEL_FIELD_RENAMES
          if dst not in ("review", "split")],
        normalize_label(F.col("r.LABEL"), strict=True).alias("ground_truth"),
        F.lit("Kannada Script").alias("script_type"),
        F.lit(source).alias("source"),
        F.coalesce(F.col("r._split"), F.lit("unknown")).alias("split"),
    )
    return out


def merge_splits(spark: SparkSession, paths: dict[str, str], schema: T.StructType | str) -> DataFrame:
    """Read per-split JSON lines files of a given schema and tag each row with ``_split``."""
    out = None
    for split, path in paths.items():
        df = spark.read.schema(schema).json(path).withColumn("_split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Arrays joined to text first (CSV holds no arrays), header on."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.array_join(F.col(f.name).cast("array<string>"), ", ").alias(f.name))
        elif isinstance(f.dataType, (T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    # blanks at the ends of a value are part of it
    (df.select(*cols).write.mode(mode).options(header=True, quote='"', escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False,
                                               ignoreTrailingWhiteSpace=False).csv(path))


def write_report(df: DataFrame, path: str, alias: str | None = None) -> None:
    """Nested report as JSON; optional second copy under a "latest" alias."""
    df.write.mode("overwrite").json(path)
    if alias:       # the copy is read back, so that the report is computed once
        df.sparkSession.read.schema(df.schema).json(path).write.mode("overwrite").json(alias)


def load_training(spark: SparkSession, train: str, val: str | None = None, text_column: str = "text",
                  label_column: str = "label", quarantine: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Labelled training CSV (and optional validation CSV) as (text, label), columns found by their names; a file without
    one of them raises S7's error. Without a validation file ``train_sentiment`` holds rows out itself."""
    schema = T.StructType([T.StructField(text_column, T.StringType()), T.StructField(label_column, T.StringType())])

    def one(p):
        df = read_reviews_csv(spark, p, schema, quarantine, [text_column, label_column])
        return df.select(F.col(f"`{text_column}`").alias("text"), F.col(f"`{label_column}`").alias("label"))
    return one(train), (one(val) if val else None)


def load_eval_set(*frames: DataFrame, add_ground_truth: bool = True) -> DataFrame:
    """Bag union of review tables (by name) plus the rating-derived ground truth."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("ground_truth", rating_to_sentiment("rating")) if add_ground_truth else out


def clean_labelled(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Drop rows without text or label; label as string."""
    return df.dropna(subset=[text, label]).withColumn(label, F.col(label).cast("string"))
