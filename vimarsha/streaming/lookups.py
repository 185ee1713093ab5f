"""R1 with lookup tables: a stream analyzed with versioned tables that batch jobs publish.

A ``Lookups`` folder holds every published version of a table; a manifest row, appended after the table, makes it
current. Each micro-batch reads the manifest once and is analyzed as a batch with the versions current then, so a
refreshed language profile, word list or translation memory takes effect with the next micro-batch and never within
one. A micro-batch is written to a folder of its number, replaced if it runs again, with the versions it used beside it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.langid import LangIdModel, langid_scores
from ..operators.pipeline import analyze
from ..operators.translate import memory_table
from ..session import ensure_checkpoint_dir

MANIFEST = "name string, version long, path string"


@dataclass
class Lookups:
    """Published tables under a folder that driver and executors share."""

    spark: SparkSession
    root: str

    def current(self) -> dict[str, tuple[int, str]]:
        """Name -> (version, path) of the newest version of each table: one row per table."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
            newest = rows.groupBy("name").agg(F.max(F.struct("version", "path")).alias("_n")).select("name", "_n.*").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            newest = []
        return {r["name"]: (r["version"], r["path"]) for r in newest}

    def publish(self, name: str, df: DataFrame) -> int:
        version = self.current().get(name, (0, ""))[0] + 1
        path = f"{self.root}/{name}/{version}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.spark.createDataFrame([(name, version, path)], MANIFEST).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def publish_langid(self, model: LangIdModel) -> int:
        languages = self.spark.createDataFrame(
            [(*row, i, model.n_min, model.n_max, model.n_grams) for i, row in enumerate(model.languages)],
            "lang string, prior double, denominator double, place int, n_min int, n_max int, n_grams long")
        # profile and languages are one table, so that no micro-batch sees half of a model
        both = model.profile.select("gram", "weights", F.lit(None).cast(
            "struct<lang:string,prior:double,denominator:double,place:int,n_min:int,n_max:int,n_grams:bigint>").alias("language"))
        return self.publish("langid", both.unionByName(languages.select(
            F.lit(None).cast("string").alias("gram"), F.lit(None).cast("array<double>").alias("weights"), F.struct(*languages.columns).alias("language"))))

    def publish_memories(self, memories: list[tuple[str, DataFrame]]) -> int:
        return self.publish("memory", memory_table(memories))

    def read(self, current: dict[str, tuple[int, str]], name: str) -> DataFrame | None:
        return self.spark.read.parquet(current[name][1]) if name in current else None

    def langid(self, current: dict[str, tuple[int, str]]) -> LangIdModel | None:
        table = self.read(current, "langid")
        if table is None:
            return None
        rows = table.filter("language is not null").select("language.*").orderBy("place").collect()  # one per language
        profile = table.filter("gram is not null").select("gram", "weights")
        return LangIdModel(profile, [(r.lang, r.prior, r.denominator) for r in rows], rows[0].n_min, rows[0].n_max, rows[0].n_grams)


def analyze_with(df: DataFrame, lookups: Lookups, text_col: str, key: str, keep: list[str] | None = None,
                 current: dict[str, tuple[int, str]] | None = None, **kw) -> DataFrame:
    """``analyze`` of a batch with the current ``langid``, ``words`` (src, dst) and ``memory`` tables, whichever exist."""
    current = lookups.current() if current is None else current
    model = lookups.langid(current)
    if model is not None:
        df = langid_scores(df, key, model, text_col)
        kw["langid"] = ("langid_lang", "langid_prob")
    return analyze(df, text_col, keep=[key, *(keep or [])], words=lookups.read(current, "words"),
                   memories=lookups.read(current, "memory"), **kw)


def analyze_stream_with(sdf: DataFrame, lookups: Lookups, text_col: str, key: str, name: str, keep: list[str] | None = None, **kw) -> str:
    """Drains what the stream has (``availableNow``); returns the folder of the result. The next call under the same ``name``
    goes on where this one stopped."""
    root = ensure_checkpoint_dir(sdf.sparkSession).rstrip("/")
    table = f"{root}/stream-tables/{name}"

    def each(batch: DataFrame, number: int) -> None:
        current = lookups.current()
        out = analyze_with(batch, lookups, text_col, key, keep, current, **kw)
        out.write.mode("overwrite").parquet(f"{table}/rows/batch={number}")
        used = batch.sparkSession.createDataFrame([(n, v) for n, (v, _) in sorted(current.items())], "name string, version long")
        used.write.mode("overwrite").parquet(f"{table}/versions/batch={number}")
    q = (sdf.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/streams/{name}")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table
