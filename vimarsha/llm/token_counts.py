"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch of changes inserts, deletes or revises documents' counts. Each change becomes signed rows (+1 document and
+n tokens, or -1 and -n), and a batch's signed rows are summed by key into a small table of deltas, partial
sums first, so that a source with a third of all rows is no hot spot. The deltas are written into a folder named
after the batch; Spark's success mark at the end of the write is the commit. A batch that is already
committed is skipped, one that broke off is written again over its remains: either way it counts once. Totals
are the sums of all committed deltas, so that their cost follows the number of keys and batches, not of documents.

Defined cases: a NULL text has no tokens; NULL sources, languages and versions are keys like others; NULL counts are
0; a change whose ``op`` is none of the three ends the commit with an error; repeated rows are repeated changes;
keys whose documents and tokens have come to zero drop out of the totals; an empty batch commits no deltas; other
columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .bpe import encoder

KEYS = ["source", "lang", "version"]
_DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"
_ALNUM = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


def count_tokens(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` and the counts of its whole texts: ``words`` (between white space), ``named`` (words
    with a letter, digit or non-ASCII character) and ``bpe`` (tokens of the vocabulary at ``ranks_path``)."""
    others = [c for c in docs.columns if c != text and c.lower() not in ("words", "named", "bpe")]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*[docs[f"`{c}`"] for c in others]).dtypes)

    def run(batches):
        enc = encoder(ranks_path)
        for b in batches:
            texts = b.column(len(others))
            bpe = [np.diff(bounds) for _, _, bounds in enc.batches(texts)]
            words, named = [], []
            for w in tv.words(texts, lower=False):
                signs = np.zeros(len(w.data) + 1, np.int64)
                np.cumsum(_ALNUM[w.data], out=signs[1:])
                good = np.zeros(len(w.starts) + 1, np.int64)
                np.cumsum(signs[w.ends] > signs[w.starts], out=good[1:])
                words.append(np.diff(w.bounds))
                named.append(good[w.bounds[1:]] - good[w.bounds[:-1]])
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(others))] + [
                pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (words, named, bpe)], [*others, "words", "named", "bpe"])
    return docs.select(*[docs[f"`{c}`"] for c in others], docs[f"`{text}`"]).mapInArrow(
        run, (schema + ", " if schema else "") + "words long, named long, bpe long")


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows (source, lang, version, n_docs, n_tokens) of changes (source, lang, version, op, n_tokens,
    old_tokens). A revision takes ``old_tokens`` back and adds ``n_tokens``; its document stays."""
    n, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
    op = F.col("op")
    return changes.select(
        *[F.col(k).cast("string").alias(k) for k in KEYS],
        F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(
            F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("NULL")))).cast("int")).cast("long").alias("n_docs"),
        F.when(op == "insert", n).when(op == "delete", -n).otherwise(n - old).alias("n_tokens"))


class Rollup:
    """Totals in a folder that all executors share; ``root`` is any path that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Ids of the committed batches."""
        path, fs = self._path()
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(x.removeprefix("batch-") for x in found if x.startswith("batch-") and self.is_committed(x.removeprefix("batch-")))

    def is_committed(self, batch: str) -> bool:
        path, fs = self._path(f"batch-{batch}", "_SUCCESS")
        return bool(fs.exists(path))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes once; false if it was there before. Keys' deltas are few: one file."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.is_committed(batch):
            return False
        deltas = signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        deltas.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) over all committed batches."""
        batches = [f"{self.root}/batch-{b}" for b in self.committed()]
        rows = self.spark.read.schema(_DELTAS).parquet(*batches) if batches else self.spark.createDataFrame([], _DELTAS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter(
            "n_docs <> 0 or n_tokens <> 0")
