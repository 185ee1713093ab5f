"""Exact top-k search by inner product: MaxScore over the signed terms of integer vectors.

A term is a dimension with a sign; its posting list holds the vectors whose component has that sign, with the greatest
magnitude as its bound. A query adds to a score only through terms of its own components' signs; terms of the opposite
sign subtract. With the k-th best score so far as the threshold, the query's terms, strongest bound first, split into
essential ones and a rest whose bounds together stay below the threshold: a vector in no essential list cannot enter
the result. Essential lists are traversed and added up; the vectors found are then probed in the other terms, the
subtracting ones first, as long as what they have and the bounds that are left reach the threshold. Below zero (or
with no threshold yet) every vector is a candidate, for a vector without any term scores zero.

Spark deals vectors over cells of about ``CELL_VECTORS`` and queries over blocks of about ``BLOCK_QUERIES``; each pair of
cell and block is one stretch of a sorted partition, its queries first, then the vectors in Arrow batches, each of which
is a shard with its own lists. Each stretch returns its best k a query, found with thresholds that a first search of one
cell has set for all. The shards' results are merged by one ranking per query.

Defined cases: vectors that are NULL, hold NULL, NaN or infinite components or have no id take no part; vectors of
different lengths are compared on the dimensions both have; components beyond ``LIMIT`` count as ``LIMIT``; of rows that
repeat an id, the least vector counts; ties go to the smaller id; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, saved

K = 10
SCALE = 1024
#: Scores of 2^14 dimensions stay within 63 bits.
LIMIT = 1 << 24
CELL_VECTORS = 8_192
BLOCK_QUERIES = 16_384
#: Vectors of a shard: one set of posting lists.
SHARD = 4_096
_NONE = np.iinfo(np.int64).min


def int_vectors(df: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v) with v the floors of the scaled components; one row an id."""
    x = lambda c: c.cast("double")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    rows = only(df, "vec_id", column).toDF("vec_id", "v").filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite)
    whole = F.transform("v", lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x(c) * scale))).cast("int"))
    return rows.select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


class Shard:
    """Posting lists of a block of vectors, and bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], np.ascontiguousarray(vectors[order].T)
        self.lists = {}
        for d, row in enumerate(self.v):
            for sign in (1, -1):
                at = np.flatnonzero(row > 0 if sign > 0 else row < 0)
                if len(at):
                    self.lists[d, sign] = at, row[at], int(np.abs(row[at]).max())

    def best(self, own: int, q: np.ndarray, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of up to k vectors of other ids with a score of the threshold or more, in no order."""
        dims = [d for d in np.flatnonzero(q).tolist() if d < len(self.v)]
        terms = sorted(((abs(int(q[d])) * lst[2], d, int(q[d]), lst) for d in dims
                        if (lst := self.lists.get((d, 1 if q[d] > 0 else -1)))), key=lambda t: -t[0])
        bounds = np.array([t[0] for t in terms] + [0], np.int64)
        rest = np.cumsum(bounds[::-1])[::-1]  # what the terms from here on can add
        essential = int(np.argmax(rest < threshold)) if threshold > 0 and rest[-1] < threshold else len(terms)
        score, found = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        if threshold <= 0:
            found[:] = True
        for _, _, w, (at, values, _) in terms[:essential]:
            score[at] += w * values
            found[at] = True
        found[np.searchsorted(self.ids, own, "left"):np.searchsorted(self.ids, own, "right")] = False
        left = np.flatnonzero(found & (score >= threshold - rest[essential]))
        score = score[left]
        for d in dims:  # opposite signs only subtract
            if (d, -1 if q[d] > 0 else 1) in self.lists:
                against = q[d] * self.v[d, left]
                score += np.minimum(against, 0)
                if not d % 4:
                    stay = score >= threshold - rest[essential]
                    left, score = left[stay], score[stay]
        for i in range(essential, len(terms)):
            _, d, w, _ = terms[i]
            stay = score >= threshold - rest[i]
            left, score = left[stay], score[stay]
            score = score + np.maximum(w * self.v[d, left], 0)
        stay = score >= threshold
        left, score = left[stay], score[stay]
        if len(left) > k:
            part = np.argpartition(-score, k - 1)
            last = score[part[k - 1]]
            sure, tied = left[score > last], left[score == last]  # in order of ids
            of = np.concatenate([sure, tied[:k - len(sure)]])
            place = np.searchsorted(left, of)
            left, score = of, score[place]
        return score, self.ids[left]


class Best:
    """The best k of one query so far."""

    def __init__(self, key: int, q: np.ndarray, k: int, threshold: int):
        self.key, self.q, self.k, self.threshold = key, q, k, threshold
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, shard: Shard):
        scores, ids = shard.best(self.key, self.q, self.k, self.threshold)
        if len(ids):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            keep = np.lexsort((ids, -scores))[:self.k]
            self.scores, self.ids = scores[keep], ids[keep]
            if len(keep) == self.k:
                self.threshold = max(self.threshold, int(self.scores[-1]))


def _dense(column, width=None):
    """Vectors as rows of one array, missing dimensions zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten().to_numpy().astype(np.int64)
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _search(k: int):
    def results(queries):
        queries = [q for q in queries if len(q.ids)]
        for i in range(0, len(queries), 4096):
            part = queries[i:i + 4096]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([q.key for q in part], [len(q.ids) for q in part]), pa.int64()),
                pa.array(np.concatenate([q.ids for q in part]), pa.int64()), pa.array(np.concatenate([q.scores for q in part]), pa.int64())],
                ["query", "vec_id", "score"])

    def run(batches):
        at, queries, ids, rows = None, [], [], []

        def meet():
            if ids and queries:
                width = max(r.shape[1] for r in rows)
                shard = Shard(np.concatenate(ids), np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows]))
                for q in queries:
                    q.meet(shard)
            ids.clear()
            rows.clear()
        for b in batches:
            if not b.num_rows:
                continue
            stretch = np.stack([b.column(i).to_numpy() for i in range(2)])
            vector = b.column(2).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(stretch) != 0).any(0) | (vector[1:] != vector[:-1])) + 1
            for part in np.split(np.arange(b.num_rows), cut):
                first, n = int(part[0]), len(part)
                key = tuple(stretch[:, first])
                if key != at:
                    meet()
                    yield from results(queries)
                    at, queries = key, []
                keys, values = b.column(3).slice(first, n).to_numpy(), _dense(b.column(4).slice(first, n))
                if not vector[first]:
                    floor = b.column(5).slice(first, n).to_numpy()
                    queries += [Best(int(i), q, k, int(t)) for i, q, t in zip(keys, values, floor)]
                    continue
                for i in range(0, n, SHARD):
                    if ids and sum(map(len, ids)) + len(keys[i:i + SHARD]) > SHARD:
                        meet()
                    ids.append(keys[i:i + SHARD])
                    rows.append(values[i:i + SHARD])
        meet()
        yield from results(queries)
    return run


def _cells(queries: DataFrame, vectors: DataFrame, cells: int, blocks: int, k: int) -> DataFrame:
    """Best k of each query (vec_id, v, floor) in each cell of vectors (vec_id, v), as (query, vec_id, score)."""
    def part(n):
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(every(cells).alias("cell"), part(blocks).alias("block"), F.lit(False).alias("vector"), "vec_id", "v", "floor")
    held = vectors.select(part(cells).alias("cell"), every(blocks).alias("block"), F.lit(True).alias("vector"), "vec_id", "v",
                          F.lit(_NONE).alias("floor"))
    return asked.unionByName(held).repartition("cell", "block").sortWithinPartitions("cell", "block", "vector").mapInArrow(
        _search(k), "query long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, cell_vectors: int = CELL_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query, rank, vec_id, score): for each query (vec_id, v) the k vectors (vec_id, v) of other ids with the greatest inner
    products, ties to the smaller id. Both are tables written before."""
    n, asked = vectors.count(), queries.count()
    cells, blocks = max(1, -(-n // cell_vectors)), max(1, -(-asked // block_queries))
    none = queries.withColumn("floor", F.lit(_NONE))
    first = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(cells)) == 0)
    # the k-th best in one cell bounds the k-th best of all from below
    floors = _ranked(_cells(none, first, 1, blocks, k), k).filter(F.col("rank") == k).select(F.col("query").alias("vec_id"), "score")
    primed = saved(queries.join(floors, "vec_id", "left").select("vec_id", "v", F.coalesce("score", F.lit(_NONE)).alias("floor")), "top-k-queries")
    return _ranked(_cells(primed, vectors, cells, blocks, k), k).select("query", "rank", "vec_id", "score")
