"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Every benchmark item of L words (A-Z lower-cased) has a 64-bit SimHash of its words. In a document, the
windows of L consecutive words get theirs by prefix sums of the words' bit votes; a document of fewer words is
one window. A multi-index over four 16-bit blocks finds the items of that length whose fingerprints lie within ``RADIUS``
bits: each block is entered with all values that differ in a quarter of the radius at most, and a pair within the radius
agrees so far in at least one block. At a similarity of 0.8 about a ninth of the words differ, which changes 10 of 64 bits
with a deviation of 3, while unrelated texts differ in 32 with a deviation of 4.
Candidates are verified exactly by the weighted Jaccard similarity of the bags of 5-word shingles, a shingle weighing
its words' bytes. Windows that hold no shingle of any item are passed over: their similarity to all of them is 0.

Documents are scanned where they lie, without a shuffle. The benchmark is read in blocks of bounded size, each
a broadcast index; a larger one costs more scans, never memory.

A document matches an item when a window lies within the radius and reaches the similarity; the radius bounds a
probability, so an edited copy can be missed (the README states the recall). Defined cases:
an item of fewer than five words is one shingle; items or documents that are NULL or hold no words match
nothing; ties go to the first window; repeated rows and repeated items are each reported; rows without an id are
reported with a NULL id; an empty table or benchmark gives no match; other columns pass through or are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

WORDS = 5
RADIUS = 19
SIMILARITY = 0.8
#: Characters of benchmark text in one broadcast index.
BLOCK_CHARS = 1_000_000
_FILTER_BITS = 22
#: Windows that are looked up in the multi-index at a time.
_LOOKUPS = 1 << 14
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHash of the windows hashes[s:s + length]: bit i is set where more words have bit i than not."""
    votes = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(((hashes[:, None] & _BITS) != 0).astype(np.int8) * 2 - 1, axis=0, out=votes[1:], dtype=np.int32)
    return _folded(votes, starts, length)


def _folded(votes: np.ndarray, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    bits = votes[starts + length] - votes[starts] > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: Counter, b: Counter, weight: dict) -> float:
    """Weighted Jaccard of two bags of shingles."""
    both = sum(weight[s] * min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(weight[s] * n for s, n in a.items()) + sum(weight[s] * n for s, n in b.items()) - both
    return both / total if total else 0.0


def _bag(h: np.ndarray, widths: np.ndarray, k: int, weight: dict) -> Counter:
    """The bag of k-word shingles of a run of words; notes their weights."""
    keys = tv.combine(h, k).tolist()
    size = np.convolve(widths, np.ones(k, np.int64), "valid").tolist()
    weight.update(zip(keys, size))
    return Counter(keys)


class Index:
    """Fingerprints and shingles of a block of benchmark items, by length in words."""

    def __init__(self, items: list[tuple[int, str | None]], radius: int = RADIUS, least: float = SIMILARITY, k: int = WORDS):
        self.radius, self.least, self.k = radius, least, k
        self.ids = [i for i, _ in items]
        self.weight: dict[int, int] = {}
        self.bags: list[Counter] = []
        by_length: dict[int, list[tuple[int, int]]] = {}
        shared: dict[int, list[np.ndarray]] = {}
        at = 0
        for w in tv.words(pa.array([t for _, t in items], pa.string())):
            for i in range(len(w.bounds) - 1):
                a, b = w.bounds[i], w.bounds[i + 1]
                n, h = int(b - a), w.hashes[a:b]
                size = min(k, n)
                self.bags.append(_bag(h, (w.ends - w.starts)[a:b], size, self.weight) if n else Counter())
                if n:
                    by_length.setdefault(n, []).append((at, int(fingerprints(h, np.zeros(1, np.int64), n)[0])))
                    shared.setdefault(size, []).append(tv.combine(h, size))
                at += 1
        self.shared = {size: np.unique(np.concatenate(x)) for size, x in shared.items()}
        self.maybe = {size: self._filter(x) for size, x in self.shared.items()}
        self.total = np.array([sum(self.weight[s] * c for s, c in bag.items()) for bag in self.bags], np.float64)
        self.keys = [np.array(sorted(bag), np.uint64) for bag in self.bags]
        self.lengths = {n: (np.array([x for x, _ in found]), np.array([x for _, x in found], np.uint64)) for n, found in by_length.items()}
        values = np.arange(1 << 16)
        self.flips = values[np.bitwise_count(values) <= radius // 4].astype(np.uint16)
        self.blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.looked_up = 0

    def _multi_index(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per block: values in order, and the place of the item of length n that each leads to. Made when first needed."""
        if n not in self.blocks:
            fp = self.lengths[n][1]
            self.blocks[n] = []
            for j in range(4):
                value = ((fp >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.uint16)[:, None] ^ self.flips
                order = np.argsort(value.ravel(), kind="stable")
                self.blocks[n].append((value.ravel()[order], (order // len(self.flips)).astype(np.int32)))
        return self.blocks[n]

    @staticmethod
    def _filter(h: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << _FILTER_BITS, bool)
        out[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return out

    def _near(self, fp: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item of length n) pairs within the radius, by the multi-index."""
        of, blocks = self.lengths[n][1], self._multi_index(n)
        out = [np.zeros((0, 2), np.int64)]
        for first in range(0, len(fp), _LOOKUPS):
            part, found = fp[first:first + _LOOKUPS], []
            for j, (values, owner) in enumerate(blocks):
                v = ((part >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.uint16)
                lo, hi = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
                count = hi - lo
                win = np.repeat(np.arange(len(part)), count)
                own = owner[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
                near = np.bitwise_count(part[win] ^ of[own]) <= self.radius
                found.append(win[near] * len(of) + own[near])
                self.looked_up += len(win)
            pair = np.unique(np.concatenate(found))
            out.append(np.stack([pair // len(of) + first, pair % len(of)], 1))
        win, own = np.concatenate(out).T
        return win, own

    @staticmethod
    def _starts(p: np.ndarray, n: int, size: int, first: np.ndarray, last: np.ndarray, used: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Windows of n words that hold a benchmark shingle of ``size`` words at one of the places p of documents that go from
        first to last (by place of p); a document of fewer words is one window."""
        short = last - first < n
        low = np.where(short, first, np.maximum(first, np.minimum(p + size, last) - n))
        high = np.where(short, first, np.maximum(np.minimum(p, last - n), low))
        mark = np.bincount(dense[low], minlength=len(used) + 1)[:len(used) + 1] - np.bincount(dense[high] + 1, minlength=len(used) + 1)[:len(used) + 1]
        return used[np.flatnonzero(np.cumsum(mark[:-1]) > 0)]

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(row, item, first word, words, differing bits, similarity): the best window of each match."""
        for w in tv.words(texts):
            doc = w.doc_of()
            first, last = w.bounds[doc], w.bounds[doc + 1]
            places: dict[int, np.ndarray] = {}
            shingles: dict[int, np.ndarray] = {}
            held: dict[int, np.ndarray] = {}       # running weight of the benchmark's shingles,
            whole: dict[int, np.ndarray] = {}      # and of all
            near = np.zeros(len(w.hashes) + 1, np.int32)
            ends = np.r_[0, np.cumsum(w.ends - w.starts)]
            widest = max(self.lengths)
            for size, known in self.shared.items():
                h = tv.combine(w.hashes, size)
                p = np.flatnonzero(self.maybe[size][(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                place = np.searchsorted(known, h[p])
                p = p[(known[np.minimum(place, len(known) - 1)] == h[p]) & (p + size <= last[p])]
                if len(p):
                    places[size], shingles[size] = p, h
                    whole[size] = np.r_[0, np.cumsum(ends[size:] - ends[:-size]), np.zeros(size + 1, np.int64)]
                    held[size] = np.zeros(len(w.hashes) + 2)
                    held[size][p + 1] = ends[p + size] - ends[p]
                    np.cumsum(held[size], out=held[size])
                    near += np.bincount(np.maximum(first[p], p - widest), minlength=len(near))
                    near -= np.bincount(np.minimum(last[p], p + size + widest), minlength=len(near))
            if not places:
                continue
            # the words around these places, in one dense matrix of running votes
            used = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            dense = np.zeros(len(w.hashes) + 1, np.int64)
            dense[used] = np.arange(len(used))
            votes = np.zeros((len(used) + 1, 64), np.int16 if len(used) < 1 << 15 else np.int32)
            np.cumsum(((w.hashes[used][:, None] & _BITS) != 0).astype(np.int8) * 2 - 1, axis=0, out=votes[1:], dtype=votes.dtype)
            best: dict[tuple[int, int], tuple] = {}
            for n, (item, of) in self.lengths.items():
                size = min(self.k, n)
                if size not in places:
                    continue
                p = places[size]
                starts = self._starts(p, n, size, first[p], last[p], used, dense)
                sizes = np.minimum(n, last[starts] - starts)
                fp = _folded(votes, dense[starts], sizes)
                win, own = self._near(fp, n)
                # what a window shares with an item weighs no more than the benchmark's shingles in it
                a = starts[win]
                b = a + np.maximum(sizes[win] - size, 0) + 1
                shared = held[size][b] - held[size][a]
                most = shared / np.maximum(shared, self.total[item[own]] + whole[size][b] - whole[size][a] - shared)
                ok = np.flatnonzero(most >= self.least - 1e-9)
                for j in ok[np.argsort(-most[ok], kind="stable")].tolist():
                    x, y = int(win[j]), int(own[j])
                    s, m = int(starts[x]), int(sizes[x])
                    key = (w.first + int(doc[s]), int(item[y]))
                    if key in best and most[j] < -best[key][0] - 1e-9:
                        continue
                    # cheaply for this item alone, before the bags are compared
                    own_hashes = self.keys[item[y]]
                    h = shingles[size][s:s + m - size + 1]
                    at = np.minimum(np.searchsorted(own_hashes, h), len(own_hashes) - 1)
                    wide = ends[s + size:s + m + 1] - ends[s:s + m - size + 1]
                    common = int(wide[own_hashes[at] == h].sum())
                    if common < self.least * (self.total[item[y]] + int(wide.sum()) - common) - 1e-6:
                        continue
                    weight: dict[int, int] = {}
                    bag = _bag(w.hashes[s:s + m], (w.ends - w.starts)[s:s + m], size, weight)
                    known = self.bags[item[y]]
                    weight.update((q, self.weight[q]) for q in known)
                    sim = similarity(bag, known, weight)
                    if sim >= self.least:
                        row = (-sim, s - int(first[s]), m, int(np.bitwise_count(fp[x] ^ of[y])))
                        best[key] = min(best.get(key, row), row)
            for (row, i), (sim, s, n, bits) in sorted(best.items()):
                yield row, i, s, n, bits, -sim


def blocks(benchmark: DataFrame, id_col: str = "item_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list]:
    """The benchmark as lists of (id, text) of bounded size."""
    items = benchmark.select(benchmark[f"`{id_col}`"].cast("long").alias("id"), benchmark[f"`{text}`"].alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else items
        yield [(x["id"], x["text"]) for x in part.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id",
               item_text: str = "text", block_chars: int = BLOCK_CHARS, **options) -> DataFrame:
    """One row for each row of ``docs`` and item that match: id, item_id, first_word, n_words, bits, similarity."""
    spark, out = docs.sparkSession, None
    schema = f"`{id_col}` long, item_id long, first_word int, n_words int, bits int, similarity double"
    rows = docs.select(docs[f"`{id_col}`"].cast("long"), docs[f"`{text}`"])
    for items in blocks(benchmark, item_col, item_text, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            index = Index(shared.value, **options)
            for b in batches:
                found = list(index.search(b.column(1))) if index.shared else []
                if found:
                    row, item, start, n, bits, sim = zip(*found)
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array(row)), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(start, pa.int32()),
                        pa.array(n, pa.int32()), pa.array(bits, pa.int32()), pa.array(sim, pa.float64())],
                        [id_col, "item_id", "first_word", "n_words", "bits", "similarity"])
        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text",
               block_chars: int = BLOCK_CHARS, **options) -> DataFrame:
    """The rows of ``docs`` that match no benchmark item, unchanged and where they lie."""
    at = docs.columns.index(text)
    for items in blocks(benchmark, item_col, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            index = Index(shared.value, **options)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                if index.shared:
                    keep[[x[0] for x in index.search(b.column(at))]] = False
                yield b.filter(pa.array(keep))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
