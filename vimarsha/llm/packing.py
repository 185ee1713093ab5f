"""Best-fit packing of tokenised documents into training sequences, improved by a swap-based local search.

Texts become token ids plus an end mark in Arrow batches; documents longer than a sequence are cut into
whole sequences, of which the first piece may be shorter. Pieces carry lengths and checksums, not ids, from
there on. They are dealt into shards of a bounded number of pieces by place in the written table, so that
neither a hot source nor repeated rows make a shard larger; each shard is packed by itself. A shard
wastes less than a sequence or two of tens of thousands.

In a shard, best-fit decreasing gives the first packing. The local search then takes the least filled bin
and moves a document to another underfull bin, or exchanges one for one, or two for one, whenever that
raises the sum of squared fills (what leaves the emptier bin enters the fuller one), until the bin is empty or
no exchange helps; it ends at the lower bound of ceil(tokens / size) bins.

Defined cases: a NULL or empty text is one piece with the end mark alone; repeated rows are packed as
often as they occur; rows without an id are packed with a NULL id; very long texts are cut, never
shortened; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import saved

SIZE = 1024
END_ID = 2
SHARD_PIECES = 50_000


def _cut(ranks_path: str, size: int, end_id: int):
    def run(batches):
        enc = encoder(ranks_path)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for first, ids, bounds in enc.batches(texts):
                rows = len(bounds) - 1
                n = np.diff(bounds) + 1
                count = -(-n // size)
                at = np.repeat(np.arange(rows), count)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                head = (n - (count - 1) * size)[at]
                start = np.where(piece == 0, 0, head + (piece - 1) * size)
                length = np.where(piece == 0, head, size)
                flat = np.insert(ids, bounds[1:], end_id).astype("<u4")
                place = (bounds[:-1] + np.arange(rows))[at] + start
                raw = memoryview(flat.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(place.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([
                    keys.slice(first, rows).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])
    return run


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Best-fit decreasing: items (positions) of each bin. The fitting bin with the least room is found in a
    bit mask of the rooms that occur."""
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    bins: list[list[int]] = []
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        rooms[room - n].append(b)
        if room > n:
            mask |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int, patience: int = 400) -> list[list[int]]:
    """Empties bins by moves and exchanges between underfull ones; see the module. It ends at the lower
    bound, or after ``patience`` bins in a row, least filled first, from which nothing leads further."""
    w = [int(x) for x in lengths]
    fill = [sum(w[i] for i in b) for b in bins]
    least = -(-sum(fill) // size)
    holders: dict[int, set[int]] = defaultdict(set)        # underfull bins by the lengths they can give up:
    by_fill: list[tuple[int, int]] = []                    # one item's or two items'; and by fill

    def sums(b: int) -> set[int]:
        one = [w[i] for i in bins[b]]
        return {*one, *(x + y for k, x in enumerate(one) for y in one[k + 1:])}

    def enter(b: int) -> None:
        if 0 < fill[b] < size:
            insort(by_fill, (fill[b], b))
            for x in sums(b):
                holders[x].add(b)

    def leave(b: int) -> None:
        by_fill.pop(bisect_left(by_fill, (fill[b], b)))
        for x in sums(b):
            holders[x].discard(b)

    def pick(b: int, total: int) -> list[int]:
        """One or two items of bin b with this length in all."""
        seen: dict[int, int] = {}
        for i in bins[b]:
            if w[i] == total:
                return [i]
            if total - w[i] in seen:
                return [seen[total - w[i]], i]
            seen[w[i]] = i
        return []

    def exchange(a: int) -> int:
        """Transfers from bin a to another, the more the better; the other bin, or -1."""
        room = size - min((f for f, b in by_fill[:2] if b != a), default=size)
        best: tuple = (0,)
        for total in sorted(sums(a), reverse=True):
            for net in range(min(room, total), best[0], -1):
                if net == total:                           # a move: the fullest bin with room
                    k = bisect_right(by_fill, (size - net, len(bins))) - 1
                    b = next((by_fill[j][1] for j in range(k, max(-1, k - 2), -1) if by_fill[j][1] != a), None)
                else:
                    b = next((b for b in holders.get(total - net, ()) if b != a and fill[b] + net <= size), None)
                if b is not None and fill[b] + net > fill[a]:
                    best = (net, total, b)
                    break
        if not best[0]:
            return -1
        net, total, b = best
        out, back = pick(a, total), pick(b, total - net) if net < total else []
        leave(a)
        leave(b)
        for x, items, y in ((a, out, b), (b, back, a)):
            for i in items:
                bins[x].remove(i)
                bins[y].append(i)
        fill[a] -= net
        fill[b] += net
        enter(a)
        enter(b)
        return b

    for b in range(len(bins)):
        enter(b)
    left, stuck = len(bins), set()
    while left > least and len(stuck) < patience:
        a = next((b for _, b in by_fill if b not in stuck), None)
        if a is None:
            break
        b = exchange(a)
        if b < 0:
            stuck.add(a)
        else:
            stuck.discard(b)
            if not fill[a]:
                left -= 1
                stuck.clear()
    return [b for b in bins if b]


def pack_lengths(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item; no item is longer than a bin."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    part = np.flatnonzero(lengths < size)
    bins = local_search(best_fit(lengths[part], size), lengths[part], size)
    for b, items in enumerate(bins):
        at = part[np.array(items, np.int64)]
        bin_of[at] = b
        offset[at] = np.cumsum(lengths[at]) - lengths[at]
    whole = np.flatnonzero(lengths == size)
    bin_of[whole] = len(bins) + np.arange(len(whole))
    return bin_of, offset


def pack_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text: str = "text", size: int = SIZE,
                   end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text}`"].alias("text"))
    pieces = saved(docs.mapInArrow(_cut(ranks_path, size, end_id),
                                   "id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def run(key, pdf):
        bins, offset = pack_lengths(pdf["length"].to_numpy(), size)
        return pdf.drop(columns="shard").assign(sequence_id=bins + (int(key[0]) << 40), offset=offset)

    out = dealt.groupBy("shard").applyInPandas(
        run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
