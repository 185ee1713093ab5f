"""Whole-batch word hashing: numpy over the UTF-8 buffer of an Arrow string column.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; A-Z may be lower-cased. Every word gets a
64-bit hash (a polynomial over random byte values, mixed), every run of k words a shingle hash.
Python loops run over chunks of documents, never over words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII bytes that are neither letter nor digit: gaps between the words of a word-only reading.
SIGNS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


@functools.cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n; kept per worker and grown by doubling."""
    if len(_pow.get("p", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            a = np.ones(size, _U)
            done, step = 1, base
            while done < size:
                a[done:2 * done] = a[:done] * _U(step)
                done, step = 2 * done, step * step & _MASK
            _pow[key] = a
    return _pow["p"][:n], _pow["q"][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each run values[start:end] of 64-bit values, by prefix sums."""
    p, q = _powers(len(values) + 1)
    s = np.zeros(len(values) + 1, _U)
    np.cumsum(values * p[:-1], out=s[1:])
    return mix((s[ends] - s[starts]) * q[starts] + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


@dataclass
class Words:
    """Words of a chunk of documents: word j of document i is at bounds[i] + j."""
    first: int               # position of the chunk's first document in the batch
    hashes: np.ndarray       # uint64, one for each word
    bounds: np.ndarray       # documents + 1
    starts: np.ndarray       # byte place of each word in data
    ends: np.ndarray
    data: np.ndarray         # the chunk's bytes
    doc_bytes: np.ndarray    # documents + 1, byte bounds

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, its bytes, byte bounds) for slices of about ``limit`` bytes; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, off, buf = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def words(texts: pa.Array, lower: bool = True, limit: int = CHUNK_BYTES, gaps: np.ndarray = _SPACE) -> Iterator[Words]:
    for first, data, bounds in chunks(texts, limit):
        if lower:
            data = _LOWER[data]
        solid = ~gaps[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.empty_like(solid)
        before[:1] = False
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.empty_like(solid)
        after[-1:] = False
        after[:-1] = solid[1:]
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        yield Words(first, run_hashes(_byte_values()[data], starts, ends), np.searchsorted(starts, bounds),
                    starts, ends, data, bounds)


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries (len(h) - k + 1 of them)."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, _U)
    for i in range(k):
        out += h[i:i + n] * _U(pow(_P, 2 * i + 1, 1 << 64))
    return mix(out + _U(k))


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every k-word shingle, in order; a document of 1 to k - 1 words has its
    whole sequence as its only shingle, one without words has none."""
    n = np.diff(w.bounds)
    doc = w.doc_of()
    at = np.arange(max(0, len(w.hashes) - k + 1))
    ok = at + k <= w.bounds[1:][doc[:len(at)]]
    docs, hashes = [doc[:len(at)][ok]], [combine(w.hashes, k)[ok]]
    for m in range(1, k):
        few = np.flatnonzero(n == m)
        if len(few):
            docs.append(few)
            hashes.append(combine(w.hashes, m)[w.bounds[few]])
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    if len(docs) > 1:
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, ordered by both; documents come in ascending order."""
    h = h.copy()
    cuts = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)]):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[cuts] = True
    return doc[keep], h[keep]


def sums(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Sum of values by document (doc ascending), modulo 2**64 for unsigned values."""
    s = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=s[1:])
    b = np.searchsorted(doc, np.arange(n_docs + 1))
    return s[b[1:]] - s[b[:-1]]
