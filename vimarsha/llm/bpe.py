"""Token ids of whole texts under a public byte-level BPE vocabulary, for use inside tasks.

The ids are those that the ``tokenizers`` library gives for the vocabulary's JSON file. Texts are cut
into the pattern's pieces with numpy, and only the pieces not seen before in the task are encoded,
all of them in one call over the same vocabulary's rank file: a few in a hundred of all pieces.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from .textvec import chunks, mix, run_hashes

KEEP = 1_000_000        # distinct pieces that a worker keeps; beyond it, its store starts afresh
_SLOT_SHIFT = np.uint64(43)
_L, _N, _S, _O = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point in the pattern: letter, number, white space, other."""
    out = np.full(0x110000, _O, np.uint8)
    points = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for k, pattern in ((_L, r"\p{L}"), (_N, r"\p{N}"), (_S, r"[\t-\r \x85\xa0  -     　]")):
        found = np.frombuffer("".join(regex.findall(pattern, points)).encode("utf-32-le"), np.uint32)
        out[found] = k
    return out


@functools.cache
def _point_values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


@functools.cache
def _encoding(ranks_path: str):
    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    import public_tokenizers
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}), size


def pieces(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pattern's pieces in code points ``cp`` of documents that begin at ``bounds``."""
    n = len(cp)
    kind = _classes()[cp]
    new = np.zeros(n + 1, bool)
    new[bounds] = True                      # documents never share a piece
    doc_start = new[:-1].copy()
    change = np.empty(n, bool)
    change[:1] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= doc_start
    white = kind == _S
    new[:-1] |= change
    # white space before something else in the same text: its last character stands apart, and a
    # blank there belongs to the piece that follows
    last = white.copy()
    last[:-1] &= ~white[1:] & ~doc_start[1:]
    last[-1:] = False
    at = np.flatnonzero(last)
    new[at] = True
    blank = at[cp[at] == 32]
    new[blank + 1] = False
    # contractions: an apostrophe that starts a piece takes 's 't 'm 'd 're 've 'll from the letters after it
    for a in np.flatnonzero((cp == 39) & new[:-1]):
        stop = bounds[np.searchsorted(bounds, a, "right")]
        tail = "".join(map(chr, cp[a + 1:min(a + 3, stop)]))
        took = 1 if tail[:1] in tuple("stmd") else 2 if tail in ("re", "ve", "ll") else 0
        if took:
            new[a + 1:a + 1 + took] = False
            if a + 1 + took < stop and not new[a + 1 + took]:
                new[a + 1 + took] = True
    return np.flatnonzero(new[:-1])


class Encoder:
    """Ids of texts, chunk by chunk; holds the pieces that this worker has met."""

    def __init__(self, ranks_path: str):
        self.encoding, self.size = _encoding(ranks_path)
        self._reset()

    def _reset(self) -> None:
        self.slot_key = np.zeros(1 << 21, np.uint64)    # a piece at the slot that its hash names
        self.slot_row = np.zeros(1 << 21, np.int64)
        self.known = np.zeros(0, np.uint64)         # sorted hashes of pieces
        self.row = np.zeros(0, np.int64)            # the piece's row in at
        self.at = np.zeros(1, np.int64)             # bounds in ids
        self.ids = np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, texts: list[str], width: np.ndarray, odd: np.ndarray) -> None:
        """Encodes new pieces (hashes ascending; width: bytes; odd: only white space). All but the odd
        ones go through one call; a line break between two pieces keeps them apart and is its own piece."""
        counts = np.zeros(len(texts), np.int64)
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        parts = []
        if len(plain):
            flat = np.array(self.encoding.encode_ordinary("\n".join([texts[i] for i in plain])), np.int64)
            ends = np.cumsum(self.size[flat])
            stop = np.cumsum(width[plain] + 1) - 1        # byte place of the break after each piece
            owner = np.searchsorted(stop, ends)            # the piece that a token ends in or the break after it
            real = ends != stop[owner - 1] + 1
            real |= owner == 0
            parts.append(flat[real].astype(np.int32))
            counts[plain] = np.bincount(owner[real], minlength=len(plain))
        for i in rest.tolist():
            parts.append(np.array(self.encoding.encode_ordinary(texts[i]), np.int32))
            counts[i] = len(parts[-1])
        order = np.concatenate([plain, rest])              # ids are stored in this order
        row = np.empty(len(texts), np.int64)
        row[order] = len(self.at) - 1 + np.arange(len(order))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts[order])])
        self.ids = np.concatenate([self.ids, *parts])
        place = np.searchsorted(self.known, hashes)
        self.known, self.row = np.insert(self.known, place, hashes), np.insert(self.row, place, row)

    def _encode(self, data: np.ndarray, byte_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = data.tobytes().decode("utf-8", "replace")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = (data & 0xC0) != 0x80
        to_cp = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=to_cp[1:])
        byte_of = np.append(np.flatnonzero(lead), len(data))
        bounds = to_cp[byte_bounds]
        starts = pieces(cp, bounds)
        ends = np.append(starts[1:], len(cp))
        h = run_hashes(_point_values()[cp], starts, ends)
        if len(self.known) > KEEP:
            self._reset()
        slot = (h >> _SLOT_SHIFT).astype(np.int64)
        rows = self.slot_row[slot]
        miss = np.flatnonzero(self.slot_key[slot] != h)
        if len(miss):
            uniq, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            place = np.searchsorted(self.known, uniq)
            new = np.flatnonzero(np.append(self.known, 0)[place] != uniq)
            if len(new):
                a, b = starts[miss[first[new]]], ends[miss[first[new]]]
                self._learn(uniq[new], [text[x:y] for x, y in zip(a.tolist(), b.tolist())], byte_of[b] - byte_of[a],
                            _classes()[cp[b - 1]] == _S)
                place = np.searchsorted(self.known, uniq)
            rows[miss] = self.row[place][inverse]
            at = (uniq >> _SLOT_SHIFT).astype(np.int64)
            self.slot_key[at], self.slot_row[at] = uniq, self.row[place]
        a, count = self.at[rows], self.at[rows + 1] - self.at[rows]
        total = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = self.ids[np.arange(total[-1]) - np.repeat(total[:-1] - a, count)]
        return ids, total[np.searchsorted(starts, bounds)]

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document of the chunk, its ids, id bounds of its documents); NULL is empty."""
        for first, data, bounds in chunks(texts, 1 << 20):
            if len(data):
                yield first, *self._encode(data, bounds)
            else:
                yield first, np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)


@functools.cache
def encoder(ranks_path: str) -> Encoder:
    """The worker's encoder: later tasks find the pieces of earlier ones."""
    return Encoder(ranks_path)
