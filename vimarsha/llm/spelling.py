"""Spelling variants: words one edit apart, found in a trie of letter-group counts, and the form that each stands for.

Words are counted per document in Arrow batches (a task hands on partial counts), then by one sum over the corpus. A
word becomes the vector of its counts of ``GROUPS`` letter groups. Level d of the trie branches by the count of group
d, so that one edit moves at most one count down (a deficit: the other word has one letter less of it) and one up (a
surplus). A depth-first search of all tries' levels therefore spends a budget of one deficit and one surplus. Every
pair is sought from one side only: the longer word spends its deficit, and of two equally long words the one whose
deficit comes first, or the smaller one where the vectors are equal. At a leaf, words are looked up by their front
half or back half, one of which an edit leaves alone, and verified letter by letter.

The trie is dealt over tasks by its first ``TOP`` levels: a word lives in the shard of its own counts and visits the
shards that the budget lets it reach. A shard of more than ``SHARD_WORDS`` words is split by a hash of the word and
visited in all its parts, so a task holds at most about so many words and visitors stream past them.

Defined cases: NULL and empty texts have no words; a NULL id counts as empty text in the hash of a misspelling;
repeated rows count as often as they occur; very long runs are words like others; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, saved, small

MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is so many times as frequent as its variant.
RATIO = 5
GROUPS, TOP = 12, 4
SHARD_WORDS = 50_000
#: Partial counts that a task holds before it hands them on.
HELD = 300_000
#: Entries of the search that are expanded at once.
BLOCK = 1 << 16
#: Letters, most frequent first, are dealt to the groups in turn; all others by code point.
LETTERS = "enatirohusclgdbmzfwyqxvpkj"

_GROUP = np.arange(256) % GROUPS
for _i, _c in enumerate(LETTERS):
    _GROUP[ord(_c)] = _i % GROUPS
_POWERS_OF = np.uint64(0x9E3779B97F4A7C15)


def _counts(damage: int, min_length: int):
    run = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def count(batches):
        held: dict[str, int] = {}
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                # bytes.lower() lowers A-Z only
                for word, n in Counter(run.findall((text.as_py() or "").encode().lower().decode())).items():
                    if damage:
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            i = h % len(word)
                            word = word[:i] + word[i + 1:]
                            if len(word) < min_length:
                                continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)
    return count


def count_words(docs: DataFrame, damage: int = 0, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the runs of letters with so many code points and occurrences. With ``damage`` a run whose CRC-32 with
    its document's id that number divides loses one letter first."""
    parts = only(docs, "doc_id", "text").mapInArrow(_counts(damage, min_length), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Words:
    """Words as arrays: letter-group counts and hashes of any front or back part."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.end = np.cumsum(self.length)
        self.start = self.end - self.length
        letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        of = np.repeat(np.arange(len(words)), self.length)
        self.counts = np.bincount(of * GROUPS + _GROUP[letters], minlength=len(words) * GROUPS).reshape(-1, GROUPS)
        place = np.arange(len(letters)) - self.start[of]
        power = np.full(int(self.length.max(initial=0)) + 1, _POWERS_OF, np.uint64)
        power[:1] = 1
        power = np.cumprod(power)
        code = letters.astype(np.uint64) + np.uint64(1)
        zero = np.zeros(1, np.uint64)
        self._front = np.concatenate([zero, np.cumsum(code * power[place])])
        self._back = np.concatenate([zero, np.cumsum(code * power[self.length[of] - 1 - place])])

    def front(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self._front[self.start[i] + n] - self._front[self.start[i]]

    def back(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self._back[self.end[i]] - self._back[self.end[i] - n]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter inserted, deleted or replaced makes a out of b; a is not the shorter one."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    if len(a) == len(b):
        return i < len(b) and a[i + 1:] == b[i + 1:]
    return len(a) == len(b) + 1 and a[i + 1:] == b[i:]


class Trie:
    """Words of one shard in a trie of their counts below the shard's own levels."""

    def __init__(self, words: list[str], n: list[int]):
        self.members, self.n = Words(words), n
        counts = self.members.counts[:, TOP:]
        self.base = int(counts.max(initial=0)) + 2
        node = np.zeros(len(words), np.int64)
        self.levels = []
        for d in range(counts.shape[1]):
            edges, node = np.unique(node * self.base + counts[:, d], return_inverse=True)
            self.levels.append(edges)
        self.leaf = node
        i, half = np.arange(len(words)), self.members.length // 2
        self._by = [self._sorted(h) for h in (self.members.front(i, half), self.members.back(i, self.members.length - half))]

    def _mixed(self, leaf, length, h):
        return h * np.uint64(0xD6E8FEB86659FD93) + leaf.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + length.astype(np.uint64)

    def _sorted(self, h):
        key = self._mixed(self.leaf, self.members.length, h)
        order = np.argsort(key, kind="stable")
        return key[order], order

    def search(self, q: Words, top: np.ndarray):
        """Pairs (place of a word of q, place of a member) at one edit. ``top``: the shard's counts."""
        differ = top - q.counts[:, :TOP]
        spent = np.zeros(len(q.words), np.int64)
        for d in range(TOP):
            spent = _step(spent, differ[:, d])
        ways = [(0, at, np.zeros(len(at), np.int64), spent[at]) for at in np.array_split(
            np.flatnonzero(spent >= 0), -(-len(q.words) // BLOCK))]
        found = []
        while ways:
            level, at, node, spent = ways.pop()
            if level == len(self.levels):
                found += self._verified(q, at, node, spent)
                continue
            edges, own = self.levels[level], q.counts[at, TOP + level]
            for move in (-1, 0, 1):
                then, count = _step(spent, np.full(len(at), move)), own + move
                key = node * self.base + count
                place = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
                ok = (then >= 0) & (count >= 0) & (count < self.base) & (edges[place] == key)
                if ok.any():
                    ways.append((level + 1, at[ok], place[ok], then[ok]))
        return found

    def _verified(self, q: Words, at, leaf, spent):
        length = q.length[at] - (spent == 1)
        half, m = length // 2, self.members
        for side, ((keys, order), h) in enumerate(zip(self._by, (q.front(at, half), q.back(at, length - half)))):
            key = self._mixed(leaf, length, h)
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            w = np.repeat(np.arange(len(at)), hi - lo)
            member = order[np.arange(len(w)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[w]]
            ok = self.leaf[member] == leaf[w]
            for i, j, s in zip(at[w[ok]].tolist(), member[ok].tolist(), spent[w[ok]].tolist()):
                a, b = q.words[i], m.words[j]
                if (s or a < b) and one_edit(a, b) and not (side and a[:len(b) // 2] == b[:len(b) // 2]):
                    yield i, j


def _step(spent, move):
    """Budget after a level: 0 nothing spent, 1 the deficit, 2 deficit and surplus, -1 out of it."""
    return np.where(move == 0, spent, np.where((move == -1) & (spent == 0), 1, np.where((move == 1) & (spent == 1), 2, -1)))


def _places(batches):
    """Each word in its own shard, and as a visitor in those that the budget reaches within the top levels."""
    moves = [()] + [((i, -1),) for i in range(TOP)] + [((i, -1), (j, 1)) for i in range(TOP) for j in range(i + 1, TOP)]
    for b in batches:
        if not b.num_rows:
            continue
        top = Words(b.column(0).to_pylist()).counts[:, :TOP].astype("<i4")
        for visitor, move in [(False, ())] + [(True, m) for m in moves]:
            to = top.copy()
            for d, by in move:
                to[:, d] += by
            ok = np.flatnonzero((to >= 0).all(1))
            shard = pa.array([r.tobytes() for r in to[ok]], pa.binary())
            yield pa.RecordBatch.from_arrays([shard, pa.array(np.full(len(ok), visitor)), b.column(0).take(pa.array(ok)),
                                              b.column(1).take(pa.array(ok))], ["shard", "visitor", "word", "n"])


def _near(batches):
    """Rows come by shard and part, members before visitors."""
    at, trie, words, n = None, None, [], []
    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(5)]
        keys = list(zip(columns[0], columns[1], columns[2]))
        first = 0
        while first < len(keys):
            last = first
            while last < len(keys) and keys[last] == keys[first]:
                last += 1
            shard, part, visitor = keys[first]
            if (shard, part) != at:
                at, trie, words, n = (shard, part), None, [], []
            if not visitor:
                words += columns[3][first:last]
                n += columns[4][first:last]
            elif words:
                trie = trie or Trie(words, n)
                q, qn = Words(columns[3][first:last]), columns[4][first:last]
                pairs = trie.search(q, np.frombuffer(shard, "<i4").astype(np.int64))
                rows = [x for i, j in pairs for x in ((q.words[i], words[j], n[j]), (words[j], q.words[i], qn[i]))]
                if rows:
                    a, c, k = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(c, pa.string()), pa.array(k, pa.int64())],
                                                     ["word", "near", "near_n"])
            first = last


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all ordered pairs of distinct words (word, n), saved before, at one edit."""
    placed = words.mapInArrow(_places, "shard binary, visitor boolean, word string, n long")
    large = saved(placed.filter("not visitor").groupBy("shard").count().filter(F.col("count") > SHARD_WORDS)
                  .select("shard", F.ceil(F.col("count") / SHARD_WORDS).cast("int").alias("parts")), "spelling-shards")
    parts = F.coalesce("parts", F.lit(1))
    dealt = placed.join(small(large), "shard", "left").select(
        "shard", F.explode(F.when(F.col("visitor"), F.sequence(F.lit(0), parts - 1))
                           .otherwise(F.array(F.pmod(F.xxhash64("word"), parts).cast("int")))).alias("part"), "visitor", "word", "n")
    return dealt.repartition("shard", "part").sortWithinPartitions("shard", "part", "visitor").mapInArrow(
        _near, "word string, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) lead in the end. A form is ``RATIO`` times as frequent, so chains are
    short and without circles; every round doubles the steps taken."""
    now = saved(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        then = saved(now.join(small(on), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"),
                                                                F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if then.filter("moved").isEmpty():
            return now
        now = then.drop("moved")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words (word, n): the number of words at one edit, of these the most
    frequent (ties: least by code points) where it has ``ratio`` times the word's count, and the last of the forms' chain."""
    words = saved(words, "spelling-words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                   F.col("best.near").alias("near"), (-F.col("best")["col1"]).alias("near_n"))
    strong = F.col("near_n") >= ratio * F.col("n")
    told = saved(told.select("word", "n", "n_near", F.when(strong, F.col("near")).alias("form"),
                             F.when(strong, F.col("near_n")).alias("form_n")), "spelling-forms")
    chain = roots(told.filter("form is not null"))
    return told.join(small(chain), "word", "left").withColumn("root", F.coalesce("root", "word"))
