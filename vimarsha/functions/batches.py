"""Text columns whose words are gone through one by one, computed on Arrow batches inside the tasks.

Lambdas over a text's words are interpreted, several expressions a word; here a word costs one look into a dictionary. Each
function takes and gives a ``Column`` and is row-local like the expressions of ``text``; NULL gives NULL where it does not say
otherwise. Python's white space and word characters are those that ``text`` spells out as patterns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as FV

_NON_WORD = re.compile(r"\W+")
#: ASCII marks, none of them a word character.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
_TOKENS = re.compile(r"\s+|\S+")
_KANNADA = re.compile("[\u0c80-\u0cff]+")
_SENTENCE_END = re.compile("[" + "".join(map(re.escape, FV.SENTENCE_END_CHARS)) + r"]\s*")
#: Texts are taken in slices of so many bytes, a longer text by itself.
SLICE_BYTES = 1 << 20
#: Spark's setting for the rows of an Arrow batch, its default, and what whole texts travel in instead.
BATCH_ROWS, BATCH_DEFAULT, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "300"


def small_batches(spark: SparkSession | None) -> None:
    """Whole texts go to Python few at a time, unless the session says how many: every batch under way is held several times
    over, on both sides, by each of a plan's evaluations."""
    if spark is not None and spark.conf.get(BATCH_ROWS, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_ROWS, TEXT_ROWS)


def _strings(column: pa.Array) -> Iterator[str | None]:
    """The texts, one after another; bytes that are no UTF-8 become replacement characters."""
    for b in column.cast(pa.binary()):
        yield b.as_py().decode("utf-8", "replace") if b.is_valid else None


def _column(run: Callable, kind: str, *columns: Column) -> Column:
    """``run`` of whole columns. It counts as not deterministic: Spark then keeps the projections around it apart instead of
    writing what they compute into each of its uses, where it would be computed again."""
    small_batches(SparkSession.getActiveSession())
    return F.arrow_udf(run, kind).asNondeterministic()(*columns)


class _Known(dict):
    """What ``f`` makes of a word, kept while a batch lasts for the times it comes again."""

    def __init__(self, f: Callable[[str], str]):
        super().__init__()
        self.f = f

    def __missing__(self, word: str) -> str:
        got = self[word] = self.f(word)
        return got


def each(values: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    return pa.array([None if v is None else f(v) for v in _strings(values)], kind)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        rows = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")) - at)
        yield texts.slice(at, rows)
        at += rows


@cache
def _kinds() -> np.ndarray:
    """Kind of each character: 0 white space, 1 Kannada, 2 an ASCII letter, 3 another decimal digit, 4 any other."""
    kinds = np.full(0x110000, 4, np.uint8)
    low = "".join(map(chr, range(0x20000)))         # no space or digit is above
    for pattern, kind in ((r"\s+", 0), (r"\d+", 3), ("[A-Za-z]+", 2), ("[\u0c80-\u0cff]+", 1)):
        for m in re.finditer(pattern, low):
            kinds[m.start():m.end()] = kind
    return kinds


def script_counts(c: Column) -> Column:
    """struct<total,kannada,english,numeric,other: int> over non-whitespace characters; of NULL, all are NULL."""
    names = ["total", "kannada", "english", "numeric", "other"]

    def run(texts: pa.Array) -> pa.Array:
        counts = [np.zeros((0, 5), np.int64)]
        for part in _slices(texts):
            rows = [s or "" for s in _strings(part)]
            kinds = _kinds()[np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)]
            row = np.repeat(np.arange(len(rows)) * 5, np.fromiter(map(len, rows), np.int64, len(rows)))
            counts.append(np.bincount(row + kinds, minlength=5 * len(rows)).reshape(-1, 5))
        made = np.concatenate(counts)
        made[:, 0] = made[:, 1:].sum(1)
        absent = texts.is_null().to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(made[:, i].astype(np.int32), mask=absent) for i in range(5)], names)
    return _column(run, "struct<total:int,kannada:int,english:int,numeric:int,other:int>", c)


def _word_sums(texts: pa.Array, table: dict[str, tuple[int, ...]], width: int) -> np.ndarray:
    """Texts x width: what the table says of each lower-cased word, summed; asked once for each distinct run of no white space."""
    keys, worth = pa.array(list(table), pa.string()), np.array(list(table.values()), np.int64).reshape(-1, width)
    sums = [np.zeros((0, width), np.int64)]
    for part in _slices(texts):
        try:
            part.validate(full=True)
        except pa.ArrowInvalid:                     # bytes that are no UTF-8
            part = pa.array(list(_strings(part)), pa.string())
        runs = pc.utf8_split_whitespace(part)
        coded = runs.flatten().dictionary_encode()
        # nearly all are one ASCII word between marks; others are cut one by one
        core = pc.ascii_lower(pc.ascii_trim(coded.dictionary, _MARKS))
        plain = pc.and_(pc.string_is_ascii(core), pc.or_(pc.ascii_is_alnum(core), pc.equal(core, ""))).to_numpy(zero_copy_only=False)
        at = pc.fill_null(pc.index_in(core, value_set=keys), -1).to_numpy(zero_copy_only=False)
        values = np.zeros((len(core), width), np.int64)
        values[plain & (at >= 0)] = worth[at[plain & (at >= 0)]]
        for k, run in zip(np.flatnonzero(~plain), coded.dictionary.filter(pa.array(~plain)).to_pylist()):
            for t in _NON_WORD.split(run.lower()):
                if t in table:
                    values[k] += table[t]
        upto = np.zeros((len(coded) + 1, width), np.int64)
        np.cumsum(values[coded.indices.to_numpy(zero_copy_only=False)], 0, out=upto[1:])
        ends = np.cumsum(pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
        sums.append(np.diff(upto[np.concatenate([[0], ends])], axis=0))
    return np.concatenate(sums)


def word_weights(c: Column, weights: dict[str, int]) -> Column:
    """The weights of a text's lower-cased words, summed."""
    table = {w: (n,) for w, n in weights.items()}

    def run(texts: pa.Array) -> pa.Array:
        absent = texts.is_null().to_numpy(zero_copy_only=False)
        return pa.array(_word_sums(texts, table, 1)[:, 0].astype(np.int32), mask=absent)
    return _column(run, "int", c)


def word_counts(c: Column, groups: list[list[str]]) -> Column:
    """How many of a text's lower-cased words are in each group, as array<double>; of NULL, each is NULL."""
    sets = [frozenset(g) for g in groups]
    table = {w: tuple(int(w in g) for g in sets) for w in frozenset().union(*sets)}

    def run(texts: pa.Array) -> pa.Array:
        made = _word_sums(texts, table, len(sets)).astype(np.float64)
        absent = np.repeat(texts.is_null().to_numpy(zero_copy_only=False), len(sets))
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(sets), pa.array(made.ravel(), mask=absent))
    return _column(run, "array<double>", c)


def _is_free(t: str) -> bool:
    """Whether a spelling may change the token: one with a letter and no native character."""
    return not t.isspace() and not _KANNADA.search(t) and any(map(str.isalpha, t))


def _spelling(t: str, lookup: dict[str, str]) -> str | None:
    """A token's dictionary spelling, by its lower-cased key or by that without trailing marks, which are put back."""
    low = t.lower()
    hit = lookup.get(low)
    if hit is None and low and low[-1] in FV.TRAILING_PUNCT:
        stem = low.rstrip(FV.TRAILING_PUNCT)
        hit = lookup.get(stem)
        hit = None if hit is None else hit + low[len(stem):]
    return None if hit is None or not _is_free(t) else hit


def _transliterator(lookup: dict[str, str]) -> Callable[[str], str]:
    """Each word's dictionary spelling; other words and white space stay."""
    known = _Known(lambda run: "".join([t if (hit := _spelling(t, lookup)) is None else hit for t in _TOKENS.findall(run)]))
    return lambda s: " ".join(map(known.__getitem__, s.split(" ")))     # by what stands between blanks


def transliterated(c: Column, lookup: dict[str, str]) -> Column:
    """Each word's dictionary spelling; other words and white space stay."""
    def run(texts: pa.Array) -> pa.Array:
        return each(texts, _transliterator(lookup), pa.string())
    return _column(run, "string", c)


def _items(lists: pa.Array, f: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """Lists of ``f`` of the lists' items, which gets the distinct ones."""
    coded = lists.flatten().dictionary_encode()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), f(coded.dictionary).take(coded.indices),
                                    mask=lists.is_null() if lists.null_count else None)


#: How a word was spelled, as bits; the last for words that stay.
_MODEL, _FALLBACK, _SCHEME, _STAYS = 1, 2, 4, 8


def _method(bits: int) -> str:
    if bits & _MODEL:
        return "mixed" if bits & ~_MODEL else "model"
    if bits & _SCHEME:
        return "mixed" if bits & _FALLBACK else "scheme"
    return "fallback" if bits & _FALLBACK else "unchanged"


def _speller(lookup: dict[str, str], model: dict[str, str], scheme: Callable[[str], str | None] | None) -> Callable[[str], tuple[str, int]]:
    """A token to (spelling, bit): a model's spelling (exact word), then the dictionary's, then the scheme's."""
    def spelled(t: str) -> tuple[str, int]:
        if t.isspace():
            return t, 0
        if not _is_free(t):
            return t, _STAYS
        if (hit := model.get(t)) is not None:
            return hit, _MODEL
        if (hit := _spelling(t, lookup)) is not None:
            return hit, _FALLBACK
        hit = scheme(t) if scheme else None
        return (t, _STAYS) if hit is None else (hit, _SCHEME)
    return spelled


def rewritten(c: Column, tables, scheme: Callable[[str], str | None] | None = None) -> Column:
    """struct(text, method): every word in its spelling, white space kept; a blank text stays. ``tables`` is a dictionary, or a
    broadcast (dictionary, a model's words)."""
    def run(texts: pa.Array) -> pa.Array:
        lookup, model = (tables, {}) if isinstance(tables, dict) else tables.value
        spelled = _speller(lookup, model, scheme)

        def between(run: str) -> tuple[str, int]:   # what stands between blanks
            got = [spelled(t) for t in _TOKENS.findall(run)]
            bits = 0
            for _, b in got:
                bits |= b
            return "".join([t for t, _ in got]), bits

        known, text, method = _Known(between), [], []
        for s in _strings(texts):
            got = [("", 0)] if s is None else [known[r] for r in s.split(" ")]
            bits = 0
            for b in {b for _, b in got}:
                bits |= b
            text.append(None if s is None else " ".join([t for t, _ in got]))
            method.append(_method(bits))
        return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(method, pa.string())], ["text", "method"])
    return _column(run, "struct<text:string,method:string>", c)


def word_mappings(c: Column, tables, scheme: Callable[[str], str | None] | None = None) -> Column:
    """A text's words beside their spellings, as ``rewritten`` finds them; none of a blank text."""
    def run(texts: pa.Array) -> pa.Array:
        lookup, model = (tables, {}) if isinstance(tables, dict) else tables.value
        known = _Known(_speller(lookup, model, scheme))
        words = [[] if s is None else s.split() for s in _strings(texts)]
        flat = [w for row in words for w in row]
        pairs = pa.StructArray.from_arrays([pa.array(flat, pa.string()), pa.array([known[w][0] for w in flat], pa.string())], ["src", "dst"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, words)]).astype(np.int32)), pairs)
    return _column(run, "array<struct<src:string,dst:string>>", c)


def _translation(w: str, lookup: dict[str, str]) -> str:
    clean = w.strip(FV.TRAILING_PUNCT)
    hit = lookup.get(clean)
    return w if hit is None else hit + w[len(clean):]


def _translator(lookup: dict[str, str], max_len: int) -> Callable[[str], str]:
    known = _Known(lambda w: _translation(w, lookup))

    def words(text: str) -> str:
        s = text.strip()
        if not s:
            return text
        if len(s) > max_len:
            for mark in FV.SENTENCE_END_CHARS:
                s = s.replace(mark, " ")
        return " ".join(map(known.__getitem__, s.split()))
    return words


def translated(c: Column, lookup: dict[str, str], max_len: int) -> Column:
    """The words of the stripped text, without sentence delimiters where it is longer than ``max_len``, each by the dictionary
    without marks at its ends; a blank text as it is."""
    def run(texts: pa.Array) -> pa.Array:
        return each(texts, _translator(lookup, max_len), pa.string())
    return _column(run, "string", c)


def routed(roman: Column, native: Column, roman_lookup: dict[str, str], native_lookup: dict[str, str], max_len: int) -> Column:
    """struct(translit, translated): ``transliterated`` of a romanized text, ``translated`` of that or of a native text, in one evaluation."""
    def run(romans: pa.Array, natives: pa.Array) -> pa.Array:
        spelled = each(romans, _transliterator(roman_lookup), pa.string())
        made = each(pc.coalesce(natives, spelled), _translator(native_lookup, max_len), pa.string())
        return pa.StructArray.from_arrays([spelled, made], ["translit", "translated"])
    return _column(run, "struct<translit:string,translated:string>", roman, native)


def translated_items(items: Column, lookup: dict[str, str]) -> Column:
    """Beside each of several stripped texts its words by the dictionary; NULL beside NULL."""
    def run(lists: pa.Array) -> pa.Array:
        known = _Known(lambda w: _translation(w, lookup))
        return _items(lists, lambda texts: each(texts, lambda s: " ".join(map(known.__getitem__, s.split())), pa.string()))
    return _column(run, "array<string>", items)


def _packed(parts: list[str], max_len: int, long: Callable[[str], list[str]] | None) -> list[str]:
    """Parts joined by a blank while they fit; one that is too long for itself as ``long`` cuts it, or whole."""
    out, cur = [], ""
    for p in parts:
        if long and len(p) > max_len:
            out += ([cur] if cur else []) + long(p)
            cur = ""
        elif len(cur) + len(p) + 1 > max_len:
            out += [cur] if cur else []
            cur = p
        else:
            cur = f"{cur} {p}" if cur else p
    return out + [cur] if cur else out


def segments(c: Column, max_len: int) -> Column:
    """Sentences of a stripped text packed into segments of at most ``max_len`` characters, words never split; a text within the
    limit is one segment."""
    def cut(s: str) -> list[str]:
        if len(s) <= max_len:
            return [s]
        return _packed([p for x in _SENTENCE_END.split(s) if (p := x.strip())], max_len, lambda p: _packed(p.split(), max_len, None))

    def run(texts: pa.Array) -> pa.Array:
        return each(texts, cut, pa.list_(pa.string()))
    return _column(run, "array<string>", c)


def similarity(got: Column, expected: Column) -> Column:
    """Five times the share of ``expected``'s distinct lower-cased words that ``got`` has, from 1 to 5; 0.0 if ``expected`` has
    no words, 1.0 where a text is NULL."""
    def score(a: str | None, b: str | None) -> float:
        words = set() if b is None else set(b.lower().split())
        if not words or a is None:
            return 0.0 if b is not None and not words else 1.0
        return min(max(len(words.intersection(a.lower().split())) / len(words) * 5.0, 1.0), 5.0)

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(list(map(score, _strings(a), _strings(b))), pa.float64())
    return _column(run, "double", got, expected)


def by_length(c: Column, entries: list[str], every: int = 1) -> Column:
    """Each word of a text, or the first of ``every`` so many, replaced by the entry that its length picks; a blank text is one
    word of no letters."""
    def words(s: str) -> str:
        found = s.split() or [""]
        found[::every] = [entries[len(w) % len(entries)] for w in found[::every]]
        return " ".join(found)

    def run(texts: pa.Array) -> pa.Array:
        return each(texts, words, pa.string())
    return _column(run, "string", c)
