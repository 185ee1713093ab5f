"""Line dedup across documents: exact copies by hash, near copies by a segment-partition edit join.

Two lines are near copies when their edit distance is at most ``threshold``. A line is cut into
threshold + 1 segments; whoever is within the threshold keeps at least one segment intact, at a place
that differs by a bounded shift, so an index of segments by (number, line length, text) probed with the
substrings at the admissible places finds every pair. Each pair is then verified by a banded
bit-parallel edit distance: one word of 2 * threshold + 1 bits slides along the diagonal.

Only DataFrame functions are used. Shuffled rows are hashes; line texts are fetched for candidates only.
Exact copies collapse before the join, so a line that a third of all documents share is one line in it.

A line is removed when it is an exact copy of an earlier line (in the order of document id, line number)
or when an earlier line lies within the threshold. "Earlier" compares first occurrences, and a removed
line still counts as an earlier one: the result depends on neither partitioning nor order of work.

Defined cases: lines are compared without white space at their ends; blank lines always stay and a NULL
text stays NULL with no lines; lines shorter than ``min_chars`` are compared for exact copies only;
rows that repeat a document id count as one document and lose the same line numbers; rows without an id
are compared with nothing and stay whole; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, BROADCAST_ROWS, forget, rows_where, saved, small

THRESHOLD = 2
MIN_CHARS = 32
#: Sixteen letters: their counts fill two longs.
_LETTERS = "etaoinsrhldcumgp"


def segment(number: Column, length: Column, threshold: int) -> tuple[Column, Column]:
    """(start from 1, length) of one of the threshold + 1 even segments of a line; longer ones come last."""
    n = threshold + 1
    base = F.call_function("div", length, F.lit(n)).cast("int")
    short = n - F.pmod(length, F.lit(n))                 # so many segments have the lesser length
    return 1 + number * base + F.greatest(number - short, F.lit(0)), base + F.when(number >= short, 1).otherwise(0)


def shifts(threshold: int) -> list[tuple[int, int, int]]:
    """(segment, line lengths' difference, shift): where a segment of a line of length l can stand in a
    line of length l + difference, by the multi-match-aware rule."""
    return [(i, d, s) for d in range(threshold + 1) for i in range(threshold + 1)
            for s in range(max(-i, d - (threshold - i)), min(i, d + (threshold - i)) + 1)]


def segment_keys(lines: DataFrame, places: list[tuple[int, int, int]], threshold: int) -> DataFrame:
    """(key, h): the hash of a line's substring for each place (segment, lengths' difference, shift). A substring
    that runs over the line's ends finds nothing that verification lets pass.

    The literal places are exploded first, so that one short compiled expression hashes them all."""
    at = lines.select("h", "line", "n_chars", F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(d).alias("d"), F.lit(x).alias("x")) for i, d, x in places])).alias("p"))
    of = F.col("n_chars") - F.col("p.d")
    start, size = segment(F.col("p.i"), of, threshold)
    return at.select(F.xxhash64(F.col("p.i"), of, F.substring("line", start + F.col("p.x"), size)).alias("key"), "h")


def letter_counts(line: Column) -> Column:
    """How often each of ``_LETTERS`` stands in a line, up to 127, packed into two longs."""
    n = F.char_length(line)
    counts = [F.least(n - F.char_length(F.replace(line, F.lit(c))), F.lit(127)).cast("long") for c in _LETTERS]
    return F.array(*[sum((F.shiftleft(c, 7 * i) for i, c in enumerate(half[1:], 1)), half[0]) for half in (counts[:8], counts[8:])])


def unlike(a: Column, b: Column) -> Column:
    """A lower bound of twice the edit distance, from packed letter counts."""
    def count(x, i):
        return F.shiftright(x[i // 8], 7 * (i % 8)).bitwiseAND(F.lit(127))
    return sum((F.abs(count(a, i) - count(b, i)) for i in range(len(_LETTERS))), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """How many first characters two strings share, counted up to 65 535, by halving steps."""
    most = F.least(F.char_length(a), F.char_length(b))
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(15, -1, -1)]), F.lit(0), lambda n, step: F.when(
        (n + step <= most) & (F.substr(a, n + 1, step) == F.substr(b, n + 1, step)), n + step).otherwise(n))


def near_enough(pairs: DataFrame, p: str, q: str, threshold: int) -> DataFrame:
    """Rows whose strings are within the threshold. What both begin and end with goes first: it does not change the
    distance, and of the variants of one line little is left."""
    rows = pairs.withColumn("_n", common_prefix(F.col(p), F.col(q)))
    rows = rows.withColumns({"_p": F.reverse(F.substr(p, F.col("_n") + 1)), "_q": F.reverse(F.substr(q, F.col("_n") + 1))})
    rows = rows.withColumn("_n", common_prefix(F.col("_p"), F.col("_q")))
    # the bit vectors need more than threshold characters: both get the same ones in front
    pad = F.lit("x" * (threshold + 1))
    rows = rows.withColumns({"_p": F.concat(pad, F.substr("_p", F.col("_n") + 1)), "_q": F.concat(pad, F.substr("_q", F.col("_n") + 1))})
    rows = rows.withColumn("_far", banded_distance(F.col("_p"), F.col("_q"), threshold))
    return rows_where(rows, F.col("_far") <= threshold).drop("_n", "_p", "_q", "_far")


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most ``threshold``, exact up to it and
    above it otherwise: Hyyrö's banded form of Myers' bit vectors. ``a`` is the pattern.

    Bit j of the word is the cell of pattern place i - threshold + j at text place i. The score is
    followed down the band's lower edge while that lies inside the pattern, then along its last row.
    """
    k = threshold
    width = 2 * k + 1
    full, edge = (1 << width) - 1, 1 << (width - 1)
    m, n = F.char_length(a), F.char_length(b)
    # each text character beside the band's pattern characters: zipped once, before the fold
    none = F.array(*[F.lit("")] * k)
    padded = F.concat(none, F.split(a, ""), F.array_repeat(F.lit(""), 2 * k + 1))
    items = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("i"), F.split(b, "").alias("c"),
                         *[F.slice(padded, j + 1, n).alias(f"p{j}") for j in range(width)])

    def seen(item: Column) -> Column:
        x = F.lit(0)
        for j in range(width):
            x = x + F.when(item[f"p{j}"] == item["c"], 1 << j).otherwise(0)
        return F.struct(item["i"].alias("i"), x.alias("x"))

    def advance(s: Column) -> Column:
        vp, vn, x = s["vp"], s["vn"], s["x"]
        d0 = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["score"].alias("score"), s["row"].alias("row"), d0.alias("d0"))

    def settle(s: Column) -> Column:
        vp, vn, d0, score, row = s["vp"], s["vn"], s["d0"], s["score"], s["row"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(full)))
        hn = d0.bitwiseAND(vp)
        half = F.shiftright(d0, 1)
        at = F.call_function("shiftleft", F.lit(1), row)
        below = F.when(row >= width - 1, F.when(d0.bitwiseAND(F.lit(edge)) == 0, 1).otherwise(0)).otherwise(
            F.when(hp.bitwiseAND(at) != 0, 1).when(hn.bitwiseAND(at) != 0, -1).otherwise(0))
        return F.struct(hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(F.lit(full))).alias("vp"),
                        half.bitwiseAND(hp).alias("vn"), (score + below).alias("score"), row.alias("row"))

    def fold(state: Column, item: Column) -> Column:
        # a one-element transform binds a stage to a name, so that it is computed once
        first = F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), state["score"].alias("score"),
                         (state["row"] - 1).alias("row"), item["x"].alias("x"))
        return F.element_at(F.transform(F.transform(F.array(first), advance), settle), 1)

    # row: the bit of the last pattern place in this column, above the band while that place lies below it
    start = F.struct(F.lit(full ^ ((1 << k) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("score"), (m + k).alias("row"))
    return F.when(F.abs(m - n) > k, k + 1).otherwise(
        F.aggregate(F.transform(items, seen), start, fold, lambda s: s["score"]))


def near_pairs(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of line hashes, a < b, within the threshold. ``lines``: h, line, n_chars, each line once.

    Keys that one line alone has, nearly all, go first. The letter counts of the lines that are left travel with their keys
    and are compared inside the join: of the variants of one line, which share its other segments, only those come out
    whose letters are nearly the same."""
    # whole segments stand for their line, which is found by them and by the shifted substrings of others
    whole = [(i, 0, 0) for i in range(threshold + 1)]
    keys = saved(segment_keys(lines, whole, threshold).withColumn("own", F.lit(True)).unionByName(
        segment_keys(lines, [x for x in shifts(threshold) if x not in whole], threshold).withColumn("own", F.lit(False))), "line-keys")
    common = saved(keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("own")).filter(
        "own and lo <> hi").select("key"), "line-common")
    every, keys = keys, saved(keys.join(small(common), "key"), "line-shared")
    forget(every, common)
    wanted = saved(keys.select("h").distinct(), "line-wanted")
    texts = saved(lines.join(small(wanted), "h").select("h", "line", letter_counts(F.col("line")).alias("letters")), "line-texts")
    probes = keys.join(texts.select("h", "letters"), "h")
    left = probes.filter("own").select("key", F.col("h").alias("x"), F.col("letters").alias("lx"))
    right = probes.select("key", F.col("h").alias("y"), F.col("letters").alias("ly"))
    alike = (F.col("x") != F.col("y")) & (unlike(F.col("lx"), F.col("ly")) <= 2 * threshold)
    pairs = saved(left.join(right, "key").filter(alike).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "line-pairs")
    forget(keys, wanted)
    both = (pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("p")), "a")
            .join(texts.select(F.col("h").alias("b"), F.col("line").alias("q")), "b"))
    return near_enough(both, "p", "q", threshold).select("a", "b")


def once(lines: DataFrame, first: DataFrame) -> DataFrame:
    """Each distinct line once, at its first place, as (h, line, n_chars): lines that recur are told apart by the
    small table of their first places."""
    twice = saved(first.groupBy("h").agg(F.sum("n").alias("n"), F.min("first").alias("first")).filter("n > 1").select("h", "first"), "line-twice")
    return lines.join(small(twice), "h", "left").filter(
        F.col("first").isNull() | (F.col("first") == F.struct("id", "no"))).select("h", "line", "n_chars")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = THRESHOLD,
                  min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line that goes: document id, ``line_no`` from 0, ``near`` (false: exact copy)."""
    split = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    split = split.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter("line <> ''")
    keys = split.select("id", "no", F.xxhash64("line").alias("h"), F.crc32(F.col("line").cast("binary")).alias("c"),
                        F.char_length("line").alias("n_chars"))
    first = saved(keys.groupBy("h", "c", "n_chars").agg(
        F.min(F.struct("id", "no")).alias("first"), F.count("*").alias("n")), "line-first")
    long_lines = split.select("id", "no", F.xxhash64("line").alias("h"), "line", F.char_length("line").alias("n_chars")).filter(
        F.col("n_chars") >= max(min_chars, threshold + 1))
    lines = saved(once(long_lines, first), "lines")
    pairs = near_pairs(lines, threshold)
    order = first.groupBy("h").agg(F.min("first").alias("first"))
    later = saved(pairs.join(order.select(F.col("h").alias("a"), F.col("first").alias("fa")), "a")
                  .join(order.select(F.col("h").alias("b"), F.col("first").alias("fb")), "b")
                  .select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("h")).distinct(),
                  "line-later")
    forget(lines)
    near = later.withColumn("near", F.lit(True))
    marked = first.join(near, "h", "left").select("h", "c", "n_chars", "first", F.coalesce("near", F.lit(False)).alias("near"))
    hits = keys.join(marked, ["h", "c", "n_chars"])
    return hits.filter(F.col("near") | (F.col("first") != F.struct("id", "no"))).select(
        F.col("id").alias(id_col), F.col("no").alias("line_no"), "near").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = THRESHOLD,
                min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with copied lines taken out of ``text``, and ``n_lines`` (lines with a word),
    ``n_removed`` and ``n_removed_near`` added. Documents left without a line keep an empty text."""
    clash = {"n_lines", "n_removed", "n_removed_near", "_gone"}
    docs = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in clash])
    removed = saved(removed_lines(docs, id_col, text, threshold, min_chars), "line-removed")
    gone = removed.groupBy(id_col).agg(F.collect_list("line_no").alias("_gone"), F.count_if("near").alias("n_removed_near"))
    # the line numbers are broadcast if they are few; texts meet them in a shuffle only beyond that
    df = docs.join(F.broadcast(gone) if removed.count() <= BROADCAST_ROWS else gone, id_col, "left")
    # a line with a word is one match, from its first word to its end
    df = (df.withColumn("n_lines", F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09\n\x0B\f\r][^\n]*+")), F.lit(0)).cast("long"))
          .withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
          .withColumn("n_removed_near", F.coalesce("n_removed_near", F.lit(0).cast("long"))))
    # the lines are bound to a name, so that a text is split once and not for each line that stays
    left = F.when(F.col("n_removed") == 0, F.col(text)).otherwise(F.element_at(F.transform(
        F.array(F.split(text, "\n")), lambda lines: F.array_join(F.transform(F.array_except(
            F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: F.get(lines, i)), "\n")), 1))
    return df.withColumn(text, left).select(*docs.columns, "n_lines", "n_removed", "n_removed_near")
