"""N-gram Jaccard self-join by a token-group matrix; near-duplicate classes of documents.

A document is the set of its distinct 5-word shingles (64-bit hashes). Two documents link when
``100 * |A & B| >= percent * |A | B|``. Equal sets are one set from the start.

1. One pass gives each set's size and fingerprint and adds its tokens to a table of counters of fixed size
   that covers the whole corpus. The table orders all tokens, rare ones first. Any order is right; this one
   keeps a passage that many documents share out of the short prefixes.
2. A set's prefix is so long that the prefixes of two linked sets share ``reach(n)`` tokens (a twentieth of the
   smaller set). Tokens that a single set has are dropped; a few sets of a token and size class lead, and the
   others that share enough tokens with them are verified: a fixed number of candidates for each row, whatever
   the size of the class. Sets linked so are a part; the parts around common leaders make a group.
   Inside a group, the sets whose prefix tokens the group shares most are its centres, a few for each group; sets of
   other parts are verified with them, since copies that were edited at different places resemble the text that they
   were made of more than one another. That is repeated while it finds links.
3. The matrix stores each group's union of prefix tokens with the sizes of its sets. A set probes the
   groups that it is not in; the bound of its overlap with a group's union, by shared prefix tokens, sizes
   and places in the order, decides which groups open.
4. In groups that open, and in its own, a set meets the other parts that share enough of its prefix tokens; the overlap
   with a part's union bounds those of several sets. What is left is verified exactly, and components of all links are the classes.

A pair inside a part needs no link of its own, so copies are never expanded into pairs; between parts
every pair that the bounds leave is verified, so no component is split and no cap is needed.

Defined cases: a text of one to four words is one shingle; a NULL text or one without words has an empty
set that links with nothing; repeated rows each get a result row; rows without an id take no part and
get a NULL component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import forget, saved, small
from .components import components

PERCENT = 80
WORDS = 5
#: The counters' table has 2 ** COUNTER_BITS places, 2 MB as ranks, at every size of the input.
COUNTER_BITS = 21
_BLOCK = 1 << 14
#: Leaders of a token and size class.
LEADERS = 6
#: Centres of a group, and rounds of choosing them.
CENTRES = 6
ROUNDS = 1
#: So many partial tables are added up by one task at a time.
FAN_IN = 64


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each token, token, set sizes, fingerprints) of chunks of a batch."""
    for w in tv.words(texts):
        doc, h = tv.distinct(*tv.shingles(w, k))
        rows = len(w.bounds) - 1
        n = np.bincount(doc, minlength=rows)
        fp = tv.mix(tv.sums(tv.mix(h), doc, rows) + n.astype(np.uint64))
        yield w.first, rows, doc, h, n, fp.view(np.int64)


def _profile(k: int, bits: int):
    def run(batches):
        from pyspark import TaskContext
        counts, part = np.zeros(1 << bits, np.uint32), TaskContext.get().partitionId()
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("part", pa.int32()),
                            ("block", pa.int32()), ("counts", pa.binary())])
        for b in batches:
            ids = b.column(0)
            for first, rows, _, h, n, fp in _sets(b.column(1), k):
                counts += np.bincount(h & np.uint64((1 << bits) - 1), minlength=1 << bits).astype(np.uint32)
                none = pa.nulls(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(first, rows), pa.array(n), pa.array(fp), none, none,
                                                  pa.nulls(rows, pa.binary())], schema=schema)
        blocks = [i for i in range(len(counts) // _BLOCK) if counts[i * _BLOCK:(i + 1) * _BLOCK].any()]
        none = pa.nulls(len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()),
                                          pa.array([zlib.compress(counts[i * _BLOCK:(i + 1) * _BLOCK].tobytes(), 1) for i in blocks], pa.binary())],
                                         schema=schema)
    return run


def _add_up(pdf):
    total = np.zeros(_BLOCK, np.uint64)
    for x in pdf["counts"]:
        a = np.frombuffer(zlib.decompress(x), np.uint8)
        total += a.view(np.uint32 if len(a) == 4 * _BLOCK else np.uint64)
    return pdf.iloc[:1].assign(counts=[zlib.compress(total.tobytes(), 1)])


def token_ranks(partial: DataFrame, bits: int) -> np.ndarray:
    """Rank 0 to 255 of each counter's place, by the logarithm of its count over the whole corpus."""
    parts = partial.agg(F.max("part")).first()[0]
    width = (parts or 0) + 1
    tables = partial.select("part", "block", "counts")
    while True:
        width = -(-width // FAN_IN)
        tables = tables.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInPandas(
            _add_up, "part int, block int, counts binary")
        if width == 1:
            break
    ranks = np.zeros(1 << bits, np.uint8)
    for x in tables.collect():              # one row for each block: 2 ** bits counters in all
        c = np.frombuffer(zlib.decompress(x["counts"]), np.uint64)
        ranks[x["block"] * _BLOCK:(x["block"] + 1) * _BLOCK] = np.minimum(255, 12 * np.log2(c + 1.0)).astype(np.uint8)
    return ranks


def reach(n):
    """How many tokens of their prefixes two linked sets of n tokens share at least; grows with n."""
    return n // 20 + 1


def _reach(n: Column) -> Column:
    return F.floor(n / 20) + 1


def _ordered(h: np.ndarray, ranks: np.ndarray, bits: int) -> np.ndarray:
    """Tokens as values whose order is that of (rank, hash)."""
    return (ranks[h & np.uint64((1 << bits) - 1)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))


def _prefixes(k: int, bits: int, percent: int, shared, owned: bool = False):
    """(token, fp, n, pos) of the prefixes of texts; ``owned`` adds the texts' second column, of a set's first text."""
    def run(batches):
        ranks = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            for first, rows, doc, h, n, fp in _sets(b.column(0), k):
                bounds = np.zeros(rows + 1, np.int64)
                np.cumsum(n, out=bounds[1:])
                key = _ordered(h, ranks, bits)
                once = np.sort(np.unique(fp, return_index=True)[1])
                once = once[n[once] > 0]
                size = n[once]
                length = np.minimum(size, size - -(-percent * size // 100) + reach(size))
                for i in once.tolist():
                    key[bounds[i]:bounds[i + 1]].sort()
                total = int(length.sum())
                pos = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
                take = np.repeat(bounds[once], length) + pos
                columns = [pa.array(key[take].view(np.int64)), pa.array(np.repeat(fp[once], length)),
                           pa.array(np.repeat(size, length).astype(np.int32)), pa.array(pos.astype(np.int32))]
                if owned:       # a text without an owner is its set's own
                    owner = pc.if_else(b.column(1).slice(first, rows).is_valid(), b.column(1).slice(first, rows), pa.array(fp))
                    columns.append(owner.take(pa.array(np.repeat(once, length))))
                yield pa.RecordBatch.from_arrays(columns, ["token", "fp", "n", "pos", "owner"][:len(columns)])
    return run


def _own_pairs(k: int, percent: int):
    """(id, a, b, linked) of rows (id, text, other) whose texts both have words: their sets, and whether those are similar."""
    def run(batches):
        for b in batches:
            ends = np.cumsum(sum(pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2)))
            at = 0
            while at < b.num_rows:
                rows = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + tv.CHUNK_BYTES, "right")) - at)
                part = b.slice(at, rows)
                at += rows
                made = [(doc + first, h, n, fp) for first, _, doc, h, n, fp in _sets(pa.concat_arrays([part.column(1), part.column(2)]), k)]
                doc, h, n, fp = (np.concatenate(x) for x in zip(*made))
                row, n, fp = doc % rows, n.reshape(2, rows), fp.reshape(2, rows)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                common = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=rows)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(fp.min(0)), pa.array(fp.max(0)), pa.array(100 * common >= percent * (n.sum(0) - common))],
                    ["id", "a", "b", "linked"]).filter(pa.array(n.min(0) > 0))
    return run


def of_several_sets(prefixes: DataFrame) -> DataFrame:
    """The rows of tokens that several sets have, and several owners if there are any, each once. All rows are exchanged by
    token, and that only once: which tokens those are is told inside a token's partition."""
    by_token = Window.partitionBy("token")
    held = prefixes.repartition("token")
    for c in ("fp", "owner"):
        if c in prefixes.columns:
            held = held.withColumns({"lo": F.min(c).over(by_token), "hi": F.max(c).over(by_token)}).filter("lo <> hi")
    return held.select("token", "fp", "n", "pos").distinct()


def _whole_sets(k: int):
    def run(batches):
        for b in batches:
            for _, rows, _, h, n, fp in _sets(b.column(0), k):
                bounds = np.zeros(rows + 1, np.int32)
                np.cumsum(n, out=bounds[1:])
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.ListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64)))],
                                                 ["fp", "tokens"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of fingerprints whose whole sets reach the similarity."""
    both = (pairs.join(sets.select(F.col("fp").alias("a"), F.col("tokens").alias("s")), "a")
            .join(sets.select(F.col("fp").alias("b"), F.col("tokens").alias("t")), "b"))
    common = F.size(F.array_intersect("s", "t"))
    return both.select("a", "b", (F.size("s") + F.size("t")).alias("sizes"), common.alias("common")).filter(
        100 * F.col("common").cast("long") >= percent * (F.col("sizes") - F.col("common")).cast("long")).select("a", "b").distinct()


def _centre_pairs(placed: DataFrame, shared: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of sets with the centres of their group that are in another part, at most ``CENTRES`` for each set. A set's weight as a centre is how many sets of its group have its prefix tokens, by its size."""
    part_of = placed.groupBy("group", "part").agg(F.count("*").alias("sets"))
    most = part_of.groupBy("group").agg(F.count("*").alias("parts")).filter("parts > 1").select("group")
    rest = placed.join(most, "group")
    held = saved(shared.select("token", "fp").join(rest, "fp"), "centre-tokens")
    popular = held.groupBy("group", "token").agg(F.count("*").alias("m"))
    weight = held.join(popular, ["group", "token"]).groupBy("group", "fp", "part", "n").agg((F.sum("m") / F.col("n")).alias("w"))
    slot = F.pmod(F.xxhash64("fp", F.lit(turn)), F.lit(CENTRES))
    centres = weight.groupBy("group", slot.alias("slot")).agg(F.max_by(F.struct("fp", "part", "n"), F.struct("w", "fp")).alias("c"))
    pairs = rest.join(centres.select("group", "c"), "group").filter(
        (F.col("part") != F.col("c.part")) & (percent * F.col("n") <= 100 * F.col("c.n")) & (percent * F.col("c.n") <= 100 * F.col("n")))
    pairs = saved(pairs.select(F.least("fp", "c.fp").alias("a"), F.greatest("fp", "c.fp").alias("b")).distinct(), "centre-pairs")
    forget(held)
    return pairs


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT,
                    k: int = WORDS, bits: int = COUNTER_BITS, also: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_shingles``, ``component_id`` (least id of the class) and
    ``n_links`` (verified links that the join kept for the row's set; 0 for most).

    ``also`` holds further rows (id, text), most of them a second text of a document that resembles its first. Such pairs
    are compared side by side; tokens that nobody but one document's two sets have are dropped like those of a single set."""
    spark = docs.sparkSession
    docs = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text}`"].alias("text"))
    if also is not None:
        first, also = docs, also.select(also[f"`{id_col}`"].cast("long").alias("id"), also[f"`{text}`"].alias("text"))
        docs = first.union(also)
    profile = saved(docs.mapInArrow(_profile(k, bits), "id long, n long, fp long, part int, block int, counts binary"), "profile")
    ranks = spark.sparkContext.broadcast(token_ranks(profile.filter("block is not null"), bits).tobytes())
    rows = profile.filter("block is null").select("id", "n", "fp")
    sets_of = rows.filter("n > 0 and id is not null")

    named = docs.filter("id is not null")
    own = None
    if also is None:
        prefixes = named.select("text").mapInArrow(_prefixes(k, bits, percent, ranks), "token long, fp long, n int, pos int")
    else:
        several = saved(sets_of.groupBy("id").agg(F.count("*").alias("texts"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
                        .filter("lo <> hi").select("id", "texts"), "several")
        texts = also.join(small(several.filter("texts = 2").select("id")), "id").withColumnRenamed("text", "other")
        own = saved(first.join(texts, "id").select("id", "text", "other").mapInArrow(
            _own_pairs(k, percent), "id long, a long, b long, linked boolean"), "own-pairs")
        # ids with more texts, as of repeated rows: their sets are told apart like those of different documents
        loose = small(saved(several.join(own, "id", "left_anti").select("id", F.lit(True).alias("loose")), "loose"))
        prefixes = named.join(loose, "id", "left").select("text", F.when(F.col("loose").isNull(), F.col("id")).alias("owner")).mapInArrow(
            _prefixes(k, bits, percent, ranks, True), "token long, fp long, n int, pos int, owner long")
    shared = saved(of_several_sets(prefixes), "shared-tokens")

    def sets_for(fps: DataFrame) -> DataFrame:
        """Whole sets, computed anew from one document of each."""
        ids = saved(sets_of.join(fps.distinct(), "fp").groupBy("fp").agg(F.min("id").alias("id")).select("id").distinct(), "set-ids")
        return saved(docs.join(small(ids), "id").select("text").mapInArrow(_whole_sets(k), "fp long, tokens array<long>"), "sets")

    # groups: sets linked with leaders of their tokens, sizes within a quarter; a token has the first set by each of
    # LEADERS orders as a leader, so that members far from one leader are near another
    leaders = shared.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))).repartition("token")
    lead = leaders.groupBy("token", "size").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.array_distinct(F.array(*[
        F.min_by("fp", F.xxhash64("fp", F.lit(i))) for i in range(LEADERS)])).alias("leaders"))
    led = leaders.join(lead.filter("lo <> hi").select("token", "size", "leaders"), ["token", "size"])
    pairs = led.select("fp", "n", F.explode("leaders").alias("a")).filter("fp <> a").groupBy("a", F.col("fp").alias("b")).agg(
        F.count("*").alias("hits"), F.min("n").alias("n")).filter(F.col("hits") >= F.least(_reach(F.col("n")) * 0.8, F.lit(4)))
    by_leader = saved(pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.max(F.col("hits") >= _reach(F.col("n"))).alias("close")), "leader-pairs")
    pairs = by_leader.select("a", "b")
    if own is not None:
        pairs = saved(pairs.join(own, ["a", "b"], "left_anti"), "leader-others")
    sets = sets_for(pairs.select(F.explode(F.array("a", "b")).alias("fp")))
    links = _verified(pairs, sets, percent)
    links = saved(links if own is None else links.union(own.filter("linked").select("a", "b")).distinct(), "leader-links")
    # parts are linked already; a group gathers the parts around its leaders, linked or not
    forget(sets)
    groups = components(links.union(by_leader.filter("close").select("a", "b"))).withColumnRenamed("component", "group")
    grouped = saved(shared.select("fp", "n").distinct().join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "n", F.coalesce("group", "fp").alias("group")), "grouped")
    forget(by_leader)

    def placed_by(links: DataFrame) -> DataFrame:
        parts = components(links).select(F.col("node").alias("fp"), F.col("component").alias("part"))
        return saved(grouped.join(parts, "fp", "left").select("fp", "n", F.coalesce("part", "fp").alias("part"), "group"), "placed")
    placed = placed_by(links)
    for turn in range(ROUNDS):
        pairs = _centre_pairs(placed, shared, percent, turn)
        if pairs.isEmpty():
            break
        sets = sets_for(pairs.select(F.explode(F.array("a", "b")).alias("fp")))
        more = saved(_verified(pairs, sets, percent), "centre-links")
        forget(sets, pairs)
        if more.isEmpty():
            break
        links = saved(links.union(more), "links")
        forget(placed)
        placed = placed_by(links)
    part_of = placed.groupBy("group", "part").agg(F.count("*").alias("sets"), F.min("n").alias("least"), F.max("n").alias("most"))

    # the token-group matrix, for tokens that several groups have
    sizes = placed.groupBy("group").agg(F.count("*").alias("sets"))
    member = shared.join(placed.join(sizes, "group").select("fp", "group", "sets"), "fp").repartition("token")
    apart = member.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi").select("token")
    member = saved(member.join(apart, "token"), "members").repartition("token")
    matrix = member.groupBy("token", "group", "sets").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("place"))

    def fits(n: Column, least: Column, most: Column) -> Column:
        return (percent * least <= 100 * n) & (percent * n <= 100 * most)
    q, m = member.alias("q"), matrix.alias("m")
    near = (F.struct("q.sets", "q.group") < F.struct("m.sets", "m.group")) & fits(F.col("q.n"), F.col("m.least"), F.col("m.most"))
    first = ((100 + percent) * F.least(F.col("q.n") - F.col("q.pos"), F.col("m.most") - F.col("m.place"))
             >= percent * (F.col("q.n") + F.col("m.least")))
    # places rule out a row only if it is the first shared token, so a pair needs one fitting row at least
    probes = q.join(m, F.col("q.token") == F.col("m.token")).filter(near).groupBy("q.fp", "q.n", "m.group").agg(
        F.count("*").alias("hits"), F.min("m.least").alias("least"), F.bool_or(first).alias("first"))
    probes = probes.filter(F.col("first") & (F.col("hits") >= F.least(_reach(F.col("n")), _reach(F.col("least"))))).select("fp", "n", "group")

    # candidates (set, part): parts of other groups that opened, and the other parts of the set's own group
    across = probes.join(part_of, "group").filter(fits(F.col("n"), F.col("least"), F.col("most"))).select("fp", "n", "part", "sets")
    # inside a group by shared prefix tokens too: each set with the parts, other than its own, that have them
    many = part_of.groupBy("group").agg(F.count("*").alias("parts")).filter("parts > 1").select("group")
    inner = shared.join(placed.join(many, "group").join(part_of.select("part", F.col("sets").alias("own"), "least", "most"), "part"), "fp").select(
        "token", shared["fp"], shared["n"], "pos", "group", "part", "own", "least", "most").repartition("token")
    union = inner.groupBy("token", "group", "part", "own").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("pos").alias("place"))
    q, m = inner.alias("q"), union.alias("m")
    # a pair that links fits by the places of its first shared token; rows that do not fit never leave the join. In a family
    # of copies the tokens of a copy's own edits come first, which rules it out against all that it resembles too little
    place = ((100 + percent) * F.least(F.col("q.n") - F.col("q.pos"), F.col("m.most") - F.col("m.place"))
             >= percent * (F.col("q.n") + F.col("m.least")))
    within = q.join(m, (F.col("q.token") == F.col("m.token")) & (F.col("q.group") == F.col("m.group"))
                    & (F.struct("q.own", "q.part") < F.struct("m.own", "m.part")) & fits(F.col("q.n"), F.col("m.least"), F.col("m.most")) & place
                    ).select("q.fp", "q.n", F.col("m.part").alias("part"), F.col("m.own").alias("sets")).distinct()
    probes = saved(across.union(within).distinct(), "probes")
    sets = sets_for(probes.select("fp").union(placed.join(probes.select("part").distinct(), "part").select("fp")))
    forget(shared, grouped)

    # the whole union bounds the overlap with parts of several sets
    wide = probes.filter("sets > 1")
    union = (placed.select("part", "fp").join(wide.select("part").distinct(), "part").join(sets, "fp")
             .select("part", F.explode("tokens").alias("token")).distinct())
    overlap = (wide.select("fp", "n", "part").join(sets, "fp").select("fp", "n", "part", F.explode("tokens").alias("token"))
               .join(union, ["part", "token"]).groupBy("fp", "n", "part").agg(F.count("*").alias("hits")))
    opened = probes.filter("sets = 1").select("fp", "n", "part").union(
        overlap.filter(100 * F.col("hits") >= percent * F.col("n")).select("fp", "n", "part"))
    inside = placed.select("part", F.col("fp").alias("other"), F.col("n").alias("m"))
    pairs = opened.join(inside, "part").filter(
        (percent * F.col("m") <= 100 * F.col("n")) & (percent * F.col("n") <= 100 * F.col("m"))).select(
        F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
    links = saved(links.union(_verified(pairs, sets, percent)).distinct(), "all-links")

    classes = components(links).withColumnRenamed("node", "fp")
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    classes = saved(classes.join(degree, "fp"), "classes")
    forget(probes, sets)
    marked = rows.join(small(classes), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    first = marked.filter("n > 0 and id is not null").groupBy("class").agg(F.min("id").alias("first"))
    own = F.col("id").isNull() | (F.col("n") == 0)
    return marked.join(first, "class", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(own, F.col("id")).otherwise(F.col("first")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT,
                     also: DataFrame | None = None) -> DataFrame:
    """The documents that are the least id of their class; rows without an id stay. ``also`` holds further
    texts (id, text) of documents: one goes if any of its texts has a near copy with a lesser id."""
    judged = docs.select(docs[f"`{id_col}`"], docs[f"`{text}`"])
    stay = saved(jaccard_classes(judged, id_col, text, percent, also=also).filter(f"component_id <> {id_col}").select(id_col).distinct(), "copies")
    return docs.join(small(stay), id_col, "left_anti")


