"""Conversation structure repair: the cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

Rows of a conversation stand by turn (NULL first), then by role and text. A row's first fault counts: blank (nothing
but white space), duplicate (role and text seen earlier), truncated (its last character that is not white space is
none of ``.!?``). Edits: Keep, Rerole to the user or assistant that fits, Delete (the only way for blank and duplicate
rows), Insert an empty user or assistant turn. The letters that the pattern allows form a small automaton in which a
state and an edit determine the role, so one letter per edit tells all.

The costs to the end are computed backwards: a vector with one cost for each state before each row. Only the vectors
at every ``sqrt(n)``-th row are kept; walking forward, each block's vectors are recomputed from the checkpoint behind it
and the least letter (D, I, K, R) whose cost is tight is emitted. That gives the ASCII-least of the cheapest audits:
none is a proper prefix of another, since edits after the last row cost something.

Conversations are dealt by their id and stream through Arrow batches in order, so a task keeps one conversation at a
time: a byte and a role's place per row for the search, digests of its texts for duplicates, its rows in a spooled file
that stays in memory up to ``SPOOL`` bytes and is gone when the conversation ends. The audit and the digest of the
repaired text are sequential values of a whole conversation, hence one task for each.

Defined cases: NULL roles and texts are one space; a NULL turn comes first and counts in no gap; a NULL id is one
conversation; repeated rows are duplicates; a conversation whose rows all went keeps its row with zeros; empty tables
give empty results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, only

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after the system, after a user, after an assistant. What a further user or assistant makes of them.
NEXT = (2, 2, 3, 2)
ROLE_INTO = {2: "user", 3: "assistant"}
#: Where keeping a role leads: initial -> state -> state.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
INITIALS = "sua"
ROLE_CODES = {"s": 0, "u": 1, "a": 2}
FAULT_CODES = {"truncated": 1, "blank": 2, "duplicate": 2}
NEVER = float("inf")
LEGAL = {"su", "ua", "au"}
SPOOL = 32 << 20
#: Rows and bytes of text of a batch that a task returns.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20
SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string, n_rows long, n_repaired long")
TURNS = "conv_id long, place long, edit string, turn long, role string, text string"


def damaged(df: DataFrame, every: int = 20) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) broken by the CRC-32 of ``conv_id:turn`` (NULL: one space), remainder by
    ``every``: 0 gone, 1 no text, 2 no marks, 3 twice, 4 by the user."""
    df = only(df, "conv_id", "turn", "role", "text")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    how = F.col("how")
    text = F.coalesce("text", F.lit(" "))
    rows = df.withColumn("how", F.crc32(key.cast("binary")) % every).select(
        "conv_id", "turn", F.when(how == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (how == 0).alias("gone"), F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"))
    return rows.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def relaxed(costs: list) -> list:
    """Costs before a row once turns may be inserted there. Two insertions reach all that any number reaches."""
    once = [min(costs[s], INSERT + costs[NEXT[s]]) for s in range(4)]
    return [min(once[s], INSERT + once[NEXT[s]]) for s in range(4)]


#: Costs to the end after the last row: the pattern ends with nothing or after an assistant.
END = relaxed([0, NEVER, NEVER, 0])


def _deleted(fault: int, then: list, s: int) -> float:
    return DELETE + then[s]


def _kept(role: str, fault: int, then: list, s: int) -> float:
    to = KEPT.get(role, {}).get(s) if fault != 2 else None
    return NEVER if to is None else KEEP + TRUNCATED * (fault == 1) + then[to]


def _reroled(fault: int, then: list, s: int) -> float:
    return NEVER if fault == 2 else REROLE + TRUNCATED * (fault == 1) + then[NEXT[s]]


def before(role: str, fault: int, then: list) -> list:
    """Costs before a row, by the costs behind it. Faults: 0 none, 1 truncated, 2 must go."""
    return relaxed([min(_deleted(fault, then, s), _kept(role, fault, then, s), _reroled(fault, then, s)) for s in range(4)])


def tight_edits(codes: bytes):
    """Yields (edit, place of its row or None, state it leads to), the ASCII-least of the cheapest. A code is 4 * fault +
    place of the role's initial in ``INITIALS`` or 3."""
    n = len(codes)
    step = max(1, math.isqrt(n))
    parts = [(INITIALS[c & 3:(c & 3) + 1], c >> 2) for c in range(12)]
    marks, costs = {}, END
    for i in range(n, -1, -1):
        if i % step == 0 or i == n:
            marks[i] = costs
        if i:
            role, fault = parts[codes[i - 1]]
            costs = before(role, fault, costs)
    state = 0
    for first in range(0, n + 1, step):
        last = min(first + step, n)
        block = [marks[last]]
        for i in range(last, first, -1):
            role, fault = parts[codes[i - 1]]
            block.append(before(role, fault, block[-1]))
        block.reverse()
        for i in range(first, last + (last == n)):
            now = block[i - first]
            while True:
                left = now[state]
                if i < n:
                    role, fault = parts[codes[i]]
                    then = block[i - first + 1]
                    if _deleted(fault, then, state) == left:
                        yield "D", i, state
                        break
                elif left == 0:
                    break
                if INSERT + now[NEXT[state]] == left:
                    state = NEXT[state]
                    yield "I", None, state
                elif _kept(role, fault, then, state) == left:
                    state = KEPT[role][state]
                    yield "K", i, state
                    break
                else:
                    state = NEXT[state]
                    yield "R", i, state
                    break
        if last == n:
            break


def cost_of(codes: bytes) -> int:
    costs = END
    for c in reversed(codes):
        costs = before(INITIALS[c & 3:(c & 3) + 1], c >> 2, costs)
    return costs[0]


class _Conversation:
    """Rows of one conversation as they come, in order."""

    def __init__(self, key):
        self.key, self.codes, self.seen = key, bytearray(), set()
        self.rows = tempfile.SpooledTemporaryFile(SPOOL)
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.turn = None
        self.turns = self.illegal = 0
        self.initial = None

    def add(self, turn, role, text):
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        mark = hashlib.sha256(b"%d:" % len(role) + f"{role}{text}".encode()).digest()
        last = text.rstrip(BLANKS)[-1:]
        fault = "blank" if not last else "duplicate" if mark in self.seen else "truncated" if last not in ".!?" else None
        self.seen.add(mark)
        if fault:
            self.faults[fault] += 1
        self.codes.append(4 * FAULT_CODES.get(fault, 0) + ROLE_CODES.get(role[:1], 3))
        pickle.dump((turn, role, text), self.rows)

    def repaired(self):
        """(edit, turn, role, text) of each edit; None for what it takes out."""
        self.rows.seek(0)
        for edit, place, state in tight_edits(bytes(self.codes)):
            turn, role, text = pickle.load(self.rows) if place is not None else (None, None, "")
            if edit == "D":
                yield edit, turn, None, None
            else:
                yield edit, turn, role if edit == "K" else ROLE_INTO[state], text

    def summary(self):
        digest, audit, n = hashlib.sha256(), [], 0
        for edit, _, role, text in self.repaired():
            audit.append(edit)
            if edit != "D":
                digest.update((b"\n" if n else b"") + f"{role}:{text}".encode())
                n += 1
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return (self.key, gaps, *self.faults.values(), self.illegal, cost_of(self.codes), "".join(audit), digest.hexdigest(),
                len(self.codes), n)

    def turns_kept(self):
        n = 0
        for edit, turn, role, text in self.repaired():
            if edit != "D":
                yield self.key, n, edit, turn, role, text
                n += 1


def _conversations(batches):
    talk = None
    for b in batches:
        for key, turn, role, text, gone in zip(*[b.column(i).to_pylist() for i in range(5)]):
            if talk is None or key != talk.key:
                if talk is not None:
                    yield talk
                talk = _Conversation(key)
            if not gone:
                talk.add(turn, role, text)
    if talk is not None:
        yield talk


def _in_batches(rows, schema):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schema(ddl):
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _ordered(df: DataFrame) -> DataFrame:
    if "gone" not in df.columns:
        df = only(df, "conv_id", "turn", "role", "text").withColumn("gone", F.lit(False))
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
                     F.coalesce("text", F.lit(" ")).alias("text"), "gone")
    return rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


def audit_conversations(df: DataFrame) -> DataFrame:
    """One row per conversation: its gaps and faults, the cost and letters of its edits, the digest of its repaired turns."""
    def run(batches):
        yield from _in_batches((c.summary() for c in _conversations(batches)), _schema(SUMMARY))
    return _ordered(df).mapInArrow(run, SUMMARY)


def repair_conversations(df: DataFrame) -> DataFrame:
    """The repaired turns: (conv_id, place from 0, edit, turn as it was, role, text)."""
    def run(batches):
        yield from _in_batches((t for c in _conversations(batches) for t in c.turns_kept()), _schema(TURNS))
    return _ordered(df).mapInArrow(run, TURNS)
