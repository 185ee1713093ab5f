import hashlib
import heapq
import random
import re
import zlib

import pytest

from vimarsha.llm.conversations import audit_conversations, cost_of, damaged, repair_conversations, tight_edits


def brute_audit(rows):
    """Cheapest edits by a uniform-cost search over (cost, audit) of (place, roles so far as a pattern state)."""
    def state_of(letters):
        return re.fullmatch("s?(ua)*u?", letters) is not None
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, letters = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", letters):
            return cost, audit
        short = letters if len(letters) < 3 else letters[-2:]
        if (i, short) in done:
            continue
        done.add((i, short))
        for role in "ua":
            if state_of(letters + role):
                heapq.heappush(heap, (cost + 2, audit + "I", i, letters + role))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, letters))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if initial in tuple("sua") and state_of(letters + initial):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, letters + initial))
                for role in "ua":
                    if state_of(letters + role):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, letters + role))


def brute(rows):
    """Rows (turn, role, text) after damage, in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        ink = re.findall("[^\x20\x09-\x0d]", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit = brute_audit([(r[1][:1], f) for r, f in zip(rows, faults)])
    turns = [t for t, _, _ in rows if t is not None]
    out, i, letters = [], 0, ""
    for edit in audit:
        wanted = "assistant" if letters.endswith("u") else "user"
        if edit == "I":
            out.append((wanted, ""))
        else:
            _, role, text = rows[i]
            i += 1
            if edit == "D":
                continue
            out.append((role if edit == "K" else wanted, text))
        letters += out[-1][0][:1]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}, out


def break_rows(rows):
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        elif h == 2:
            text = re.sub("[.!?]", "", text)
        elif h == 4:
            role = "user"
        held += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def random_rows(r):
    rows = []
    for conv in [None, *range(150)]:
        roles = ["system"] * r.randint(0, 2) + ["user", "assistant"] * 3
        for turn in range(r.randint(1, 12)):
            role = roles[turn % len(roles)] if r.random() < 0.7 else r.choice(["system", "user", "assistant", "tool", "User", "", None])
            text = r.choice(["Yes.", "Why? ", "no end", " \n\t", "", None, "été !\n", "a", "So. " * 30 + " " * 90, " ", f"t{turn}."])
            rows.append((conv, r.choice([None, turn, turn, turn, turn + 2, -turn]), role, text))
    return rows


def test_equals_brute_force(spark):
    rows = random_rows(random.Random(7))
    rows += rows[:5]
    df = spark.createDataFrame([(*x, "x") for x in rows], "conv_id long, turn long, role string, text string, TURN string").repartition(6)
    broken = damaged(df)
    want = {c: brute(r) for c, r in break_rows(rows).items()}
    got = audit_conversations(broken).collect()
    assert len(got) == len(want)
    for g in got:
        assert {k: g[k] for k in want[g.conv_id][0]} == want[g.conv_id][0], g
    turns = {}
    for t in repair_conversations(broken).orderBy("place").collect():
        turns.setdefault(t.conv_id, []).append((t.role, t.text))
    assert {c: out for c, (_, out) in want.items() if out} == turns


def test_undamaged_input_and_conversations_without_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (2, 0, "user", "Lost?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in audit_conversations(df).collect()}
    assert (got[1].audit, got[1].cost, got[2].audit, got[2].cost) == ("KK", 0, "KI", 2)
    gone = next(i for i in range(999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], df.schema))
    row = audit_conversations(one).collect()[0]
    assert (row.conv_id, row.audit, row.cost, row.repaired_sha256) == (gone, "", 0, hashlib.sha256(b"").hexdigest())
    assert audit_conversations(damaged(df.limit(0))).count() == 0 == repair_conversations(df.limit(0)).count()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9, 10, 16, 17, 40])
def test_walk_equals_brute_force(n):
    r = random.Random(n)
    for _ in range(60):
        rows = [(r.choice(["s", "u", "a", "x"]), r.choice(["", "", "truncated", "blank"])) for _ in range(n)]
        codes = bytes("suax".index(a) + 4 * {"": 0, "truncated": 1, "blank": 2}[f] for a, f in rows)
        cost, audit = brute_audit(rows)
        assert ("".join(e for e, _, _ in tight_edits(codes)), cost_of(codes)) == (audit, cost)


def test_one_very_long_conversation(spark):
    rows = [(5, i, ("user", "assistant")[i % 2], f"turn {i}." + "x" * (i % 50) + ".") for i in range(30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    row = audit_conversations(df).collect()[0]
    text = "\n".join(f"{r}:{t}" for _, _, r, t in rows)
    assert row.audit == "K" * 30_000 and row.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
