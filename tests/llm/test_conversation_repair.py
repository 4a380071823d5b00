"""Conversation repair against a search over all edits, and its chunks against whole conversations."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import pytest

from bizcontacts.llm.common import Scratch
from bizcontacts.llm.conversation_repair import conversation_edits, damage_turns, repair_digest, speculate, trace

SCHEMA = "conv_id long, turn long, role string, text string, conv long, chunk string, audit string"
WHOLE = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        fault = "b" if not bare.strip(" \t\n\x0b\f\r") else "d" if (role, text) in seen else \
            "t" if bare[-1] not in ".!?" else "-"
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, faults):
    """(cost, audit, lines) by uniform-cost search over written initials, least audit first."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, written, lines = heappop(heap)
        tail = (i, written[:1] == "s" and len(written) == 1, written[-1:] if written else "", bool(written))
        if i == len(rows) and WHOLE.fullmatch(written):
            return cost, audit, lines
        if tail in done:
            continue
        done.add(tail)

        def go(c, letter, role, text, j):
            new = written + role[:1]
            if re.fullmatch(r"s?(ua)*u?", new):
                heappush(heap, (cost + c, audit + letter, j, new, (*lines, f"{role}:{text}")))
        for role in ("user", "assistant"):
            go(3, "I", role, "", i)
        if i < len(rows):
            _, role, text = rows[i]
            heappush(heap, (cost + 4, audit + "D", i + 1, written, lines))
            if faults[i] not in "bd":
                extra = 3 if faults[i] == "t" else 0
                if role:
                    go(extra, "K", role, text, i + 1)
                for other in ("user", "assistant"):
                    go(extra + 3, "R", other, text, i + 1)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        rule = zlib.crc32(key.encode()) % 20
        if rule == 0:
            continue
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        out += [(conv, turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1)
    return out


def expected(all_rows, original):
    out = []
    for conv in {r[0] for r in original}:
        rows = sorted(((t, r, x) for c, t, r, x in all_rows if c == conv), key=lambda r: (
            r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        faults = faults_of(rows)
        cost, audit, lines = cheapest(rows, faults)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(conversations, longest, seed):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", "User", None])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \n", "and? ", "é.", None, f"say {rng.randint(0, 30)}."])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randint(0, 1), role, text))
    return rows


def digest(spark, rows, damage, chunk):
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA).repartition(4)
    source = damage_turns(df) if damage else df
    edits = conversation_edits(source, Scratch(spark, "t"), chunk)
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r[c] for c in columns) for r in repair_digest(edits, df).collect()), key=repr)


@pytest.mark.parametrize("chunk", [1, 2, 5, 4096])
def test_damaged_conversations_are_repaired_at_least_cost(spark, chunk):
    rows = made(40, 12, 1)
    assert digest(spark, rows, True, chunk) == expected(damaged(rows), rows)


def test_long_conversations_that_hardly_converge(spark):
    rows = [(1, k, "tool", f"say {k}.") for k in range(150)]  # every turn keeps the parity of what follows
    rows += [(2, k, "user", "same.") for k in range(120)] + [(2, 500, "assistant", "end.")]  # all but two go
    rows += [(3, k, "user" if k % 2 else "assistant", f"t{k}.") for k in range(101)]
    given = [(c, t, r, x) for c, t, r, x in rows]
    assert digest(spark, rows, False, 4) == expected(given, rows)


def test_any_speculation_traces_like_the_whole():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 30)
        roles = "".join(rng.choice("suax") for _ in range(n))
        faults = "".join(rng.choice("---btd") for _ in range(n))
        vectors = speculate(roles, faults)
        end = [0, 6, 3, 0]
        start = [min(end[k] + vectors[k][q] for k in range(4)) for q in range(4)]
        audit, _ = trace(roles, faults, end, 0, True)
        price = {"K": 0, "R": 3, "D": 4, "I": 3}
        at, cost = 0, 0
        for e in audit:
            cost += price[e]
            if e != "I":
                cost += 3 if e != "D" and faults[at] == "t" else 0
                at += 1
        assert at == n and cost == start[0]


def test_edits_hold_the_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "tool", "x"), (1, 3, "user", " ")]
    edits = conversation_edits(spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA), Scratch(spark, "t"))
    got = [(r.edit, r.fault, r.turn, r.role, r.text) for r in sorted(edits.collect(), key=lambda r: r.place)]
    assert got == [("K", "-", 0, "system", "S."), ("I", None, None, "user", ""), ("K", "-", 1, "assistant", "A."),
                   ("D", "t", 2, None, None), ("D", "b", 3, None, None)]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    edits = conversation_edits(none, Scratch(spark, "t"))
    assert edits.count() == 0 and repair_digest(edits, none).count() == 0
