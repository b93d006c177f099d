"""Repairs beside a search over all states that keeps the least audit, and alignment beside all audits of short conversations."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from tidemark.llm import turn_alignment as ta

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    made = []
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        made += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return made


def step(state, role):
    """The state after a role, None if it is not due."""
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, role))


def cheapest(turns):
    """(cost, audit, lines) of (role, text, fault)."""
    names = {"u": "user", "a": "assistant"}
    best = {0: (0, "", ())}
    for role, text, fault in turns:
        new = {}

        def put(state, value):
            if state is not None and (state not in new or value[:2] < new[state][:2]):
                new[state] = value

        for state, (cost, audit, lines) in best.items():
            for _ in range(3):
                put(state, (cost + 3, audit + "D", lines))
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    put(step(state, role[:1]), (cost + more, audit + "K", lines + (f"{role}:{text}",)))
                    for r in "ua":
                        if role[:1] != r:
                            put(step(state, r), (cost + 2 + more, audit + "R", lines + (f"{names[r]}:{text}",)))
                r = "a" if state == 2 else "u"
                state, cost, audit, lines = step(state, r), cost + 2, audit + "I", lines + (f"{names[r]}:",)
        best = new
    tails = {0: [], 1: ["user:", "assistant:"], 2: ["assistant:"], 3: []}
    return min(((c + 2 * len(tails[s]), a + "I" * len(tails[s]), ls + tuple(tails[s])) for s, (c, a, ls) in best.items()), key=lambda v: v[:2])


def repaired(rows):
    rows = sorted(rows, key=lambda q: (q[1] is not None, q[1] or 0, hashlib.sha256(f"{len(q[2])}:{q[2]}{q[3]}".encode()).hexdigest()))
    seen, turns = set(), []
    for _, _, role, text in rows:
        stripped = text.rstrip(" \t\n\x0b\f\r")
        turns.append((role, text, "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None))
        seen.add((role, text))
    faults = [f for _, _, f in turns]
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    cost, audit, lines = cheapest(turns)
    numbers = [q[1] for q in rows if q[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def plain(rows):
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    return {(conv, *repaired(turns)) for conv, turns in by.items()}


def rows():
    draw = random.Random(5)
    made = []
    for conv in [*range(25), None]:
        for i in range(draw.choice([1, 3, 8, 20, 40, 90])):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None])
            made.append((conv, draw.choice([i, i, None if i % 9 == 0 else i]), role, draw.choice(["Hi.", f"Text {i}.", f"Text {i}", " ", "", None, f"So {i}!\n", f"é {i} ?", "x" * 500])))
    made += [(77, i, ("assistant", "user")[i % 2 == 0], f"Fine {i}.") for i in range(2500)]
    return made + [(78, 4, "user", "Same.")] * 100 + [(79, 2**63 - 1, "user", "a."), (79, -(2**63), "user", "b.")]


def test_repair(spark):
    want = {r if r[0] != 79 else (79, None, *r[2:]) for r in plain(rows())}
    turns = spark.createDataFrame(rows(), SCHEMA).withColumns({"g": F.lit(1), "kind": F.lit("x"), "index": F.lit(0)}).repartition(3)
    assert set(map(tuple, ta.repair_table(turns).collect())) == want


def test_empty(spark):
    assert ta.repair_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "One."), (1, 1, "user", "Two."), (1, 2, "user", "")], SCHEMA)
    made = ta.Repair(turns).turns().orderBy("step").collect()
    assert [(r["role"], r["text"], r["edit"]) for r in made] == [("user", "One.", "K"), ("assistant", "Two.", "R")]


def test_alignment_beside_all_audits():
    """Every string of edits of short conversations is tried."""
    faults = {"-": "blank"}
    for codes in map("".join, itertools.product("suaxU-", repeat=3)):
        turns = [(c.lower() if c != "-" else "x", "", faults.get(c, "truncated" if c.isupper() else None)) for c in codes]
        assert ta.whole(codes) == cheapest(turns)[:2], codes


def test_pieces_join_like_a_whole():
    draw = random.Random(2)
    last = [2 * len(ta.LAST[s]) for s in range(4)]
    for _ in range(60):
        codes = "".join(draw.choice("suauaxUA-") for _ in range(14))
        left, right = ta.piece(codes[:6]), ta.piece(codes[6:])
        rest = [min(min(right[0][4 * p + q] + last[q] for q in range(4)), ta.NEVER) for p in range(4)]
        mid = ta.choose(*left, rest)[0]
        end = ta.choose(*right, last)[mid]
        assert (left[0][mid] + right[0][4 * mid + end] + last[end], left[1][mid] + right[1][4 * mid + end] + ta.LAST[end]) == ta.whole(codes)
