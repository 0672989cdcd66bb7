import hashlib
import itertools
import random
import re
import zlib

import pytest

from quaystone.llm import conversation_repair as cr
from quaystone.llm.conversation_repair import damaged, repair_report, repaired, repaired_turns

DIR = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")


def broken(rows):
    """Damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def forward(rows, marks):
    """Cheapest repair by a plain pass from the front: for every string of initials' state, the least (cost, edits)."""

    def states(initials):
        return initials if initials in ("", "s") else ("s" if initials[0] == "s" else "") + ("u" if initials[-1] == "u" else "ua")

    best = {"": (0, "", ())}

    def put(into, state, value):
        if state not in into or value < into[state]:
            into[state] = value

    def inserted(now):
        for _ in range(3):
            for state, (cost, edits, done) in list(now.items()):
                for role in ("user", "assistant"):
                    if GOOD.fullmatch(state + role[0]) or GOOD.fullmatch(state + role[0] + "a"):
                        put(now, states(state + role[0]), (cost + 5, edits + "I", (*done, role + ":")))
        return now

    for (role, text), mark in zip(rows, marks, strict=True):
        after = {}
        for state, (cost, edits, done) in inserted(best).items():
            put(after, state, (cost + 2, edits + "D", done))
            if mark in ("blank", "duplicate"):
                continue
            for edit, new, more in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                follows = state + new[:1]
                if len(follows) > len(state) and (GOOD.fullmatch(follows) or GOOD.fullmatch(follows + "a") or follows == "s"):
                    put(after, states(follows), (cost + more + 5 * (mark == "truncated"), edits + edit, (*done, f"{new}:{text}")))
        best = after
    return min(v for k, v in inserted(best).items() if GOOD.fullmatch(k))


def every_repair(codes):
    """All repairs of a few rows with at most two turns put in, by trying them all."""
    best = None
    for edits in itertools.product("DKRr", repeat=len(codes)):
        for puts in itertools.product(["", "I", "II"], repeat=len(codes) + 1):
            if sum(map(len, puts)) > 2:
                continue
            for roles in itertools.product("ua", repeat=sum(map(len, puts))):
                cost, text, initials, left = 0, "", "", list(roles)
                for i in range(len(codes) + 1):
                    for _ in puts[i]:
                        initials, text, cost = initials + left.pop(0), text + "I", cost + 5
                    if i < len(codes):
                        e = edits[i]
                        initials += "" if e == "D" else codes[i].lower() if e == "K" else "u" if e == "R" else "a"
                        text += e.upper()
                        cost += 2 if e == "D" else (e != "K") + 5 * codes[i].isupper() + 1000 * (codes[i] == "d")
                if GOOD.fullmatch(initials) and (best is None or (cost, text) < best):
                    best = (cost, text)
    return best


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in broken(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        said = [r[1:] for r in mine]
        marks, turns = faults(said), {r[0] for r in mine} - {None}
        cost, audit, done = forward(said, marks)
        initials = [r[0][:1] for r in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n):
    rng = random.Random(seed)
    said = ["Hi.", "Hello there!", "No end", "", "  ", "Why?\n", "Long. " * 30, "é", "¿Qué?"]
    out = []
    for conv in range(n):
        for turn in range(rng.choice([0, 1, 2, 5, 9, 40])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, None, 1]), role, rng.choice([*said, None]) if rng.random() < 0.5 else f"Turn {turn} of {conv}."))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, edits string").repartition(3)


def run(spark, rows):
    return sorted((tuple(r) for r in repair_report(repaired(damaged(frame(spark, rows)))).collect()), key=str)


def test_forward_pass_and_walk_against_all_repairs():
    rng = random.Random(1)
    for n in [0, 1, 1, 2, 2, 3, 3, 3, 4, 4]:
        codes = "".join(rng.choice("suaxSUAXd") for _ in range(n))
        want = every_repair(codes)
        edits, state, cost = cr.walk(codes, cr.END, 0, True)
        assert (cost, edits) == want, codes
        said = [({"s": "system", "u": "user", "a": "assistant", "x": "tool"}[c.lower()] if c != "d" else "user", f"{i}" if c.isupper() else f"{i}.") for i, c in enumerate(codes)]
        marks = ["blank" if c == "d" else "truncated" if c.isupper() else None for c in codes]
        assert forward(said, marks)[:2] == want, codes


def test_checkpoints_agree_with_a_plain_walk():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 8, 9, 10, 99, 100, 101, 1000):
        codes = "".join(rng.choice("ssuuuuaaaaUAxXd") for _ in range(n))
        said = [({"s": "system", "u": "user", "a": "assistant", "x": "tool"}.get(c.lower(), "user"), "") for c in codes]
        marks = ["blank" if c == "d" else "truncated" if c.isupper() else None for c in codes]
        edits, _, cost = cr.walk(codes, cr.END, 0, True)
        assert (cost, edits) == forward(said, marks)[:2]


def test_against_brute_force(spark):
    rows = made(3, 120) + [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (500, 1, "user", "Once.")] + [(501, None, "user", f"{i}.") for i in range(9)]
    rows += [(502, 7, "assistant", "Again.")] * 30
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(r[1] for r in got) and {r[7] for r in got} >= {""}


@pytest.mark.parametrize("limits", [(1, 1 << 20), (3, 1 << 20), (4096, 40)])
def test_conversations_over_many_segments(spark, monkeypatch, limits):
    monkeypatch.setattr(cr, "SEGMENT_ROWS", limits[0])
    monkeypatch.setattr(cr, "SEGMENT_BYTES", limits[1])
    rows = made(4, 25) + [(900, i, ["user", "assistant"][i % 2], f"{i % 50}.") for i in range(300)] + [(901, i, "user", "Same.") for i in range(60)] + [(902, 3, "user", "Copy.")] * 25 + [(None, i, "assistant", f"{i}") for i in range(20)]
    segments = repaired(damaged(frame(spark, rows)))
    assert segments.groupBy("conv_id").count().filter("count > 3").count() >= (3 if limits[0] < 100 else 1)
    assert sorted((tuple(r) for r in repair_report(segments).collect()), key=str) == brute(rows)


def test_repaired_turns_are_what_the_digest_says(spark, tmp_path):
    segments = repaired(damaged(frame(spark, made(5, 40))), str(tmp_path))
    turns = repaired_turns(segments).orderBy("conv_id", "part", "seq", "place").collect()
    for r in repair_report(segments).collect():
        mine = [(t.role, t.text) for t in turns if t.conv_id == r.conv_id]
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mine).encode()).hexdigest() == r.repaired_sha256
        assert GOOD.fullmatch("".join(a[0] for a, _ in mine)) and len(mine) == len(r.audit) - r.audit.count("D")


def test_empty_table_and_real_rows(spark):
    assert run(spark, []) == []
    turns = spark.read.parquet(f"{DIR}/conversations.parquet")
    got = sorted((tuple(r) for r in repair_report(repaired(damaged(turns))).collect()), key=str)
    assert got == brute([(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()])
