"""Conversation repair against trying edits row by row, and against all edits of short conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessera.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, cost string, run int, audit double, first string"
SPACE = " \t\n\x0b\x0c\r"
PATTERN = re.compile(r"(s?(ua)+)?")


def faulty(rows):
    """Rows after damage, by conversation and in order: (turn, role, text, fault)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, judged = set(), []
        for turn, role, text in own:
            body = text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((turn, role, text, fault))
        out[conv] = judged
    return out


def cheapest(rows):
    """(cost, audit) by going through the rows with the best way to each state of the pattern."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(ways):
        for _ in range(4):
            for q, (c, a) in list(ways.items()):
                for r in "ua":
                    if (q, r) in step:
                        ways[step[q, r]] = min(ways.get(step[q, r], (10**9, "")), (c + 2, a + "I"))
        return ways

    ways = inserted({0: (0, "")})
    for _, role, _, fault in rows:
        new = {}
        for q, (c, a) in ways.items():
            options = [(q, 3, "D")]
            if fault in ("", "truncated"):
                late = int(fault == "truncated")
                options += [(step[q, x], late + cost, letter) for x, cost, letter in ((role[:1], 0, "K"), ("u", 2, "R"), ("a", 2, "R")) if (q, x) in step]
            for to, cost, letter in options:
                new[to] = min(new.get(to, (10**9, "")), (c + cost, a + letter))
        ways = inserted(new)
    return min(ways[q] for q in (0, 3) if q in ways)


def lines(rows, audit):
    """The repaired lines: roles follow from the pattern."""
    out, rows = [], iter(rows)
    for letter in audit:
        row = next(rows) if letter != "I" else None
        if letter == "D":
            continue
        if letter == "K":
            out.append((row[1], row[2]))
        else:
            role = "assistant" if out and out[-1][0][:1] == "u" else "user"
            out.append((role, "" if letter == "I" else row[2]))
    assert PATTERN.fullmatch("".join(r[:1] for r, _ in out))
    return out


def expected(rows):
    out = {}
    for conv, own in faulty(rows).items():
        cost, audit = cheapest(own)
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(r[3] == f for r in own) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines(own, audit)).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, sha)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {conv: out.get(conv, nothing) for conv, *_ in rows}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5, "y") for r in rows], SCHEMA)


def results(spark, rows):
    found, turns = cv.repair_conversations(cv.damaged(frame(spark, rows)))
    by = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: r["run"]):
        by[r["conv_id"]].append(r)
    got = {r["conv_id"]: tuple(r)[1:] for r in found.collect()}
    for conv, parts in by.items():
        assert "".join(p["edits"] for p in parts) == got[conv][6]
        text = "\n".join(f"{t['role']}:{t['text']}" for p in parts for t in p["turns"])
        assert hashlib.sha256(text.encode()).hexdigest() == got[conv][7]
    return got


def corpus(seed, long):
    rng = random.Random(seed)
    role = lambda: rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "superuser"])
    text = lambda: rng.choice(["Yes.", "No!", "why", "ok?\n", " \t", "", None, "Größe…", "same.", f"t{rng.random()}."])
    rows = []
    for conv in [*range(-20, 60), None]:
        for turn in range(rng.randint(1, 7)):
            rows += [(conv, rng.choice([turn, turn, turn, None, turn + 3]), role(), text())] * rng.choice([1, 1, 1, 2])
    rows += [(1000, rng.choice([k, k // 3, None]), role(), text()) for k in range(long)]
    rows += [(1001, k, ["user", "assistant"][k % 2], f"Turn {k}.") for k in range(long)]
    rows += [(1002, 5, "user", "one row, many times.")] * 40
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "run_rows", "run_bytes"), [(1, 512, 1 << 20), (2, 3, 1 << 20), (3, 1, 1 << 20), (4, 512, 8)])
def test_against_row_by_row(spark, monkeypatch, seed, run_rows, run_bytes):
    monkeypatch.setattr(cv, "RUN_ROWS", run_rows)
    monkeypatch.setattr(cv, "RUN_BYTES", run_bytes)
    rows = corpus(seed, 150)
    want = {k: v for k, v in expected(rows).items() if k in faulty(rows)}
    assert results(spark, rows) == want


def tried(roles, late):
    """The least (cost, audit) of all edits with at most three inserts."""
    best = None
    for letters in itertools.product("KRD", repeat=len(roles)):
        for places in itertools.product(range(4), repeat=len(roles) + 1):  # inserts before each row and at the end
            if sum(places) > 3:
                continue
            audit = "".join("I" * n + x for n, x in zip(places, [*letters, ""], strict=True))
            out, at, cost = "", 0, 0
            for x in audit:
                if x == "K":
                    out += roles[at]
                elif x != "D":
                    out += "a" if out[-1:] == "u" else "u"
                cost += {"K": 0, "R": 2, "D": 3, "I": 2}[x] + (x in "KR" and late[at])
                at += x != "I"
            if PATTERN.fullmatch(out):
                best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("late", list(itertools.product((False, True), repeat=3)))
def test_all_edits_of_short_conversations(late):
    for roles in itertools.product("suax", repeat=3):
        steps = [cv.row_edges(r, t, True, 0) for r, t in zip(roles, late, strict=True)]
        assert list(cv.lightest(steps, 0, (0, 3)).values()) == [tried(roles, late)], roles


def test_every_conversation_is_returned(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (None, None, None, None), (3, 1, "user", "Hi."), (3, 2, "assistant", "Ho.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r)[1:] for r in cv.op11(spark, str(tmp_path)).collect()}
    assert got == expected(rows) and len(got) == 3 and got[gone][-1] == hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    found, turns = cv.repair_conversations(frame(spark, []))
    assert found.count() == 0 and turns.count() == 0
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"] * 2
