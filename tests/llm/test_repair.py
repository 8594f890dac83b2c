"""Conversation repair against a table of all cheapest edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from seclog.llm import repair

DDL = "conv_id long, turn long, role string, text string, phase int, alive boolean, said string, copy int"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, False, "x", 3) for r in rows], DDL).repartition(3)


def slow_edits(rows):
    """(cost, audit, letters) of rows (initial, must go, truncated), by trying all edits."""

    @cache
    def best(i, q, made):
        # at most two made-up turns in a row can pay
        found = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

        def add(cost, letter, i, q, made, out):
            rest = best(i, q, made)
            if rest:
                found.append((cost + rest[0], letter + rest[1], (out, *rest[2]) if out else rest[2]))

        if made < 2:
            for x in "ua":
                if (q, x) in step:
                    add(2, "I", i, step[q, x], made + 1, ("I", x))
        if i < len(rows):
            initial, gone, cut = rows[i]
            add(3, "D", i + 1, q, 0, None)
            if not gone:
                if (q, initial) in step:
                    add(cut, "K", i + 1, step[q, initial], 0, ("K", i))
                for x in "ua":
                    if (q, x) in step:
                        add(2 + cut, "R", i + 1, step[q, x], 0, ("R", i, x))
        return min(found, default=None)

    for i in range(len(rows), 0, -1):
        for q in range(4):
            best(i, q, 0)
    return best(0, 0, 0)


def slow(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c]
        shown = [" " if x is None else str(x) for x in (c, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            convs[c] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for c, told in convs.items():
        told.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        counts, seen, marks = [0, 0, 0], set(), []
        for _, role, text in told:
            letters = WORD.findall(text)
            faults = not letters, (role, text) in seen, bool(letters) and letters[-1] not in ".!?"
            seen.add((role, text))
            if True in faults:
                counts[faults.index(True)] += 1
            marks.append((role[:1], faults[0] or faults[1], int(faults[2])))
        turns = {t for t, *_ in told if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:], strict=False))
        cost, audit, edits = slow_edits(tuple(marks))
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names[e[1]]}:" if e[0] == "I" else f"{told[e[1]][1] if e[0] == 'K' else names[e[2]]}:{told[e[1]][2]}" for e in edits]
        out.append((c, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def talk(seed, n):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes.", "Who?", "no", "no ", " \n", "", None, "中文。", "Ha!\t\n", "a.b", "x" * rng.randint(1, 99) + "."])
    rows = []
    for c in range(n):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "tool", "User", "", None, "system"]])
        for t in range(rng.randint(0, 9)):
            rows.append((c, rng.choice([t, t, t, t // 2, None, t + 5]), roles[t % len(roles)] if rng.random() < 0.8 else rng.choice(roles), text()))
    return rows


def test_conversations_are_repaired_at_least_cost(spark):
    rows = talk(1, 250)
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"Turn {t // 5}.") for t in range(300)] + [(None, t, "user", "Nobody's.") for t in range(4)]
    rows += [(901, 1, "user", "long " * 50_000)] + [(902, 7, "user", "Same.")] * 5 + [(903, None, "assistant", "Late.")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Dropped."))
    got = sorted((tuple(r) for r in repair.repairs(repair.damaged(table(spark, rows))).collect()), key=str)
    assert got == sorted(slow(rows), key=str)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got


def test_repaired_turns_are_what_the_digest_is_of(spark):
    rows = talk(2, 120)
    marked = repair.as_given(table(spark, rows))
    lines = defaultdict(list)
    for r in sorted(repair.repaired_turns(marked).collect()):
        lines[r.conv_id].append(r)
    summaries = {r.conv_id: r for r in repair.repairs(marked).collect()}
    assert summaries.keys() >= lines.keys()
    for c, s in summaries.items():
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in lines[c]).encode()).hexdigest() == s.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in lines[c])) and [x.position for x in lines[c]] == list(range(len(lines[c])))
        assert "".join(x.edit for x in lines[c]) == s.audit.replace("D", "")


@pytest.mark.parametrize("letters", ["sua-", "suaxSUAX-", "uA-", "aS"])
def test_both_searches_meet_in_the_cheapest_least_audit(letters):
    rng = random.Random(letters)
    for _ in range(1500):
        marks = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        rows = tuple((m.lower(), m == "-", int(m.isupper())) for m in marks)
        assert repair.cheapest_edits(marks) == slow_edits(rows)[:2]


def test_long_conversations_stay_linear():
    cost, audit = repair.cheapest_edits("uaUAx-ss" * 5000)
    assert len(audit) >= 40_000 and cost > 0


def test_no_conversations(spark):
    assert repair.repairs(repair.damaged(table(spark, []))).collect() == [] == repair.repaired_turns(repair.as_given(table(spark, []))).collect()
