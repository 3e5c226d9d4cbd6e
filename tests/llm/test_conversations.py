"""Conversation repair against all edit strings, against one pass over whole conversations, and on odd rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from netlens.llm import conversations as cv

TURNS = "conv_id long, turn long, role string, text string, none boolean, conv string, uid long, fault string, kind long"
BLANK = "\x20\t\n\x0b\x0c\r"


def turns(spark, rows):
    """Rows (conv_id, turn, role, text) with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, True, "c", 1, "f", 2) for r in rows], TURNS)


def first_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(BLANK)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows):
    """(cost, audit, lines) by trying all edits, with up to two turns put in at a place."""
    fault = first_faults(rows)
    inserts = ["", "u", "a", "ua", "au"]
    best = None
    for put in itertools.product(inserts, repeat=len(rows) + 1):
        for ops in itertools.product("DKua", repeat=len(rows)):
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                cost += 3 * len(put[k])
                audit += "I" * len(put[k])
                lines += [({"u": "user", "a": "assistant"}[c], "") for c in put[k]]
                if k == len(rows):
                    break
                if ops[k] == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                if fault[k] in ("blank", "duplicate"):
                    break
                cost += 3 * (fault[k] == "truncated") + 3 * (ops[k] != "K")
                audit += "K" if ops[k] == "K" else "R"
                lines.append(({"K": rows[k][2], "u": "user", "a": "assistant"}[ops[k]], rows[k][3]))
            else:
                k = -1
            if k not in (-1, len(rows)) or (best and (cost, audit) >= best[:2]):
                continue
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in lines)):
                best = (cost, audit, lines)
    return best


def whole(rows):
    """(cost, audit, lines) by one pass with strings."""
    at = {"": (0, "", ())}
    order = {"": "u", "s": "u", "u": "a", "a": "u"}

    def put(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way

    def grow(at):
        for _ in range(4):
            for s, (c, a, ls) in list(at.items()):
                n = order[s]
                put(at, n, (c + 3, a + "I", (*ls, ({"u": "user", "a": "assistant"}[n], ""))))

    for (_, _, role, text), fault in zip(rows, first_faults(rows)):
        grow(at)
        new = {}
        for s, (c, a, ls) in at.items():
            put(new, s, (c + 4, a + "D", ls))
            if fault in ("blank", "duplicate"):
                continue
            more, n = c + 3 * (fault == "truncated"), order[s]
            put(new, n, (more + 3, a + "R", (*ls, ({"u": "user", "a": "assistant"}[n], text))))
            if role[:1] == n or (role[:1] == "s" and s == ""):
                put(new, role[:1], (more, a + "K", (*ls, (role, text))))
        at = new
    grow(at)
    return min(at[s] for s in ("", "a") if s in at)


def expected(conv, rows, edits):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:16], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    fault, numbers = first_faults(rows), [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = edits(rows)
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (conv, gaps, *[fault.count(k) for k in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def random_rows(rng, conv, n):
    roles, texts = ["system", "user", "assistant", "tool", "", " "], ["One.", "two!", "three?  ", "cut off", "", " \t", "ünd", "One."]
    return [(conv, None if rng.random() < 0.1 else int(t), str(rng.choice(roles, p=[0.15, 0.35, 0.35, 0.05, 0.05, 0.05])), str(rng.choice(texts, p=[0.3, 0.15, 0.15, 0.1, 0.1, 0.05, 0.05, 0.1]))) for t in sorted(rng.integers(0, n + 2, n))]


def test_edits_match_all_edit_strings(spark):
    rng = np.random.default_rng(5)
    convs = {c: random_rows(rng, c, int(rng.integers(1, 4))) for c in range(40)}
    got = {r.conv_id: tuple(r) for r in cv.repair(turns(spark, [r for rows in convs.values() for r in rows])).collect()}
    for c, rows in convs.items():
        assert got[c] == expected(c, rows, every_edit)


@pytest.mark.parametrize("most, per_task", [(256, 50_000), (3, 20)])
def test_long_conversations_match_one_pass(spark, most, per_task):
    rng = np.random.default_rng(6)
    convs = {c: [(*r[:3], r[3] and f"{r[3][:1]}{i}{r[3]}") if rng.random() < 0.8 else r for i, r in enumerate(random_rows(rng, c, n))] for c, n in enumerate([1, 5, 40, 150, 7, 60, 2])}
    convs[99] = [(99, t, "assistant", f"x{t}.") for t in range(60)]
    convs[98] = [(98, t, "user", " ") for t in range(30)]
    rows = [r for x in convs.values() for r in x]
    got = {r.conv_id: tuple(r) for r in cv.repair(turns(spark, rows), most=most, per_task=per_task).collect()}
    for c, x in convs.items():
        assert got[c] == expected(c, x, whole)
    left = cv.repaired_turns(turns(spark, rows), most=most, per_task=per_task).collect()
    for c in convs:
        lines = [f"{r.role}:{r.text}" for r in sorted((r for r in left if r.conv_id == c), key=lambda r: r.place)]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == got[c][8]


def test_equal_hashes_are_told_apart():
    rng = np.random.default_rng(7)
    edits = cv.Edits(base=1, prime=3)  # nearly all strings collide
    nodes = [0]
    for _ in range(300):
        nodes.append(edits.add(nodes[int(rng.integers(0, len(nodes)))], str(rng.choice(list("DIKR")))))
    text = {v: edits.text(v) for v in nodes}
    for a, b in rng.choice(nodes, (3000, 2)):
        assert edits.less(int(a), int(b)) == (text[int(a)] < text[int(b)])


def test_damage_and_every_original_conversation(spark):
    rng = np.random.default_rng(8)
    rows = [r for c in range(150) for r in random_rows(rng, c, int(rng.integers(1, 7)))] + [(None, 1, "user", None), (None, None, None, "x."), (500, 3, None, None)]
    hurt = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        hurt.setdefault(c, [])
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            hurt[c] += [row] * (1 + (k == 3))
    assert any(not x for x in hurt.values())
    got = cv.repaired_after_damage(turns(spark, rows)).collect()
    assert len(got) == len(hurt)
    for r in got:
        none = (r.conv_id, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
        assert tuple(r) == (expected(r.conv_id, hurt[r.conv_id], whole) if hurt[r.conv_id] else none)


def test_odd_rows_and_empty_tables(spark):
    rows = [(None, None, None, None), (None, None, "user", "a."), (1, 1, "user", "x" * 300_000 + "."), (1, 1, "user", "x" * 300_000 + "."), (2, None, "assistant", "y.")]
    d = turns(spark, rows)
    clean = {c: [(a, b, " " if r is None else r, " " if t is None else t) for a, b, r, t in rows if a == c] for c in (None, 1, 2)}
    out = cv.repair(d)
    assert {r.conv_id: tuple(r) for r in out.collect()} == {c: expected(c, x, whole) for c, x in clean.items()}
    empty = cv.repair(d.where("conv_id = 99"))
    assert empty.collect() == [] and empty.schema == out.schema
    assert cv.repaired_after_damage(d.where("conv_id = 99")).collect() == []
