"""Phrases found by the positional index against brute force, side by side and in reach, and on odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from netlens.llm import decontamination as dc

DOCS = "doc_id long, text string, shard long, word string, n long, first long, item string, places string"


def docs(spark, rows):
    """Rows (doc_id, text) with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 1, "w", 2, 3, "i", "p") for r in rows], DOCS)


def bench(spark, rows):
    return spark.createDataFrame([(*r, "w", 4) for r in rows], "item_id long, text string, words string, phrase long")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def passages(items, size):
    return {(i, tuple(w[k : k + size])) for i, t in items for w in [words(t)] if w for k in range(max(len(w) - size, 0) + 1)}


def brute(rows, items, size):
    out = []
    for doc_id, text in rows:
        w, hit, named = words(text), set(), set()
        for i, p in passages(items, size):
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    named |= {str(i)} - {"None"}
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed, n=80):
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "a", "of", "and", "été", "42", "x-y", "中", *(f"r{i}" for i in range(60))]
    odds = np.array([30, 20, 10, 10, 3, 3, 3, 3, *[1] * 60]) / 142
    text = lambda k: "".join(w + str(rng.choice([" ", ", ", ".\n"])) for w in rng.choice(vocabulary, k, p=odds))
    items = [(i, text(rng.integers(1, 30))) for i in range(25)] + [(100, "of"), (101, ""), (102, None), (103, "nothing like it"), (7, "a of a"), (None, "of the of")]
    rows = []
    for i in range(n):
        t = text(rng.integers(0, 60))
        if i % 4 == 0:
            t += " " + str(items[i % 25][1]).upper() + " " + text(5)
        rows.append((i, t))
    return rows, items


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_phrases_match_brute_force(spark, most):
    rows, items = corpus(1)
    index = dc.stash(dc.positional_index(docs(spark, rows), most=most))
    found = dc.find_phrases(index, dc.windows(bench(spark, items), size=6))
    assert sorted(map(tuple, dc.digest(found).collect()), key=str) == brute(rows, items, 6)


def test_spans_are_the_occurrences(spark):
    rows, items = corpus(2, 30)
    for r in dc.contaminated(docs(spark, rows), bench(spark, items), size=4).collect():
        w = words(dict(rows)[r.doc_id])
        want = {(k, k + len(p), str(i)) for i, p in passages(items, 4) for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p}
        assert {(s.first, s.end, str(s.item)) for s in r.spans} == want and len(r.spans) == len(want)


def test_words_in_reach_match_brute_force(spark):
    rows, items = corpus(3, 40)
    got = dc.contaminated(docs(spark, rows), bench(spark, items), size=5, slop=3).collect()
    for r in got:
        w = words(dict(rows)[r.doc_id])
        want = set()
        for i, p in passages(items, 5):
            need = Counter(p)
            holds = lambda a, b: not need - Counter(w[a:b])
            want |= {(a, b, str(i)) for a in range(len(w)) for b in range(a + len(p), min(len(w), a + len(p) + 3) + 1) if holds(a, b) and not holds(a + 1, b) and not holds(a, b - 1)}
        assert {(s.first, s.end, str(s.item)) for s in r.spans} == want


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, " .\n"), (None, "one two three"), (4, "one two three"), (4, "one two three"), (5, "w " * 40_000 + "one two three"), (6, "x" * 100_000)]
    items = [(1, "One, two three"), (1, "one two three"), (2, None), (None, "w w")]
    d, b = docs(spark, rows), bench(spark, items)
    for size in (3, 10):
        out = dc.digest(dc.contaminated(d, b, size))
        assert sorted(map(tuple, out.collect()), key=str) == brute(rows, items, size)
    assert {r.n_hit for r in dc.contaminated(d, b.where("item_id = 99")).collect()} == {0}
    empty = dc.digest(dc.contaminated(d.where("doc_id = 99"), b))
    assert empty.collect() == [] and empty.schema == out.schema
