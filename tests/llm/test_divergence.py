"""Source divergence against brute force, with and without colliding digests, and on odd rows."""

import re
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from netlens.llm.divergence import source_divergence

DOCS = "doc_id long, text string, lang string, source string, gid long, tid long, n long, value string, digest string"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, 1, 2, 3, "v", "d") for r in rows], DOCS)


def brute(rows, top=200):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for _, text, lang, source in rows]
    out = set()
    for lang in {t[0] for t in terms}:
        docs_of = Counter(w for x, _, ws in terms if x == lang for w in set(ws))
        kept = [w for w, k in docs_of.items() if k >= 3]
        counts = {s: Counter() for x, s, _ in terms if x == lang}
        for x, s, ws in terms:
            if x == lang:
                counts[s].update(w for w in ws if docs_of[w] >= 3)
        whole = sum(counts.values(), Counter())
        rate = lambda c: {w: 1 + floor(Fraction(10**9 * (c[w] + 1), sum(c.values()) + len(kept))) for w in kept}
        p, q = {s: rate(c) for s, c in counts.items()}, rate(whole)
        apart = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            part = {"pair": [(-sum(apart(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s]}
            part["term"] = [(-apart(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for k, rank in part.items():
                out |= {(lang, s, k, item, -v, i) for i, (v, _, item) in enumerate(sorted(rank), 1) if k == "pair" or i <= top}
    return out


def rows_of(n, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = ["alpha", "Beta", "gamma", "être", "z", "ñu", "中文", "mid-dle", "x1y"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    return [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 40))), ["en", "de", None][i % 3], [None, "a", "b", "c", "d"][int(rng.integers(0, 5) * rng.random())]) for i in range(n)]


@pytest.mark.parametrize("bits", [64, 5])
def test_divergence_matches_brute_force(spark, bits):
    rows = rows_of(120) + [(500 + i, "same words only", "xx", "one") for i in range(4)] + [(600, None, "en", "empty"), (601, "", "en", "empty2")]
    got = source_divergence(docs(spark, rows), top=20, bits=bits).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows, 20)


def test_many_ties_keep_the_least_items(spark):
    rows = [(i, " ".join(f"t{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)), "en", "a") for i in range(3)] + [(9 + i, "other words", "en", "b") for i in range(3)]
    got = source_divergence(docs(spark, rows)).where("part = 'term'").collect()
    assert {tuple(r) for r in got} == {r for r in brute(rows) if r[2] == "term"} and sum(r.source == "a" for r in got) == 200


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, None, None), (None, "aa bb cc", "en", "s"), (2, "aa bb cc", "en", "s"), (2, "aa bb cc", "en", "s"), (3, "x" * 200_000, "en", "t"), (4, "aa " * 50_000, "en", "t")]
    d = docs(spark, rows)
    out = source_divergence(d)
    assert {tuple(r) for r in out.collect()} == brute(rows)
    empty = source_divergence(d.where("doc_id = 99"))
    assert empty.collect() == [] and empty.schema == out.schema
