"""Packing in many small groups ends and loses nothing; the placement rule against a bin-by-bin restatement."""

import numpy as np
import public_tokenizers

from netlens.llm.packing import pack, sum_of_squares


def by_the_rule(sizes, capacity):
    """Sum of squares tried out bin by bin: every open gap and a new bin, the smallest gap of equal ones."""
    bins, where = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        gaps = {}
        for b, used in enumerate(bins):
            gaps.setdefault(capacity - used, []).append(b)

        def total(gap, new):
            count = {g: len(x) for g, x in gaps.items() if g > 0}
            if not new:
                count[gap] -= 1
            if gap - sizes[i] > 0:
                count[gap - sizes[i]] = count.get(gap - sizes[i], 0) + 1
            return sum(c * c for c in count.values())

        options = [(total(g, False), 0, g) for g in gaps if g >= sizes[i]] + [(total(capacity, True), 1, capacity)]
        _, new, gap = min(options)
        b = len(bins) if new else gaps[gap][-1]
        if new:
            bins.append(0)
        where[i] = (b, bins[b])
        bins[b] += sizes[i]
    return where, bins


def test_placement_follows_the_rule():
    rng = np.random.default_rng(1)
    for capacity, n in ((20, 60), (50, 120), (7, 40)):
        sizes = rng.integers(1, capacity + 1, n)
        bins, offsets = sum_of_squares(sizes, capacity)
        _, want = by_the_rule(sizes.tolist(), capacity)
        used = np.zeros(bins.max() + 1, int)
        np.add.at(used, bins, sizes)
        assert sorted(used.tolist()) == sorted(want)
        spans = sorted(zip(bins.tolist(), offsets.tolist(), sizes.tolist()))
        assert all(a[0] != b[0] and b[1] == 0 or a[0] == b[0] and a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:]))


def test_small_groups_end_and_lose_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["the"] * int(rng.integers(1, 100)))) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack(d, public_tokenizers.path("word_bpe_49k.json"), capacity=100, group=8).collect()
    assert {(r.doc_id, r.length) for r in got} == {(i, t.count("the") + 1) for i, t in rows}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 100
    total = sum(r.length for r in got)
    assert len(by) <= 1.3 * total / 100  # groups of eight leave little choice
