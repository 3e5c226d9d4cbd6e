"""Building blocks against plain Python on small random tables, with slices cut fine."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from netlens.operators import core


def rows(n=400, keys=3, seed=1, span=2000):
    rnd = random.Random(seed)
    # Key k0 holds most of the rows: slices must not change anything for it.
    return sorted((("k0" if rnd.random() < 0.6 else f"k{rnd.randrange(keys)}"), rnd.randrange(span), i, rnd.randrange(5)) for i in range(n))


def frame(spark, data):
    return spark.createDataFrame(data, "key string, ts_us long, arrival long, v long")


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def test_scan_and_previous_cross_slices(spark):
    data = rows()
    df = frame(spark, data)
    got = {r["arrival"]: r for r in core.scan(df, ["key"], ["ts_us", "arrival"], "ts_us", 100, {
        "run": ("sum", F.col("v"), True), "low": ("min", F.col("v"), False), "big": ("last", F.when(F.col("v") > 3, F.col("arrival")), True)}).collect()}
    prev = {r["arrival"]: r["p"] for r in core.previous(df, ["key"], ["ts_us", "arrival"], {"arrival": "p"}, "ts_us", 100).collect()}
    nxt = {r["arrival"]: r["p"] for r in core.following(df, ["key"], ["ts_us", "arrival"], {"arrival": "p"}, "ts_us", 100).collect()}
    for items in by_key(data).values():
        total, low, big = 0, None, None
        for i, r in enumerate(items):
            g = got[r[2]]
            assert g["low"] == low
            total += r[3]
            low = r[3] if low is None else min(low, r[3])
            big = r[2] if r[3] > 3 else big
            assert (g["run"], g["big"]) == (total, big)
            assert prev[r[2]] == (items[i - 1][2] if i else None)
            assert nxt[r[2]] == (items[i + 1][2] if i + 1 < len(items) else None)


def test_near_previous_and_islands(spark):
    data = rows(seed=2)
    df = frame(spark, data)
    got = {r["arrival"]: r["p"] for r in core.near_previous(df, ["key"], ["ts_us", "arrival"], {"arrival": "p"}, "ts_us", 15, 40).collect()}
    isl = {r["arrival"]: r["island"] for r in core.islands(df, ["key"], ["ts_us", "arrival"], "ts_us", 15, 40).collect()}
    for items in by_key(data).values():
        n = 0
        for i, r in enumerate(items):
            near = i and r[1] - items[i - 1][1] <= 15
            n += not near
            assert got[r[2]] == (items[i - 1][2] if near else None)
            assert isl[r[2]] == n


def fold(items, gap, inclusive, ttl):
    state, dropped = None, []
    for r in items:
        if state is not None and ((r[1] - state[1] <= gap) if inclusive else (r[1] - state[1] < gap)):
            if not ttl:
                dropped.append(r[2])
                continue
            if abs(r[3] - state[3]) <= 1:
                if r[3] > state[3]:
                    dropped.append(state[2])
                    state = r
                else:
                    dropped.append(r[2])
                continue
        state = r
    return dropped


def test_retained_fold_is_the_sequential_rule(spark):
    for seed, ttl, inclusive in ((3, False, False), (4, True, True)):
        data = rows(600, 2, seed, 3000)
        want = {d for items in by_key(data).values() for d in fold(items, 12, inclusive, ttl)}
        df = frame(spark, data)
        gone = core.retained_fold(df, ["key"], ["ts_us", "arrival"], "ts_us", 12, inclusive, "v" if ttl else None, slice_us=30)
        assert {int(r["fold_id"].split("#")[1]) for r in gone.collect()} == want


def test_retained_fold_cuts_dense_histories(spark, monkeypatch):
    monkeypatch.setattr(core, "FOLD_ROWS", 20)
    for seed, ttl in ((5, False), (6, True)):
        data = rows(500, 2, seed, 400)
        want = {d for items in by_key(data).values() for d in fold(items, 12, False, ttl)}
        gone = core.retained_fold(frame(spark, data), ["key"], ["ts_us", "arrival"], "ts_us", 12, False, "v" if ttl else None)
        assert {int(r["fold_id"].split("#")[1]) for r in gone.collect()} == want


def test_what_follows_a_retained_row_is_found_by_search():
    rnd = random.Random(2)
    t = np.sort(np.array([rnd.randrange(90) for _ in range(200)]))
    v = np.array([rnd.choice([62, 63, 63, 64]) for _ in t])
    for inclusive in (False, True):
        for values in (None, v):
            after = core._successors(t, values, 7, inclusive)
            for i in range(len(t)):
                near = lambda j: t[j] - t[i] <= 7 if inclusive else t[j] - t[i] < 7
                stays = lambda j: near(j) and (values is None or v[j] in (v[i], v[i] - 1))
                assert after[i] == next((j for j in range(i + 1, len(t)) if not stays(j)), len(t))
            end = core._last_states(after)
            for i in range(len(t)):
                at = i
                while after[at] < len(t):
                    at = after[at]
                assert end[i] == at


def test_point_in_interval_and_asof(spark):
    data = rows(200, seed=5)
    spans = [(k, a, a + w) for k, a, w in (("k0", 10, 300), ("k0", 250, 0), ("k1", 0, 1999), ("k2", 700, 90))]
    iv = spark.createDataFrame(spans, "key string, lo long, hi long")
    got = core.point_in_interval(frame(spark, data), iv, ["key"], "ts_us", "lo", "hi", "inner", 64)
    want = sorted((r[2], lo) for r in data for k, lo, hi in spans if k == r[0] and lo <= r[1] <= hi)
    assert sorted((r["arrival"], r["lo"]) for r in got.collect()) == want
    right = rows(80, seed=6)
    for forward in (False, True):
        out = core.asof(frame(spark, data), frame(spark, right).select("key", F.col("ts_us").alias("rt")), ["key"], "ts_us", "rt", {"rt": "hit"}, 50, forward)
        for r in out.collect():
            c = [x[1] for x in right if x[0] == r["key"] and ((x[1] >= r["ts_us"]) if forward else (x[1] <= r["ts_us"]))]
            assert r["hit"] == ((min(c) if forward else max(c)) if c else None)


def test_quantile_conventions(spark):
    rnd = random.Random(7)
    values = [rnd.choice([0.0, 0.0, rnd.random()]) for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    s = sorted(values)
    got = core.quantiles(df, [], "v", {"a": (0.05, "linear"), "b": (0.99, "trunc"), "c": (0.9, "round"), "d": (0.5, "half"), "e": (0.95, "share"), "f": (0.03, "count")}, buckets=8).first()
    assert math.isclose(got["a"], float(np.quantile(values, 0.05)), abs_tol=1e-12)
    n = len(s)
    assert got["b"] == s[int(0.99 * (n - 1))] and got["c"] == s[round(0.9 * (n - 1))] and got["d"] == s[n // 2]
    assert got["e"] == s[int(0.95 * n) - 1] and got["f"] == s[math.floor(0.03 * n)]


def test_repeats_of_one_key_leave_other_keys_alone(spark):
    from netlens.operators.core import drop_repeats

    rows = spark.createDataFrame([("A", 0, 0), ("A", 10, 1), ("B", 10, 1)], "k string, ts_us long, arrival long")
    kept = drop_repeats(rows, ["k"], ["ts_us", "arrival"], "ts_us", 100)
    assert sorted(map(tuple, kept.collect())) == [("A", 0, 0), ("B", 10, 1)]


def test_every_tree_has_its_sample_under_uneven_weights(spark):
    from pyspark.sql import functions as F

    from netlens.operators.detect import fit_iforest

    rows = spark.range(2000).select("id", F.rand(1).alias("x"), F.when(F.col("id") == 0, 1e7).otherwise(1.0).alias("w"))
    model = fit_iforest(rows, "id", {"c": ["x"]}, trees=6, sample=128, weight="w")
    assert {r["size"] for r in model.where("node = 0").collect()} == {128} and model.select("tree").distinct().count() == 6


def test_exact_tests_converge_for_large_counts(spark):
    import numpy as np

    from netlens.operators.stats import _beta_cdf

    assert abs(_beta_cdf(np.array([5e6]), np.array([5e6]), np.array([0.5]))[0] - 0.5) < 1e-5
