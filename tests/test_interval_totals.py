"""Sums over intervals come from running sums read at their ends, not from joined pairs; checked against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from netlens.operators import quality as Q
from netlens.operators.core import interval_totals, point_in_interval


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("lo_open", [False, True])
@pytest.mark.parametrize("hi_open", [False, True])
def test_interval_totals_equal_the_joined_pairs(spark, lo_open, hi_open):
    r = random.Random(3)
    some = lambda n: None if r.random() < 0.05 else r.randrange(n)
    points = spark.createDataFrame([(some(3), some(60), some(5)) for _ in range(150)], "k int, t long, v long")
    spans = [(some(3), some(8), a := some(60), None if a is None else a + r.randrange(-2, 25)) for _ in range(60)]
    spans = spark.createDataFrame(spans + spans[:10], "k int, id int, a long, b long")
    got = interval_totals(points, spans, ["k"], "t", "a", "b", ["id", "k"], {"s": F.col("v"), "odd": (F.col("v") % 2).cast("long")}, 16, lo_open, hi_open, last="z")
    pairs = point_in_interval(points, spans, ["k"], "t", "a", "b", "inner", 16, lo_open, hi_open)
    want = pairs.groupBy("id", "k").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("s"), F.coalesce(F.sum(F.col("v") % 2), F.lit(0)).alias("odd"), F.max("t").alias("z"))
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def _samples(r, n):
    return [(f"c{r.randrange(2)}", i, r.randrange(80) * 10, None if r.random() < 0.3 else r.choice([1, 1, 1, 2]), None if r.random() < 0.03 else i // 3 * 3, i // 40) for i in range(n)]


def test_reading_coverage_matches_its_rule_without_pairs(spark):
    r = random.Random(5)
    rows = _samples(r, 120)
    periods = [(i, f"c{r.randrange(2)}", a := r.randrange(800), a + r.randrange(5, 120)) for i in range(80)]
    schema = "component string, sample_id long, ts_us long, pid int, packets long, drops long"
    got = Q.reading_coverage(spark.createDataFrame(rows, schema), spark.createDataFrame(periods, "period_id long, component string, t0_us long, t1_us long"), 30, 100)
    assert "_cell" not in _plan(got)
    found = {x.period_id: (list(x.reasons), x.kernel_drops) for x in got.collect()}
    seen = set()
    for pid, comp, t0, t1 in periods:
        mine = sorted((x for x in rows if x[0] == comp), key=lambda x: (x[2], x[1]))
        a, b = max((x[2] for x in mine if x[2] <= t0), default=None), min((x[2] for x in mine if x[2] >= t1), default=None)
        why, dd = [], None
        if a is None or b is None:
            why = ["not bounded"]
        if a is not None and t0 - a > 30:
            why.append("start bound too old")
        if b is not None and b - t1 > 30:
            why.append("end bound too late")
        if a is not None and b is not None:
            inside = [x for x in mine if a <= x[2] <= b]
            steps = list(zip(inside, inside[1:]))
            pids = {x[3] for x in inside} - {None}
            less = lambda u, v: u is not None and v is not None and u < v
            invalid = any(x[4] is None or x[5] is None for x in inside)
            falls = any(less(y[4], x[4]) or less(y[5], x[5]) for x, y in steps)
            why += ["several pids"] * (len(pids) > 1) + ["gap between readings"] * any(y[2] - x[2] > 30 for x, y in steps) + ["invalid counters"] * invalid
            why += ["counter decreases"] * (not invalid and len(pids) == 1 and falls)
            dd = inside[-1][5] - inside[0][5]
        assert found[pid] == (why, dd if not why else None), pid
        seen |= set(why) or {"ok"}
    assert {"ok", "several pids", "gap between readings", "invalid counters"} <= seen


def test_measured_and_classified_periods_hold_no_pairs(spark):
    rows = [("c0", i, i * 10, 1, i * 10 / 1e6, i, i // 50) for i in range(100)]
    samples = spark.createDataFrame(rows, "component string, sample_id long, ts_us long, pid int, uptime_s double, packets long, drops long")
    periods = spark.createDataFrame([(i, "c0", i * 7, i * 7 + 300) for i in range(60)], "period_id long, component string, t0_us long, t1_us long")
    m = Q.measure_drops(samples, periods, 990, 20, 20, 5.0, 128)
    c = Q.classify_period(m, Q.reading_coverage(samples, periods, 20, 128), Q.increments(samples, 128), 20, 128)
    assert "_cell" not in _plan(m) and "_cell" not in _plan(c)
    for x in m.collect():
        a, b = x.t0_us // 10, -(-x.t1_us // 10)
        dd = b // 50 - a // 50
        assert (x.state, x.packets, x.drops, x.partial_drops) == ("descartes" if dd else "cero_explicito", b - a, dd, dd)
    assert {x.period_class for x in c.collect()} == {"C0", "C2"}
