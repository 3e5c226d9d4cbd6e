"""State machines, scans, thresholds and statistics against small hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netlens.operators import actions as A, dataset as B, detect as M, episodes as E, learn as L, quality as Q, scan as N, stats as X

SEC = 1_000_000


def test_escalation_ladder(spark):
    t0 = 1_700_000_000
    times = [(0, "LIMIT"), (10, "BLOCK"), (100, "BLOCK"), (400, "BLOCK"), (2000, "BLOCK"), (2000 + 90_000, "BLOCK")]
    df = spark.createDataFrame([("10.0.0.1", "srv-dmz", a, f"e{i}", (t0 + t) * SEC) for i, (t, a) in enumerate(times)], "entity_ip string, target string, action string, event_id string, t_us long")
    got = [(r["level"], r["timeout_s"], r["review"]) for r in A.ladder(df).orderBy("t_us").collect()]
    assert got == [(0, 300, False), (1, 300, False), (1, 300, False), (2, 1800, False), (3, 3600, True), (1, 300, False)]


def test_actions_new_kept_renewed_escalated(spark):
    t = 1_700_000_000
    ev = [(0, "LIMIT", -60, 0), (100, "LIMIT", -30, 90), (200, "LIMIT", 10, 190), (250, "BLOCK", 190, 250), (260, "LIMIT", 255, 260), (9000, "LIMIT", 8990, 9000)]
    df = spark.createDataFrame([("10.0.0.1", "dc1", "dns", "r", a, f"e{i}", (t + s) * SEC, (t + f) * SEC, (t + u) * SEC) for i, (s, a, f, u) in enumerate(ev)],
                               "entity_ip string, target string, scope string, rule string, action string, event_id string, t_us long, from_us long, to_us long")
    out = A.apply_actions(df.unionByName(df)).orderBy("t_us").collect()
    assert [r["state"] for r in out] == ["nueva", "mantenida", "renovada", "escalada", "mantenida", "nueva"]
    assert out[2]["until_us"] == (t + 500) * SEC and out[4]["in_force"] == "BLOCK"


def test_ten_unanswered_syns_fire_at_the_last_plus_grace(spark):
    rows = [(100 * SEC + i * 500, i, "10.10.0.9", "10.10.30.10", 40000 + i, 20 + i, 2, 7 + i, 60) for i in range(10)]
    tcp = spark.createDataFrame(rows, "ts_us long, arrival long, src_ip string, dst_ip string, src_port int, dst_port int, tcp_flags int, tcp_seq long, ip_length int")
    a = N.syn_attempts(tcp, "10.10.0.0/16")
    got = N.scan_triggers(a, k=10).collect()
    assert [(r["trigger_us"], r["failed_ports"]) for r in got] == [(100 * SEC + 9 * 500 + 100_000, 10)]
    answered = tcp.unionByName(tcp.selectExpr("ts_us + 200 as ts_us", "arrival + 100 as arrival", "dst_ip as src_ip", "src_ip as dst_ip", "dst_port as src_port", "src_port as dst_port", "18 as tcp_flags", "tcp_seq", "ip_length"))
    assert N.scan_triggers(N.syn_attempts(answered, "10.10.0.0/16"), k=2).count() == 0


def test_six_hour_blocks_give_sixty_guard_rows(spark):
    rows = [(f"10.0.0.{e}", s * SEC, e * 10_000 + s) for e in (1, 2) for s in range(0, 6 * 3600, 10)]
    df = spark.createDataFrame(rows, "entity_ip string, ts_us long, row_id long")
    p = B.partition_blocks(df, "ts_us", 3600 * SEC, 60 * SEC)
    assert p.where(F.col("partition") == B.GUARD).count() == 60
    assert B.check_leak(p, "ts_us", 60 * SEC, 3600 * SEC).count() == 0
    assert B.check_leak(B.partition_blocks(df, "ts_us", 3600 * SEC, 0), "ts_us", 60 * SEC, 3600 * SEC).count() > 0


def test_assembly_refuses_bad_maps(spark):
    f = spark.createDataFrame([("e1", True), ("e2", True)], "episode_id string, eligible boolean")
    with pytest.raises(Exception, match="without partition"):
        B.assemble(f, spark.createDataFrame([("e1", "train")], "episode_id string, partition string"), "normal").collect()
    with pytest.raises(Exception, match="two partitions"):
        B.assemble(f, spark.createDataFrame([("e1", "train"), ("e1", "test"), ("e2", "test")], "episode_id string, partition string"), "normal").collect()


def test_psi_recipe(spark):
    rnd = random.Random(1)
    ref = [rnd.gauss(0, 1) for _ in range(500)]
    new = [rnd.gauss(0.8, 1) for _ in range(400)]
    q = lambda v, p: (lambda s, x: s[int(x)] + (s[min(int(x) + 1, len(s) - 1)] - s[int(x)]) * (x - int(x)))(sorted(v), (len(v) - 1) * p)
    cuts = sorted({q(ref, i / 10) for i in range(1, 10)})
    share = lambda v: [max(1e-4, sum(sum(c < x for c in cuts) == b for x in v) / len(v)) for b in range(len(cuts) + 1)]
    want = sum((b - a) * math.log(b / a) for a, b in zip(share(ref), share(new)))
    df = lambda v: spark.createDataFrame([("x", x) for x in v], "feature string, value double")
    assert L.psi(df(ref), df(new)).first()["psi"] == pytest.approx(want, abs=1e-5)
    assert L.psi(df([0.0] * 50), df([0.0] * 20)).first()["psi"] == 0.0


def test_even_subsample(spark):
    data = [("a", i, i) for i in range(97)] + [("b", i, 200 + i) for i in range(5)]
    df = spark.createDataFrame(data, "entity_ip string, ts_us long, row_id long")
    got = L.even_subsample(df, ["entity_ip"], ["ts_us", "row_id"], "ts_us", F.lit(10), 20).collect()
    assert sorted(r["ts_us"] for r in got if r["entity_ip"] == "a") == [int(i * 9.7) for i in range(10)]
    assert sum(r["entity_ip"] == "b" for r in got) == 5


def test_lineage_detects_tampering(spark):
    log = L.append_lineage(spark.createDataFrame([(i, f"entry {i}", f"l{i}", "d") for i in range(6)], "seq long, body string, lot string, lot_digest string"), "seq", "body", 2)
    dig = spark.createDataFrame([(f"l{i}", "d") for i in range(6)], "lot string, digest string")
    assert L.verify_lineage(log, "seq", "body", dig, 2).count() == 0
    edited = log.withColumn("body", F.when(F.col("seq") == 2, "x").otherwise(F.col("body")))
    assert [(r["seq"], r["problem"]) for r in L.verify_lineage(edited, "seq", "body", dig.where("lot <> 'l5'"), 2).orderBy("seq").collect()] == [(3, "chain broken"), (5, "lot missing")]


def test_forest_is_reproducible_and_finds_the_shifted_rows(spark):
    rnd = random.Random(5)
    rows = [(i, *[rnd.gauss(0, 1) for _ in range(4)]) for i in range(700)] + [(10_000 + i, *[rnd.gauss(6, 1) for _ in range(4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    conf = {"all": ["a", "b", "c", "d"]}
    train = df.where("id < 400")
    m = M.fit_iforest(train, "id", conf, 60, 64, 3)
    assert m.groupBy("tree").agg(F.max("size").alias("n")).where("n <> 64").count() == 0
    s1 = {r["id"]: r["score_all"] for r in M.score_iforest(df, m, conf).collect()}
    m2 = M.fit_iforest(train.repartition(7), "id", conf, 60, 64, 3)
    assert s1 == {r["id"]: r["score_all"] for r in M.score_iforest(df.repartition(3), m2, conf).collect()}
    held = sorted(s1[i] for i in range(400, 700))
    cut = held[int(0.05 * len(held))]
    assert sum(s1[10_000 + i] < cut for i in range(30)) >= 29
    assert all(-1 < s < 0 for s in s1.values())


def test_order_statistic_threshold_with_ties(spark):
    rows = [(i, f"e{i % 4}", v) for i, v in enumerate([0.1, 0.2, 0.2, 0.2, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])]
    r = M.lower_tail(spark.createDataFrame(rows, "row_id long, episode_id string, score double"), [], "score", "episode_id", 0.3).first()
    assert (r["threshold"], r["k"], r["ties"], r["strict_alerts"], r["prefix_episodes"]) == (0.2, 3, 3, 1, 3)


def test_exact_intervals_and_sign_test(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (10, 10), (54, 84)], "k long, n long")
    got = {(r["k"], r["n"]): (r["cp_low"], r["cp_high"]) for r in X.clopper_pearson(df, "k", "n").collect()}
    assert got[0, 10] == pytest.approx((0.0, 0.30850), abs=1e-4)
    assert got[5, 10] == pytest.approx((0.18709, 0.81291), abs=1e-4)
    assert got[10, 10] == pytest.approx((0.69150, 1.0), abs=1e-4)

    def tail(p, n, kk):
        return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(kk, n + 1))
    lo, hi = got[54, 84]
    assert tail(lo, 84, 54) == pytest.approx(0.025, abs=1e-6) and tail(hi, 84, 55) == pytest.approx(0.975, abs=1e-6)
    pairs = spark.createDataFrame([("g", i < 9, i >= 9) for i in range(10)], "g string, a boolean, b boolean")
    assert X.mcnemar(pairs, ["g"]).first()["p"] == pytest.approx(2 * 11 / 1024, abs=1e-9)


def test_ranking_metrics_with_ties(spark):
    rows = [(-3.0, True), (-2.0, False), (-2.0, True), (-1.0, False), (-1.0, False)]
    r = X.ranking_metrics(spark.createDataFrame(rows, "score double, truth boolean"), []).first()
    assert r["roc_auc"] == pytest.approx((1 + 1 + 1 + 0.5 + 1 + 1) / 6)
    assert r["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_token_bucket_envelope_and_simulation_agree(spark):
    rnd = random.Random(8)
    t, ts = 0, []
    for i in range(300):
        t += rnd.choice([1, 200_000, 900_000, 4_000_000])
        ts.append(("a", t, i))
    df = spark.createDataFrame(ts, "src_ip string, ts_us long, arrival long")
    depth = E.token_envelope(df, [1.0], SEC, 3 * SEC).first()["depth"]
    best, low = 0.0, math.inf
    for j, (_, x, _) in enumerate(ts):
        y = (x - ts[0][1]) / SEC
        low = min(low, j - y)
        best = max(best, j + 1 - y - low)
    assert depth == pytest.approx(best, abs=1e-9)
    dropped = {r["depth"]: r["dropped"] for r in E.token_simulate(df, [(1.0, math.ceil(best) + 0.5), (1.0, 3.0)], SEC, 3 * SEC).collect()}
    assert dropped[math.ceil(best) + 0.5] == 0 and dropped[3.0] > 0


def test_not_measured_is_not_a_miss(spark):
    rows = [(1, "f", False, "model", True, 4.0), (2, "f", False, "model", True, None), (3, "f", False, "model", False, None)]
    df = spark.createDataFrame(rows, "episode_id int, family string, with_signature boolean, condition string, measured boolean, latency_s double")
    r = E.compare_conditions(df).where("group = 'family:f'").first()
    assert (r["n"], r["detected"], r["not_measured"], r["latency_median_s"]) == (2, 1, 1, 4.0)


def test_published_episode_counts(spark):
    """Golden counts: 0, 6, 7 and 9 of nine no-signature episodes; combined 13.0 / 4.0 / 23.0 s."""
    lat = {"ids": [], "model": [5, 9, 13, 18, 20, 22], "rules": [4, 6, 12, 14, 15, 21, 23], "combined": [4, 6, 9, 12, 13, 14, 18, 21, 23]}
    rows = [(e, "f", False, c, True, float(v[e]) if e < len(v) else None) for c, v in lat.items() for e in range(9)]
    df = spark.createDataFrame(rows, "episode_id int, family string, with_signature boolean, condition string, measured boolean, latency_s double")
    got = {r["condition"]: r for r in E.compare_conditions(df).where("group = 'without_signature'").collect()}
    assert [(got[c]["detected"], got[c]["n"]) for c in lat] == [(0, 9), (6, 9), (7, 9), (9, 9)]
    c = got["combined"]
    assert (c["latency_median_s"], c["latency_min_s"], c["latency_max_s"]) == (13.0, 4.0, 23.0)


def test_missing_counters_are_absent_not_zero(spark):
    def sample(i, drops, up=None):
        return ("c", i, i * 8 * SEC, 1, i * 8 if up is None else up, 100 * i, drops)
    schema = "component string, sample_id long, ts_us long, pid long, uptime_s long, packets long, drops long"
    per = spark.createDataFrame([("p", "c", 80 * SEC, 240 * SEC)], "period_id string, component string, t0_us long, t1_us long")
    state = lambda rows: Q.measure_drops(spark.createDataFrame(rows, schema), per, 330 * SEC, 20 * SEC, 20 * SEC, 5.0, 60 * SEC).first()
    base = [sample(i, 0) for i in range(41)]
    assert state(base)["state"] == "cero_explicito"
    assert state([sample(i, 0 if i < 20 else 3) for i in range(41)])["drops"] == 3
    assert state(base[:20] + [sample(20, None)] + base[21:])["state"] == "ausente"
    assert state(base[:18] + base[22:])["state"] == "cobertura_insuficiente"
    assert state(base[:20] + [sample(i, 0, (i - 20) * 8) for i in range(20, 41)])["state"] == "cobertura_insuficiente"
    assert state(base[:25])["state"] == "desactualizada"


def test_forest_draws_only_rows_with_a_weight(spark):
    rows = [(i, float(i % 7), w) for i, w in enumerate([1.0, None, 0.0, -2.0, float("nan"), float("inf"), 1e-300, 5.0] * 12)]
    df = spark.createDataFrame(rows, "id long, x double, w double")
    for sample in (8, 256):
        roots = M.fit_iforest(df, "id", {"c": ["x"]}, 5, sample, 1, "w").where("node = 0").collect()
        assert len(roots) == 5 and {r["size"] for r in roots} == {min(sample, 36)}
    assert M.fit_iforest(df.where("w = 0"), "id", {"c": ["x"]}, 5, 8, 1, "w").count() == 0


def test_balanced_copies_are_exact(spark):
    sizes = [1, 2, 3, 4, 6, 9, 32, 27, 25, 49, 11, 97, 30, 30]
    df = spark.createDataFrame([(e, k) for e, n in enumerate(sizes) for k in range(n)], "episode_id int, k int")
    got = B.balance_lcm(df).groupBy("episode_id").agg({"copies": "sum", "k": "count"}).collect()
    common = math.lcm(*sizes)
    assert {r["episode_id"]: (int(r["sum(copies)"]), r["count(k)"]) for r in got} == {e: (common, n) for e, n in enumerate(sizes)}
    many = spark.createDataFrame([(e, k) for e in range(1, 130) for k in range(e)], "episode_id int, k int")
    with pytest.raises(Exception, match="(?i)overflow|out.of.range|cannot be represented"):
        B.balance_lcm(many).collect()
