"""Repeated fits with a fold dimension against one fit after another."""

import hashlib
import math

import numpy as np
import pytest

from netlens.operators import detect as M, experiments as EX, stats as X

NAMES = ["a", "b", "c", "flat"]
DDL = "id long, a double, b double, c double, flat double, episode_id string, truth boolean, partition string"


def table(spark, n=240, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad, ep = i % 6 == 0, f"{'z' if i % 6 == 0 else 'e'}{i % 4 if i % 6 == 0 else i % 11}"
        x = rng.normal(0, 1, 3) + (np.array([3.0, 0.4, 0.0]) * (1 + (i % 4 == 2)) if bad else 0)
        rows.append((i, *map(float, np.round(x, 4)), 5.0 if not bad or ep != "z2" else 6.0, ep, bad, ("train", "train", "validation", "test")[i % 4 if not bad else 3]))
    rows.append((n, 2.0, 1.0, 0.5, 5.0, None, True, "test"))  # an anomaly of no episode
    return spark.createDataFrame(rows, DDL), rows


def by_hand(rows, held):
    keep = [r for r in rows if not (r[6] and r[5] == held)]
    out = {}
    for j, name in enumerate(NAMES, 1):
        x0, x1 = (np.array([r[j] for r in keep if r[6] == t]) for t in (False, True))
        pooled = ((len(x0) - 1) * x0.var(ddof=1) + (len(x1) - 1) * x1.var(ddof=1)) / (len(x0) + len(x1) - 2)
        out[name] = (x1.mean() - x0.mean()) / math.sqrt(pooled) if pooled > 1e-15 else 0.0
    return out


def test_effects_of_all_folds_come_from_one_pass(spark):
    df, rows = table(spark)
    got = {}
    for r in X.effects_without(df, NAMES).collect():
        got.setdefault(r["held"], {})[r["feature"]] = r["d"]
    assert sorted(got) == ["z0", "z2"]
    for held, d in got.items():
        want = by_hand(rows, held)
        assert all(abs(d[n] - want[n]) < 1e-9 for n in NAMES)
    assert got["z2"]["flat"] == 0.0 and got["z0"]["flat"] != 0.0  # constant once the episode is out
    one = df.where("truth and episode_id = 'z0' or not truth")
    assert X.effects_without(one, NAMES).count() == 0 and X.effects_without(df.where("not truth"), NAMES).count() == 0
    assert X.effects_without(df.limit(0), NAMES).count() == 0


def ranking(pairs):
    """ROC-AUC and average precision of (score, truth), low scores anomalous, ties together."""
    pos, neg = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    auc = sum((p < n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap = 0.0
    for s in sorted(set(pos)):
        at = [t for v, t in pairs if v <= s]
        ap += sum(v == s for v in pos) / len(pos) * sum(at) / len(at)
    return auc, ap


def test_leave_one_episode_out_pools_folds(spark):
    df, rows = table(spark)
    got = {r["top_n"]: r for r in EX.leave_one_episode_out(df, "id", NAMES, [1, 2], 12, 32, 5, at_once=1).collect()}
    train, asked = df.where("partition = 'train' and not truth"), df.where("truth or partition = 'test'")
    for top in (1, 2):
        pooled = []
        for held in ("z0", "z2"):
            d = by_hand([r for r in rows if r[6] or r[7] != "test"], held)
            chosen = {"one": sorted(sorted(NAMES, key=lambda n: (-abs(d[n]), n))[:top])}
            m = M.fit_iforest(train, "id", chosen, 12, 32, 5)
            pooled += [(r["score_one"], r["truth"]) for r in M.score_iforest(asked, m, chosen).collect() if not r["truth"] or r["episode_id"] == held]
        auc, ap = ranking(pooled)
        assert abs(got[top]["roc_auc"] - auc) < 1e-9 and abs(got[top]["average_precision"] - ap) < 1e-9
        assert got[top]["p"] == sum(t for _, t in pooled) and got[top]["n"] == sum(not t for _, t in pooled)
    assert EX.leave_one_episode_out(df.where("not truth"), "id", NAMES, [1], 5, 16, 5).count() == 0


def roles_by_hand(episodes, folds, seed):
    order = sorted(episodes, key=lambda e: (int(hashlib.md5(f"{e}:{seed}".encode()).hexdigest()[:15], 16), e))
    out = {}
    for f in range(folds):
        rest = [e for i, e in enumerate(order) if i % folds != f]
        fit = set(rest[:math.floor(len(rest) * 3 / 4)])
        for i, e in enumerate(order):
            out[e, f] = "test" if i % folds == f else "fit" if e in fit else "calibrate"
    return out


@pytest.mark.parametrize("count, folds", [(11, 4), (3, 5), (1, 2), (40, 5)])
def test_roles_are_dealt_in_order(spark, count, folds):
    episodes = [f"e{i}" for i in range(count)]
    df = spark.createDataFrame([(e,) for e in episodes * 2] + [(None,)], "episode_id string")
    got = {(r["episode_id"], r["fold"]): r["role"] for r in X.episode_roles(df, "episode_id", folds, 9).collect()}
    assert got == roles_by_hand(episodes, folds, 9)


def test_forests_by_fold_are_those_of_each_fold_alone(spark):
    df, _ = table(spark)
    df = df.withColumn("fold", (df["id"] % 3).cast("int"))
    conf = {"x": NAMES, "y": ["a"]}
    together = M.fit_iforest(df.where("not truth"), "id", conf, 10, 16, 2, by="fold")
    scored = {r["id"]: (r["score_x"], r["score_y"]) for r in M.score_iforest(df, together, conf, by="fold").collect()}
    for f in range(3):
        alone = M.fit_iforest(df.where(f"not truth and fold = {f}"), "id", conf, 10, 16, 2)
        for r in M.score_iforest(df.where(f"fold = {f}"), alone, conf).collect():
            assert scored[r["id"]] == (r["score_x"], r["score_y"])
    strange = df.selectExpr("*").drop("fold").selectExpr("*", "if(id % 2 = 0, 7, null) as fold")
    assert all(r["score_x"] is None for r in M.score_iforest(strange, together, conf, by="fold").collect())


@pytest.mark.parametrize("kind", ["forest", "distance"])
def test_cross_validation_by_fold(spark, kind):
    df, rows = table(spark)
    detector = EX.fold_forest("id", 10, 32, 4) if kind == "forest" else EX.fold_distance
    got = {r["fold"]: r for r in EX.cross_validate(df, "id", NAMES, 4, 6, 0.1, detector).collect()}
    roles = roles_by_hand({r[5] for r in rows if not r[6]}, 4, 6)
    assert sorted(got) == [0, 1, 2, 3]
    for f in range(4):
        part = {role: [r for r in rows if not r[6] and roles[r[5], f] == role] for role in ("fit", "calibrate", "test")}
        if kind == "forest":
            m = M.fit_iforest(spark.createDataFrame(part["fit"], DDL), "id", {"all": NAMES}, 10, 32, 4)
            every = {r["id"]: r["score_all"] for r in M.score_iforest(df, m, {"all": NAMES}).collect()}
        else:
            x = np.array([r[1:5] for r in part["fit"]])
            sd = np.where(x.std(0) == 0, 1.0, x.std(0))
            every = {r[0]: -(((np.array(r[1:5]) - x.mean(0)) / sd) ** 2).sum() for r in rows}
        score = lambda rs: sorted(round(every[r[0]], 6) for r in rs)
        low = score(part["calibrate"])
        cut = low[math.floor(0.1 * len(low))]
        bad = [r for r in rows if r[6]]
        r = got[f]
        assert abs(r["threshold"] - cut) < 2e-6
        assert (r["normal"], r["anomalies"], r["test_episodes"]) == (len(part["test"]), len(bad), len({x[5] for x in part["test"]}))
        assert r["false_alerts"] == sum(s < r["threshold"] for s in score(part["test"])) and r["detected"] == sum(s < r["threshold"] for s in score(bad))
        assert abs(r["fpr_pct"] - 100 * r["false_alerts"] / r["normal"]) < 1e-9
