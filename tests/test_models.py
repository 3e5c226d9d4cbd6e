"""Neighbours, robust covariance and their helpers against brute force."""

import math

import numpy as np
import pytest

from netlens.operators import detect as M

DIMS = [f"d{i}" for i in range(16)]


def frame(spark, x, names, first=0):
    return spark.createDataFrame([(first + i, *[None if v is None else float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, " + ", ".join(f"{n} double" for n in names))


def direct(train, queries, k, skip_self=False):
    out = []
    for i, q in enumerate(queries):
        d = [(math.sqrt(((q - t) ** 2).sum()), j) for j, t in enumerate(train) if not (skip_self and i == j)]
        out.append([j for _, j in sorted(d)[:k]])
    return out


@pytest.mark.parametrize("skip_self", [False, True])
def test_neighbours_are_exact_and_far_blocks_are_not_read(spark, skip_self):
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 10, (12, 16))
    train = np.round(middle[rng.integers(0, 12, 900)] + rng.normal(0, 1, (900, 16)), 3)
    train[300:420] = train[7]  # a group of copies larger than a block
    queries = train if skip_self else np.vstack([middle[rng.integers(0, 12, 150)] + rng.normal(0, 1, (150, 16)), train[7:8], np.full((1, 16), 500.0)])
    got = M.knn(frame(spark, train, DIMS), frame(spark, queries, DIMS), "vec_id", DIMS, 10, 40, skip_self).collect()
    want = direct(train, queries, 10, skip_self)
    near = {r["vec_id"]: r["near"] for r in got}
    assert len(got) == len(queries)
    assert all([n["id"] for n in near[i]] == w for i, w in enumerate(want))
    assert sum(r["compared"] for r in got) < 0.35 * len(train) * len(queries)


def test_neighbours_of_few_odd_or_no_rows(spark):
    train = frame(spark, [[0, 0], [1, 0], [None, 1], [float("nan"), 1], [float("inf"), 0]], ["a", "b"])
    ask = frame(spark, [[0, 0], [5, 5], [None, 0]], ["a", "b"])
    got = {r["vec_id"]: [n["id"] for n in r["near"]] for r in M.knn(train, ask, "vec_id", ["a", "b"], 5).collect()}
    assert got == {0: [0, 1], 1: [1, 0]}
    assert M.knn(train.limit(0), ask, "vec_id", ["a", "b"], 5).count() == 0 and M.knn(train, ask.limit(0), "vec_id", ["a", "b"], 5).count() == 0


def test_a_cell_keeps_ties_and_small_rings_share_blocks():
    first, parts = M._packed(np.array([3.0, 4.0, 2.0, 25.0, 1.0, 9.0]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 4] and parts.tolist() == [1, 1, 1, 3, 1, 1]
    rng = np.random.default_rng(2)
    b = np.round(rng.normal(0, 1, (300, 8)), 1)
    b[40:90] = b[3]
    for factor in (1.0, 1e-6, 1e160):  # squares of the last overflow
        a, x = b[:20] * factor, b * factor
        for reach in (np.full(20, np.inf), np.sqrt(((a[:, None] - x[None]) ** 2).sum(axis=2)).clip(max=1e300)[:, 5]):
            r, ids, d = M._best_of(np.arange(20), np.arange(300), a, x, 7, reach, True)
            with np.errstate(over="ignore"):
                whole = np.sqrt(((a[:, None] - x[None]) ** 2).sum(axis=2))
            for i in range(20):
                want = sorted((whole[i, j], j) for j in range(300) if j != i and whole[i, j] <= reach[i])[:7]
                got = sorted(zip(d[r == i].tolist(), ids[r == i].tolist()))
                assert [g for g in got if np.isfinite(g[0]) and g[0] <= reach[i]][:7] == [w for w in want if np.isfinite(w[0])]


def test_chi_squared_points():
    # fixed values: published table points
    for p, d, x in ((0.95, 1, 3.841459), (0.975, 2, 7.377759), (0.5, 10, 9.341818), (0.975, 64, 88.004051), (0.025, 5, 0.831212)):
        assert abs(M.chi2_quantile(p, d) - x) < 1e-5


def best_subset(x, h, rng, tries):
    """Smallest determinant over many random starts, concentrated to the end."""
    best = (math.inf, None)
    for _ in range(tries):
        part = x[rng.choice(len(x), x.shape[1] + 1, replace=False)]
        volume = math.inf
        while True:
            mean, inv = part.mean(0), np.linalg.pinv(np.cov(part.T, bias=True))
            d = np.einsum("ij,jk,ik->i", x - mean, inv, x - mean)
            part = x[np.argsort(d, kind="stable")[:h]]
            now = np.linalg.det(np.cov(part.T, bias=True))
            if now >= volume * (1 - 1e-12):
                break
            volume = now
        best = min(best, (volume, part.tolist()))
    return best[0], np.array(best[1])


def test_robust_covariance_matches_many_starts_by_hand(spark):
    rng = np.random.default_rng(8)
    x = rng.multivariate_normal([1, -2, 0], [[2, 0.6, 0], [0.6, 1, 0.2], [0, 0.2, 0.5]], 90)
    x[:25] = rng.normal(9, 0.3, (25, 3))
    names = ["a", "b", "c"]
    mean, inv, cov = M.fit_mahalanobis(frame(spark, x, names), "vec_id", names, seed=1)
    h = math.ceil((len(x) + 4) / 2)
    _, core = best_subset(x, h, rng, 200)
    m, c = core.mean(0), np.cov(core.T, bias=True)
    dist = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.pinv(c), x - m)
    c = c * (np.median(dist(m, c)) / M.chi2_quantile(0.5, 3))
    inside = x[dist(m, c) < M.chi2_quantile(0.975, 3)]
    assert np.allclose(mean, inside.mean(0), atol=1e-9) and np.allclose(cov, np.cov(inside.T, bias=True), atol=1e-9)
    # starts from a part of the table may end in another optimum, which leaves the planted group out as well
    near = M.fit_mahalanobis(frame(spark, x, names), "vec_id", names, core=60, seed=1)
    assert np.abs(near[0] - mean).max() < 0.3 and np.linalg.det(near[2]) < 2 * np.linalg.det(cov)
    scored = M.score_mahalanobis(frame(spark, x, names), names, mean, inv).collect()
    assert max(r["score"] for r in scored if r["vec_id"] < 25) < min(-M.chi2_quantile(0.999, 3), -50)


def test_robust_covariance_of_odd_rows(spark):
    names = ["a", "b"]
    flat = [[float(i % 7), 2.0 * (i % 7)] for i in range(30)] + [[None, 1], [float("nan"), 1], [float("inf"), 1]]
    mean, inv, cov = M.fit_mahalanobis(frame(spark, flat, names), "vec_id", names)
    assert np.isfinite(mean).all() and np.isfinite(inv).all() and abs(np.linalg.det(cov)) < 1e-9
    with pytest.raises(ValueError, match="do not determine"):
        M.fit_mahalanobis(frame(spark, [[0, 0], [1, 1]], names), "vec_id", names)


@pytest.mark.parametrize("h", [1, 40, 333, 600])
def test_a_step_of_concentration_is_exact_and_writes_nothing(spark, h, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 2, (600, 3)), 1)
    x[100:180] = x[7]  # equal distances are in or out together
    names = ["a", "b", "c"]
    shapes = {0: (x.mean(0), np.linalg.pinv(np.cov(x.T))), 2: (x[7], np.eye(3))}
    monkeypatch.setattr(M, "materialize", lambda df: pytest.fail("a step wrote its distances"))
    got = M._nearest_moments(frame(spark, x, names).repartition(5), names, shapes, h)
    for s, (mean, inv) in shapes.items():
        dist = np.einsum("ij,jk,ik->i", x - mean, inv, x - mean)
        part = x[dist <= np.sort(dist)[h - 1] * (1 + 1e-12)]
        assert got[s][0] == len(part) >= h
        assert np.allclose(got[s][1], part.mean(0)) and np.allclose(got[s][2], np.cov(part.T, bias=True) if len(part) > 1 else 0, atol=1e-9)
