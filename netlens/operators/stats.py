"""Statistics of comparisons: paired tests, intervals, ranking metrics, effect sizes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from netlens.functions.columns import idiv, safe_ratio, wilson
from netlens.operators.core import materialize, ordered_counts, to_long

Z_PERCENT, Z_FRACTION = 1.96, 1.959963984540054


@F.pandas_udf(T.DoubleType())
def _sign_test(k: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided exact binomial test with p = 1/2."""
    def one(a, m):
        if m == 0:
            return 1.0
        low = min(a, m - a)
        if 2 * low == m:
            return 1.0
        # from the largest term downwards, until the rest cannot change the sum
        share, term, i = 1.0, 1.0, low
        while i > 0 and term > share * 1e-18:
            term *= i / (m - i + 1)
            share += term
            i -= 1
        first = math.lgamma(m + 1) - math.lgamma(low + 1) - math.lgamma(m - low + 1) - m * math.log(2)
        return min(1.0, 2 * math.exp(first) * share)
    return pd.Series([one(int(a), int(m)) for a, m in zip(k, n)])


def mcnemar(paired: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Exact test on the disagreements of two verdicts of the same rows."""
    x = paired.groupBy(*by).agg(
        F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(F.col(b) & ~F.col(a)).alias("only_b"))
    x = x.withColumn("discordant", F.col("only_a") + F.col("only_b"))
    return x.withColumn("p", _sign_test("only_a", "discordant"))


def holm(tests: DataFrame, name: str, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Step-down adjustment: once a p-value exceeds alpha/(m-i) nothing after it holds.

    The table has one row per pair of models, so one ordered window is enough.
    """
    order = Window.orderBy(p, name)
    every = Window.partitionBy()
    limit = F.lit(alpha) / (F.count(F.lit(1)).over(every) - F.row_number().over(order) + 1)
    x = tests.withColumn("holm_limit", limit)
    ok = F.min((F.col(p) <= F.col("holm_limit")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return x.withColumn("significant", ok)


def _beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction."""
    lg = np.vectorize(math.lgamma)
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg(aa + bb) - lg(aa) - lg(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
    tiny = 1e-300
    f = np.ones_like(xx); c = np.ones_like(xx); d = np.zeros_like(xx)
    for i in itertools.count():
        m = i // 2
        if i == 0:
            num = np.ones_like(xx)
        elif i % 2 == 0:
            num = m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m))
        else:
            num = -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))
        d = 1 + num * d
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
        f = f * c * d
        if i > 2 and not (np.abs(c * d - 1) > 1e-15).any():
            break
    value = np.where(xx <= 0, 0.0, np.where(xx >= 1, 1.0, front * (f - 1)))
    return np.where(flip, 1 - value, value)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def _exact_interval(k: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    kk, nn, tail = k.to_numpy(float), n.to_numpy(float), alpha.to_numpy(float) / 2
    def solve(a, b, target):
        lo, hi = np.zeros_like(a), np.ones_like(a)
        for _ in range(60):
            mid = (lo + hi) / 2
            less = _beta_cdf(a, b, mid) < target
            lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
        return (lo + hi) / 2
    one = np.ones_like(kk)
    low = np.where(kk > 0, solve(np.maximum(kk, one), np.maximum(nn - kk + 1, one), tail), 0.0)
    high = np.where(kk < nn, solve(kk + 1, np.maximum(nn - kk, one), 1 - tail), 1.0)
    return pd.DataFrame({"low": np.where(nn == 0, 0.0, low), "high": np.where(nn == 0, 1.0, high)})


def clopper_pearson(counts: DataFrame, k: str, n: str, alpha: float = 0.05) -> DataFrame:
    """Exact interval of each proportion of a table of counts."""
    x = counts.withColumn("_i", _exact_interval(F.col(k).cast("long"), F.col(n).cast("long"), F.lit(alpha)))
    return x.select(*counts.columns, F.col("_i.low").alias("cp_low"), F.col("_i.high").alias("cp_high"))


def to_episode(alerts: DataFrame, by: list[str], alert: str = "alert", rule: str = "any") -> DataFrame:
    """Window verdicts to episode verdicts: any window, or more than half of them."""
    c = F.count_if(F.col(alert))
    verdict = c > 0 if rule == "any" else c * 2 > F.count(F.lit(1))
    return alerts.groupBy(*by).agg(verdict.alias(alert))


def compare_all(alerts: DataFrame, models: list[str], unit: list[str]) -> DataFrame:
    """All pairs of models on the same units.

    alerts is long (unit, model, alert): one pivoted row per unit holds every model, so
    the pairs are columns of a row and never a self-join.
    """
    wide = alerts.groupBy(*unit).pivot("model", models).agg(F.max("alert"))
    pairs = list(combinations(models, 2))
    items = F.array(*[
        F.struct(F.lit(x).alias("model_a"), F.lit(y).alias("model_b"), F.col(f"`{x}`").alias("a"), F.col(f"`{y}`").alias("b")) for x, y in pairs
    ])
    long = wide.select(F.inline(items))
    return holm(mcnemar(long, ["model_a", "model_b"]).withColumn("pair", F.concat_ws(" vs ", "model_a", "model_b")), "pair")


# --- detection metrics ------------------------------------------------------------------------

def binary_metrics(scored: DataFrame, by: list[str], truth: str = "truth", alert: str = "alert", z: float = Z_FRACTION) -> DataFrame:
    """Confusion counts and the usual rates of a verdict; empty denominators give 0."""
    t, a = F.col(truth), F.col(alert)
    x = scored.groupBy(*by).agg(
        F.count_if(t & a).alias("tp"), F.count_if(~t & a).alias("fp"), F.count_if(t & ~a).alias("fn"), F.count_if(~t & ~a).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    recall, spec, prec = safe_ratio(tp, tp + fn), safe_ratio(tn, tn + fp), safe_ratio(tp, tp + fp)
    x = x.withColumns({
        "precision": prec, "recall": recall, "specificity": spec, "fpr": safe_ratio(fp, fp + tn), "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn), "balanced_accuracy": (recall + spec) / 2,
        "mcc": safe_ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    })
    w = wilson(F.col("tp"), F.col("tp") + F.col("fn"), z)
    return x.withColumns({"recall_low": w["low"], "recall_high": w["high"]})


def ranking_metrics(scored: DataFrame, by: list[str], score: str = "score", truth: str = "truth") -> DataFrame:
    """ROC-AUC by mid-ranks and step-wise average precision; low scores are anomalous."""
    x = scored.withColumn("_s", -F.col(score))
    pos = F.when(F.col(truth), 1).otherwise(0)
    v = ordered_counts(x, by, "_s", weights={"pos": pos})
    mid = F.col("below") + (F.col("n") + 1) / 2
    s = v.groupBy(*by).agg(
        F.sum(F.col("pos") * mid).alias("rank_sum"), F.sum("pos").alias("p"), F.max("total").alias("total"),
    )
    joined = v.join(s.select(*by, "p"), by) if by else v.join(F.broadcast(s.select("p")))
    tp = F.col("p") - F.col("pos_below")
    flagged = F.col("total") - F.col("below")
    ap = joined.groupBy(*by).agg(F.sum(F.col("pos") / F.col("p") * tp / flagged).alias("average_precision"))
    auc = s.select(*by, "p", (F.col("total") - F.col("p")).alias("n"), (
        (F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("total") - F.col("p")))).alias("roc_auc"))
    return auc.join(ap, by) if by else auc.join(F.broadcast(ap))


def cohens_d(rows: DataFrame, names: list[str], truth: str = "truth") -> DataFrame:
    """Pooled effect size of each feature between normal and anomalous rows.

    All moments come from one pass over (feature, value) rows, combined before the exchange.
    """
    t = F.col(truth)
    moments = []
    for g, c in ((0, ~t), (1, t)):
        v = F.when(c, F.col("value"))
        moments += [F.count_if(c).alias(f"n{g}"), F.avg(v).alias(f"m{g}"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias(f"v{g}")]
    x = to_long(rows, [truth], names).groupBy("feature").agg(*moments)
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = F.try_divide((n0 - 1) * F.col("v0") + (n1 - 1) * F.col("v1"), (n0 + n1 - 2).cast("double"))
    d = F.when((n0 == 0) | (n1 == 0) | (n0 + n1 <= 2), F.lit(0.0)).otherwise(safe_ratio(F.col("m1") - F.col("m0"), F.sqrt(pooled)))
    return x.select("feature", d.alias("d"))


def moments(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, feature, n, m, q): count, mean and sum of squared deviations, which add up and subtract."""
    v = F.col("value")
    return to_long(rows, keys, names).groupBy(*keys, "feature").agg(F.count(v).alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count(v)).alias("q")).where("n > 0")


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of coarser groups; a part is one row, so no table row is read again."""
    by = [*keys, "feature"]
    mean = parts.groupBy(*by).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_mean"))
    off = F.col("m") - F.col("_mean")
    return parts.join(mean, by).groupBy(*by).agg(F.sum("n").alias("n"), F.max("_mean").alias("m"), F.sum(F.col("q") + F.col("n") * off * off).alias("q"))


def effects_without(rows: DataFrame, names: list[str], episode: str = "episode_id", truth: str = "truth") -> DataFrame:
    """(held, feature, d): effect sizes with one anomalous episode left out, for every such episode.

    One pass gives the moments of each episode; those of a fold are the total less the episode's. Anomalies without
    an episode are in every fold and never held out; there is no fold where no anomaly would remain.
    """
    part = materialize(moments(rows.select(F.col(truth).alias("_t"), F.when(F.col(truth), F.col(episode)).alias("held"), *names), ["_t", "held"], names))
    normal = part.where("not _t").select("feature", F.col("n").alias("n0"), F.col("m").alias("m0"), F.col("q").alias("q0"))
    every = merged(part.where("_t").drop("_t", "held"), []).select("feature", F.col("n").alias("na"), F.col("m").alias("ma"), F.col("q").alias("qa"))
    held = part.where("_t and held is not null").select("held").distinct()
    x = held.join(F.broadcast(every)).join(part.where("_t").drop("_t"), ["held", "feature"], "left").join(normal, "feature", "left")  # one row per feature
    x = x.na.fill(0, ["n", "n0"]).na.fill(0.0, ["m", "q", "m0", "q0"])
    x = x.withColumn("n1", F.col("na") - F.col("n"))
    m1 = F.col("ma") - F.try_divide((F.col("m") - F.col("ma")) * F.col("n"), F.col("n1"))
    x = x.withColumn("m1", F.coalesce(m1, F.lit(0.0)))
    apart = F.col("m") - F.col("m1")
    q1 = F.col("qa") - F.col("q") - apart * apart * F.col("n") * F.col("n1") / F.col("na")
    q1 = F.when(q1 > 1e-12 * F.col("qa"), q1).otherwise(0.0)  # what subtraction leaves of a constant
    n0, n1 = F.col("n0"), F.col("n1")
    pooled = F.try_divide(F.col("q0") + q1, (n0 + n1 - 2).cast("double"))
    d = F.when((n0 == 0) | (n1 == 0) | (n0 + n1 <= 2), F.lit(0.0)).otherwise(safe_ratio(F.col("m1") - F.col("m0"), F.sqrt(pooled)))
    left = Window.partitionBy("held")
    return x.select("held", "feature", d.alias("d"), F.max("n1").over(left).alias("_left")).where("_left > 0").drop("_left")


def redundant_pairs(rows: DataFrame, names: list[str], limit: float = 0.8) -> DataFrame:
    """Feature pairs whose Pearson correlation, over the rows that have both, exceeds the limit.

    Each batch adds up its products of centred columns as matrices; Spark adds the batches
    per pair. A column that does not vary has no pair.
    """
    d = len(names)
    centre = to_long(rows, [], names).groupBy("feature").agg(F.avg("value").alias("m")).collect()  # a row per feature
    middle = np.array([{r["feature"]: r["m"] for r in centre}.get(n) or 0.0 for n in names])
    first, second = np.triu_indices(d, 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b[n].to_numpy(zero_copy_only=False).astype(float) for n in names]) - middle
            has = np.isfinite(x).astype(float)
            x = np.where(has > 0, x, 0.0)
            both, one, square, cross = has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x
            parts = [both[first, second], one[first, second], one[second, first], square[first, second], square[second, first], cross[first, second]]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), *[pa.array(v) for v in parts]], names=["a", "b", "n", "sa", "sb", "qa", "qb", "ab"])

    schema = "a int, b int, " + ", ".join(f"{c} double" for c in ("n", "sa", "sb", "qa", "qb", "ab"))
    x = rows.select(*[F.col(n).cast("double").alias(n) for n in names]).mapInArrow(sums, schema).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "ab")])
    spread = lambda s, q: F.greatest(F.col("n") * F.col(q) - F.col(s) * F.col(s), F.lit(0.0))
    r = F.try_divide(F.col("n") * F.col("ab") - F.col("sa") * F.col("sb"), F.sqrt(spread("sa", "qa")) * F.sqrt(spread("sb", "qb")))
    name = F.array(*map(F.lit, names))
    return x.select(F.element_at(name, F.col("a") + 1).alias("feature_a"), F.element_at(name, F.col("b") + 1).alias("feature_b"), r.alias("r")).where(F.abs("r") > limit)


def clusters(pairs: DataFrame, a: str = "feature_a", b: str = "feature_b") -> DataFrame:
    """Connected groups of at least two nodes: labels sink to the smallest neighbour.

    Each round writes the labels out, so the lineage does not grow with the rounds.
    """
    edges = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = materialize(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = materialize(edges.select(F.col("x").alias("node"), F.col("x").alias("label")).distinct())
    while True:
        near = edges.join(labels, edges.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        nxt = materialize(labels.join(near, labels.node == near.x).select("node", "label", F.least("label", "near").alias("new")))
        moved = nxt.where("new <> label").limit(1).count()
        labels = nxt.select("node", F.col("new").alias("label"))
        if not moved:
            return labels.select("node", F.col("label").alias("cluster"))


def top_features(effects: DataFrame, sizes: list[int]) -> DataFrame:
    """The N features with the largest absolute effect, for several N."""
    w = Window.orderBy(F.abs("d").desc(), F.col("feature"))
    ranked = effects.withColumn("rank", F.row_number().over(w))  # one row per feature
    return ranked.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("top_n")).where("rank <= top_n")


def fold_of(episode: Column, folds: int, seed: int) -> Column:
    """Stable pseudo-random fold of an episode."""
    return F.pmod(F.xxhash64(episode.cast("string"), F.lit(seed)), F.lit(folds)).cast("int")


def dealt(eps: DataFrame, episode: str, seed: int) -> DataFrame:
    """Distinct episodes with ``_i``, their place from 0 in a seeded order that no task sorts whole."""
    digest = F.md5(F.concat(F.col(episode).cast("string"), F.lit(f":{seed}")).cast("binary"))
    eps = materialize(eps.where(F.col(episode).isNotNull()).withColumn("_h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")))
    place = ordered_counts(eps, [], "_h").select(F.col("v").alias("_h"), F.col("below").alias("_below"))
    same = Window.partitionBy("_h").orderBy(episode)
    return eps.join(place, "_h").select(episode, (F.col("_below") + F.row_number().over(same) - 1).alias("_i"))


def episode_roles(rows: DataFrame, episode: str, folds: int = 5, seed: int = 20260, inner: int = 4) -> DataFrame:
    """(episode, fold, role) in every fold: test, calibrate (one in ``inner`` of the rest) or fit.

    Balanced folds: the episodes in a seeded order are dealt round, and a place among the
    rest of a fold follows from the place among all. Rows without an episode have no role.
    """
    eps = materialize(dealt(rows.select(episode).distinct(), episode, seed))
    n = eps.count()
    x = eps.select(episode, "_i", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    tested = lambda upto: F.floor((upto + folds - 1 - F.col("fold")) / folds)  # test episodes of the fold before a place
    place, rest = F.col("_i") - tested(F.col("_i")), F.lit(n) - tested(F.lit(n))
    role = F.when(F.col("_i") % folds == F.col("fold"), "test").when(place < F.floor(rest * (inner - 1) / inner), "fit").otherwise("calibrate")
    return x.select(episode, "fold", role.alias("role"))


def kfold_episodes(rows: DataFrame, episode: str, folds: int = 5, seed: int = 20260, inner: int = 4) -> DataFrame:
    """Role of every row in every fold; episodes never cross roles."""
    return rows.join(episode_roles(rows, episode, folds, seed, inner), episode)


def bootstrap_threshold(
    scores: DataFrame, episode: str, score: str, alpha: float, replicates: int, seed: int, cells: int = 256, block: int = 1000,
) -> DataFrame:
    """Order-statistic threshold of episode resamples, one row per replicate.

    A replicate draws as many episodes as there are, with replacement. Drawn multiplicities weigh the distinct scores, so
    rows are not copied. Scores are cut into ``cells`` at approximate quantiles; the mass of each cell in each replicate
    is a product of matrices per ``block`` of episodes (scores in cells by draws), which merges by addition. Only the cell
    that holds a replicate's rank is then ranked value by value, so what is exchanged does not grow with scores times replicates.
    """
    eps = materialize(dealt(scores.select(episode).distinct(), episode, seed))
    m = eps.count()
    counts = scores.where(F.col(score).isNotNull()).groupBy(episode, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("c")).join(eps, episode)
    counts = materialize(counts.select("_i", "s", "c"))
    cut = counts.agg(F.percentile_approx("s", F.array(*[F.lit(i / cells) for i in range(1, cells)]), F.lit(10000))).first()[0]  # as many as cells
    edges = np.unique(np.array(cut or [], float))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(edges, b["s"].to_numpy(zero_copy_only=False).astype(float))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "cell"])

    counts = counts.mapInArrow(placed, T.StructType([*counts.schema.fields, T.StructField("cell", T.IntegerType())]))
    spread = eps.select("_i").repartition(1 + m * replicates // 2_000_000, "_i")  # few rows, but each becomes as many as there are replicates
    draws = spread.select(F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"), "_i")
    pick = F.pmod(F.xxhash64("replicate", "_i", F.lit(seed)), F.lit(m))
    drawn = materialize(draws.groupBy("replicate", pick.alias("_i")).agg(F.count(F.lit(1)).alias("times")))

    def masses(held: pa.Table, taken: pa.Table) -> pa.Table:
        who, row = np.unique(held["_i"].to_numpy(), return_inverse=True)
        c = np.zeros((len(who), len(edges) + 1))
        c[row, held["cell"].to_numpy()] = held["c"].to_numpy()
        of = np.searchsorted(who, taken["_i"].to_numpy())
        times = np.zeros((len(who) + 1, replicates))  # the last for episodes without a score
        of[of < len(who)] = np.where(who[of[of < len(who)]] == taken["_i"].to_numpy()[of < len(who)], of[of < len(who)], len(who))
        times[of, taken["replicate"].to_numpy() - 1] = taken["times"].to_numpy()
        mass = np.rint(c.T @ times[:-1]).astype(np.int64)
        cell, replicate = np.nonzero(mass)
        return pa.table({"replicate": pa.array(replicate + 1, pa.int32()), "cell": pa.array(cell, pa.int32()), "mass": mass[cell, replicate]})

    part = idiv(F.col("_i"), block).alias("part")
    held = counts.groupBy("_i", "cell").agg(F.sum("c").alias("c")).withColumn("part", part).groupBy("part")
    mass = held.cogroup(drawn.withColumn("part", part).groupBy("part")).applyInArrow(masses, "replicate int, cell int, mass long")
    mass = mass.groupBy("replicate", "cell").agg(F.sum("mass").alias("mass"))
    each = Window.partitionBy("replicate")  # a row per cell
    upto = F.sum("mass").over(each.orderBy("cell"))
    place = mass.select("replicate", "cell", (upto - F.col("mass")).alias("base"), upto.alias("upto"), F.floor(F.sum("mass").over(each) * alpha).alias("k"))
    place = materialize(place.where((F.col("base") <= F.col("k")) & (F.col("k") < F.col("upto"))))
    near = counts.join(F.broadcast(place.select("cell").distinct()), "cell")  # cells at most
    x = near.join(drawn.join(F.broadcast(place), "replicate"), ["_i", "cell"])  # a row per replicate
    x = x.groupBy("replicate", "base", "k", "s").agg(F.sum(F.col("c") * F.col("times")).alias("mass"))
    reached = F.col("base") + F.sum("mass").over(each.orderBy("s"))  # the values of one cell
    x = x.withColumn("reached", reached).where(F.col("k") < F.col("reached"))
    return x.groupBy("replicate").agg(F.min("s").alias("threshold"))


def bootstrap_summary(thresholds: DataFrame, frozen: float) -> DataFrame:
    """Mean, deviation, CV in percent, 2.5/97.5 % points and where the frozen value falls."""
    t = F.col("threshold")
    return thresholds.agg(
        F.avg(t).alias("mean"), F.stddev_samp(t).alias("sd"), (F.abs(F.try_divide(F.stddev_samp(t), F.avg(t))) * 100).alias("cv_pct"),
        F.percentile(t, F.lit(0.025)).alias("p025"), F.percentile(t, F.lit(0.975)).alias("p975"),  # one value per replicate
        (F.count_if(t <= frozen) * 100 / F.count(F.lit(1))).alias("frozen_pct"),
    )


def weight_effect(a: DataFrame, b: DataFrame, key: list[str], score: str = "score") -> DataFrame:
    """Do two scorings agree, and by how much do they differ at most?"""
    x = a.select(*key, F.col(score).alias("s1")).join(b.select(*key, F.col(score).alias("s2")), key)
    d = F.abs(F.col("s1") - F.col("s2"))
    return x.agg(F.count(F.lit(1)).alias("rows"), (F.max(d) == 0).alias("equal"), F.max(d).alias("max_abs_delta"))


def dilution(windows: DataFrame, episodes: DataFrame, threshold: float) -> DataFrame:
    """Windows detected alone whose averaged episode is not (both with score <= threshold)."""
    e = episodes.select("episode_id", (F.col("score") <= threshold).alias("episode_hit"))
    x = windows.withColumn("hit", F.col("score") <= threshold).join(e, "episode_id")
    n = x.agg(F.count(F.lit(1)).alias("windows"), F.count_if("hit").alias("windows_hit"), F.count_if(F.col("hit") & ~F.col("episode_hit")).alias("windows_lost"))
    return n.join(F.broadcast(e.agg(F.count_if("episode_hit").alias("episodes_hit"))))  # one row
