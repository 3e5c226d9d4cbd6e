"""Repeated fits: ablation, parameter grids, cross-validation, leave-one-episode-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from netlens.operators import detect as M, stats as X
from netlens.operators.core import materialize


def _long(scored: DataFrame, configs: list[str], keep: list[str]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("config"), F.col(f"score_{c}").alias("score")) for c in configs])
    return scored.select(*keep, F.inline(items))


def ablation(rows: DataFrame, key: str, configs: dict[str, list[str]], trees: int, sample: int, seed: int, alpha: float, z: float = X.Z_PERCENT) -> DataFrame:
    """Each feature group alone or left out: false alerts and detections with intervals.

    rows: key, features, partition, truth, episode_id. All forests come from one pass and
    every row is scored once for all of them.
    """
    model = M.fit_iforest(rows.where("partition = 'train' and not truth"), key, configs, trees, sample, seed)
    scored = materialize(_long(M.score_iforest(rows.where("partition <> 'train' or truth"), model, configs), list(configs), [key, "partition", "truth", "episode_id"]))
    t = M.lower_tail(scored.where("partition = 'validation' and not truth"), ["config"], "score", "episode_id", alpha, key).select("config", "threshold")
    x = scored.where("truth or partition = 'test'").join(F.broadcast(t), "config")  # one row per config
    hit = F.col("score") < F.col("threshold")
    out = x.groupBy("config").agg(
        F.count_if(hit & ~F.col("truth")).alias("false_alerts"), F.count_if(~F.col("truth")).alias("normal"), F.count_if(hit & F.col("truth")).alias("detected"), F.count_if("truth").alias("anomalies"))
    w = X.wilson(F.col("detected"), F.col("anomalies"), z)
    return out.withColumns({"low_pct": w["low"] * 100, "high_pct": w["high"] * 100})


def parameter_grid(rows: DataFrame, key: str, names: list[str], samples: list[int], trees: int, seed: int) -> DataFrame:
    """Scaled or not x subsample size: ranking quality on test rows against anomalies."""
    train = rows.where("partition = 'train' and not truth")
    scaler = M.fit_scaler(train, names)
    parts = []
    for scaled in (False, True):
        z = M.scale(rows, scaler, names) if scaled else rows
        for s in samples:
            m = M.fit_iforest(z.where("partition = 'train' and not truth"), key, {"all": names}, trees, s, seed)
            x = M.score_iforest(z.where("truth or partition = 'test'"), m, {"all": names})
            parts.append(x.select(F.lit(f"scaled={scaled}|sample={s}").alias("config"), F.col("score_all").alias("score"), "truth"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return X.ranking_metrics(materialize(out), ["config"])


def cross_validate(
    rows: DataFrame, key: str, names: list[str], folds: int, seed: int, alpha: float,
    detector: Callable[[DataFrame, DataFrame, list[str]], Callable[[DataFrame], DataFrame]], digits: int = 6,
) -> DataFrame:
    """Per fold: threshold from the calibration episodes, false alerts on the test episodes, detection on all anomalies.

    rows: key, features, truth, episode_id. ``detector(normal rows, roles, names)`` fits all folds at once and returns a
    function that adds ``score`` to rows with ``fold``. Only rows that a fold calibrates on, tests or detects are copied to
    it. Scores are rounded to ``digits``; an alert is strictly below the threshold. Rows without an episode have no role.
    """
    normal = rows.where("not truth")
    roles = materialize(X.episode_roles(normal, "episode_id", folds, seed))
    score = detector(normal, roles, names)
    asked = normal.join(roles.where("role <> 'fit'"), "episode_id").select(*rows.columns, "fold", "role")
    every = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    asked = asked.unionByName(rows.where("truth").select("*", every.alias("fold"), F.lit("anomaly").alias("role")))
    x = materialize(score(asked).select(key, "episode_id", "fold", "role", F.round("score", digits).alias("score")))
    t = M.lower_tail(x.where("role = 'calibrate'"), ["fold"], "score", "episode_id", alpha, key).select("fold", "threshold")
    hit, test, bad = F.col("score") < F.col("threshold"), F.col("role") == "test", F.col("role") == "anomaly"
    out = x.where("role <> 'calibrate'").join(F.broadcast(t), "fold").groupBy("fold", "threshold").agg(  # one row per fold
        F.count_distinct(F.when(test, F.col("episode_id"))).alias("test_episodes"), F.count_if(test).alias("normal"), F.count_if(test & hit).alias("false_alerts"),
        F.count_if(bad).alias("anomalies"), F.count_if(bad & hit).alias("detected"))
    share = lambda a, b: F.try_divide(100.0 * F.col(a), F.col(b))
    return out.withColumns({"fpr_pct": share("false_alerts", "normal"), "detected_pct": share("detected", "anomalies")})


def fold_forest(key: str, trees: int = M.TREES, sample: int = M.SAMPLE, seed: int = 0):
    """Detector of ``cross_validate``: an Isolation Forest per fold, all from one pass."""
    def fit(normal: DataFrame, roles: DataFrame, names: list[str]) -> Callable[[DataFrame], DataFrame]:
        own = normal.join(roles.where("role = 'fit'"), "episode_id")
        model = M.fit_iforest(own, key, {"all": names}, trees, sample, seed, by="fold")
        return lambda asked: M.score_iforest(asked, model, {"all": names}, by="fold").withColumnRenamed("score_all", "score")

    return fit


def fold_distance(normal: DataFrame, roles: DataFrame, names: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Detector of ``cross_validate``: minus the squared distance in deviations of the fold's fit rows.

    Moments are taken once per episode and added up per fold.
    """
    part = materialize(X.moments(normal.select("episode_id", *names), ["episode_id"], names))
    own = X.merged(part.join(roles.where("role = 'fit'"), "episode_id").drop("episode_id", "role"), ["fold"])
    sd = F.sqrt(F.col("q") / F.col("n"))
    own = own.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("m", F.when(sd == 0, 1.0).otherwise(sd).alias("s"))))).alias("_of"))

    def score(asked: DataFrame) -> DataFrame:
        z = [(F.col(n) - F.col("_of")[n]["m"]) / F.col("_of")[n]["s"] for n in names]
        terms = F.transform(F.array(*z), lambda v: v * v)
        return asked.join(F.broadcast(materialize(own)), "fold").withColumn("score", -F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)).drop("_of")  # one row per fold

    return score


def leave_one_episode_out(rows: DataFrame, key: str, names: list[str], tops: list[int], trees: int, sample: int, seed: int, at_once: int = 4) -> DataFrame:
    """Select features without the held-out episode, score it, pool all folds per size.

    Effect sizes of all folds come from one pass over the rows. Folds that select the same features share a forest, so
    the forests are one per distinct feature set, fitted and scored ``at_once`` sets together; their names, at most one
    list per anomalous episode and size, are all that reaches the driver. A fold that leaves no anomaly has no part.
    """
    ref = rows.where("partition <> 'test' and not truth or truth")
    ranked = X.effects_without(ref, names).withColumn("rank", F.row_number().over(Window.partitionBy("held").orderBy(F.abs("d").desc(), "feature")))  # one row per feature
    sizes = ranked.select("held", "feature", "rank", F.explode(F.array(*map(F.lit, sorted(set(tops))))).alias("top_n")).where("rank <= top_n")
    plan = materialize(sizes.groupBy("held", "top_n").agg(F.array_sort(F.collect_list("feature")).alias("features")))
    sets = sorted(r[0] for r in plan.select("features").distinct().collect())
    train, asked, parts = rows.where("partition = 'train' and not truth"), rows.where("truth or partition = 'test'"), []
    for at in range(0, len(sets), at_once):
        configs = {f"set{i}": sets[i] for i in range(at, min(at + at_once, len(sets)))}
        m = M.fit_iforest(train, key, configs, trees, sample, seed)
        parts.append(materialize(_long(M.score_iforest(asked, m, configs), list(configs), ["truth", "episode_id"])))
    if not parts:
        return X.ranking_metrics(asked.select(F.lit(0).alias("top_n"), F.lit(0.0).alias("score"), "truth").limit(0), ["top_n"])
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    named = rows.sparkSession.createDataFrame([(f"set{i}", s) for i, s in enumerate(sets)], "config string, features array<string>")
    folds = plan.join(F.broadcast(named), "features").select("config", "held", "top_n")
    x = scored.join(F.broadcast(folds), "config").where("not truth or episode_id = held")  # one row per fold and size
    return X.ranking_metrics(materialize(x.select("top_n", "score", "truth")), ["top_n"])
