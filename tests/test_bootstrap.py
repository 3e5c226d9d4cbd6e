"""Bootstrap thresholds against weighted ranks by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens.operators import stats as X


@pytest.mark.parametrize("cells, block", [(256, 1000), (4, 5), (1, 3)])
def test_bootstrap_thresholds_are_weighted_order_statistics(spark, cells, block):
    rng = np.random.default_rng(5)
    rows = [(f"e{rng.integers(0, 23)}", float(np.round(rng.normal(), 1))) for _ in range(400)]
    rows += [("e1", None), (None, 1.0), ("only_null", None), ("e2", float("inf"))]
    scores = spark.createDataFrame(rows, "episode_id string, score double")
    place = {r["_i"]: r["episode_id"] for r in X.dealt(scores.select("episode_id").distinct(), "episode_id", 9).collect()}
    m = len(place)
    picks = spark.range(1, 31).select(F.col("id").cast("int").alias("replicate")).crossJoin(spark.range(m).withColumnRenamed("id", "_i"))
    times: dict[int, dict[str, int]] = {}
    for r, i in picks.select("replicate", F.pmod(F.xxhash64("replicate", "_i", F.lit(9)), F.lit(m))).collect():
        times.setdefault(r, {})[place[i]] = times.setdefault(r, {}).get(place[i], 0) + 1
    want = {}
    for r, drawn in times.items():
        v = sorted(s for e, s in rows if s is not None for _ in range(drawn.get(e, 0)))
        want[r] = v[int(len(v) * 0.05)]
    got = X.bootstrap_threshold(scores, "episode_id", "score", 0.05, 30, 9, cells, block)
    assert {r["replicate"]: r["threshold"] for r in got.collect()} == want
    assert X.bootstrap_threshold(scores.limit(0), "episode_id", "score", 0.05, 30, 9, cells, block).count() == 0
