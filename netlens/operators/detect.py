"""Detectors, thresholds and scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from netlens.functions.columns import safe_ratio
from netlens.operators.core import materialize, ordered_counts, quantiles, to_long

TREES, SAMPLE, OFFSET = 500, 256, -0.5


# --- scaling -------------------------------------------------------------------------------

def fit_scaler(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row per feature: mean and population deviation (1 where it is zero)."""
    sd = F.coalesce(F.stddev_pop("value"), F.lit(0.0))
    return to_long(rows, [], names).groupBy("feature").agg(F.avg("value").alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("scale"))


def scale(rows: DataFrame, scaler: DataFrame, names: list[str]) -> DataFrame:
    """Standardised features; the scaler is one row per feature, folded into two maps."""
    one = scaler.agg(F.map_from_entries(F.collect_list(F.struct("feature", "mean"))).alias("_m"), F.map_from_entries(F.collect_list(F.struct("feature", "scale"))).alias("_s"))
    x = rows.join(F.broadcast(one))
    return x.withColumns({n: (F.col(n) - F.col("_m")[n]) / F.col("_s")[n] for n in names}).drop("_m", "_s")


# --- isolation forest -------------------------------------------------------------------------

def _unit(key: Column, *salt) -> Column:
    return (F.pmod(F.xxhash64(key, *salt), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    """Nodes of one isolation tree: left, right, feature, threshold, size, depth (-1 = leaf)."""
    nodes = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        idx, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([-1, -1, -1, 0.0, len(idx), depth])
        if parent >= 0:
            nodes[parent][side] = me
        if depth >= limit or len(idx) <= 1:
            continue
        lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
        live = np.flatnonzero(hi > lo)
        if not len(live):
            continue
        f = int(rng.choice(live))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = x[idx, f] <= cut
        nodes[me][2], nodes[me][3] = f, cut
        todo.append((idx[~left], depth + 1, me, 1))
        todo.append((idx[left], depth + 1, me, 0))
    return nodes


MODEL_SCHEMA = "config string, tree int, node int, left int, right int, feature int, threshold double, size int, depth int"


def fit_iforest(
    rows: DataFrame, key: str, configs: dict[str, list[str]], trees: int = TREES, sample: int = SAMPLE,
    seed: int = 0, weight: str | None = None, by: str | None = None,
) -> DataFrame:
    """Forests for several feature sets from one pass, as a table of nodes.

    Each tree gets ``sample`` rows without replacement: the smallest exponential keys
    -ln(u)/weight, u a hash of (row, tree, seed), so the same seed gives the same forest
    whatever the partitioning. Only keys below a bound leave the scan; the bound is raised
    until every tree has its sample below it, so that it changes how much is sent and never
    which rows are drawn, under any weights. Rows whose weight is null, zero, negative or not finite are never
    drawn; a tree has min(sample, rows with a weight) rows, and without such rows there is no tree.

    ``by`` names a column of whole numbers, such as a fold: each of its values (a few) gets the forests that its rows
    alone would give, all in the same pass, and the table keeps the column.
    """
    names = sorted({n for f in configs.values() for n in f})
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = rows.where((w > 0) & (w < float("inf")))  # NaN is above all numbers
    g = F.col(by).cast("int") if by else F.lit(0)
    k = F.col(key).cast("string")
    base = rows.select(g.alias("g"), k.alias("k"), w.alias("w"), F.array(*[F.col(c).cast("double") for c in names]).alias("x")).where("g is not null")
    groups = {r["g"]: r for r in base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("mass")).collect()}  # a row per value of ``by``
    psi = {i: min(sample, r["n"]) for i, r in groups.items()}

    def below(bounds: dict[int, float]) -> DataFrame:
        e = lambda t: -F.ln(_unit(F.col("k"), t, F.lit(seed))) / F.col("w")
        bound = F.create_map(*[F.lit(v) for pair in bounds.items() for v in pair])[F.col("g")]
        drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), e(t).alias("e"))), lambda d: d["e"] <= F.col("bound"))
        return base.where(F.col("g").isin(list(bounds))).withColumn("bound", bound).select("g", "k", "x", F.explode(drawn).alias("d")).select("g", "k", "x", "d.tree", "d.e")

    # a bound ends at infinity, which all keys reach; what is drawn is bounded by trees x sample x a small factor
    bounds = {i: float("inf") if r["n"] <= 4 * sample else max(3.0 * sample / r["mass"], 1e-300) for i, r in groups.items()}
    more, x = 4.0, None
    while bounds:
        drawn = materialize(below(bounds))
        sizes = drawn.groupBy("g", "tree").count().groupBy("g").agg(F.min("count").alias("least"), F.count(F.lit(1)).alias("trees")).collect()
        full = [r["g"] for r in sizes if r["trees"] == trees and r["least"] >= psi[r["g"]]]
        part = drawn.where(F.col("g").isin(full))
        x = part if x is None else x.unionByName(part)
        bounds, more = {i: b * more for i, b in bounds.items() if i not in full}, min(more * more, 1e300)
    if x is None:
        x = base.select("g", "k", "x", F.lit(0).alias("tree"), F.lit(0.0).alias("e")).limit(0)
    columns = {c: [names.index(f) for f in fs] for c, fs in configs.items()}

    def grow(table: pa.Table) -> pa.Table:
        group = table["g"][0].as_py()
        table = table.sort_by([("e", "ascending"), ("k", "ascending")]).slice(0, psi[group])
        limit = max(1, math.ceil(math.log2(max(psi[group], 2))))
        tree = table["tree"][0].as_py()
        data = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1)
        out: dict[str, list] = {c.split()[0]: [] for c in MODEL_SCHEMA.split(", ")}
        for number, (config, cols) in enumerate(sorted(columns.items())):
            rng = np.random.default_rng([seed, tree, number])
            for node, values in enumerate(_grow(data[:, cols], rng, limit)):
                for c, v in zip(out, (config, tree, node, *values)):
                    out[c].append(v)
        types = {"config": pa.string(), "threshold": pa.float64()}
        return pa.table({"g": pa.array([group] * len(out["tree"]), pa.int32()), **{c: pa.array(v, types.get(c, pa.int32())) for c, v in out.items()}})

    model = materialize(x.groupBy("g", "tree").applyInArrow(grow, f"g int, {MODEL_SCHEMA}"))
    return model.withColumnRenamed("g", by) if by else model.drop("g")


def average_path(n: float) -> float:
    """Mean unsuccessful search length of a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def score_iforest(rows: DataFrame, model: DataFrame, configs: dict[str, list[str]], by: str | None = None) -> DataFrame:
    """Rows with ``score_<config>`` = -2^(-E[h/c]), c of each tree's own sample; decision = score + 0.5.

    A forest has at most trees x (2 x sample - 1) nodes per config whatever it was fitted
    on, so it is collected once and shipped with the function; rows stay where they are and
    are scored in Arrow batches. With ``by``, a row is scored by the forest of its own value;
    without a forest for it there is no score.
    """
    forests: dict[tuple, list] = {}
    nodes = model.toPandas()
    nodes["_g"] = nodes[by].astype("int64") if by else 0
    for (group, config, _), part in nodes.groupby(["_g", "config", "tree"], sort=True):
        part = part.sort_values("node")
        length = part["depth"].to_numpy(float) + np.array([average_path(s) for s in part["size"]])
        forests.setdefault((int(group), config), []).append((part["left"].to_numpy(), part["right"].to_numpy(), part["feature"].to_numpy(), part["threshold"].to_numpy(), length, int(part["size"].iloc[0])))
    names = sorted({n for f in configs.values() for n in f})
    out_schema = T.StructType([*rows.schema.fields, *[T.StructField(f"score_{c}", T.DoubleType()) for c in configs]])

    def paths(x: np.ndarray, trees: list) -> np.ndarray:
        total, at = np.zeros(len(x)), np.arange(len(x))
        for left, right, feature, cut, length, size in trees:
            node = np.zeros(len(x), dtype=int)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[at, np.maximum(f, 0)] <= cut[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += length[node] / (average_path(size) or 1.0)
        return total

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = np.column_stack([b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]) if b.num_rows else np.zeros((0, len(names)))
            groups = np.array([-1 if v is None else v for v in b.column(by).to_pylist()], dtype=int) if by else np.zeros(len(data), dtype=int)
            arrays = list(b.columns)
            for config, fs in configs.items():
                cols, out, known = [names.index(f) for f in fs], np.full(len(data), np.nan), np.zeros(len(data), dtype=bool)
                for group in np.unique(groups):
                    trees, here = forests.get((int(group), config)), groups == group
                    if trees:
                        out[here] = -np.power(2.0, -paths(data[here][:, cols], trees) / len(trees))
                        known |= here
                arrays.append(pa.array(out, mask=~known))
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names, *[f"score_{c}" for c in configs]])

    return rows.mapInArrow(score, out_schema)


# --- neighbours --------------------------------------------------------------------------------

MOST_PIVOTS, MOST_RINGS = 256, 64
SLACK = 1e-9  # of a distance: bounds from rounded numbers must not cut off a tie


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, some rows of a at a time."""
    step = max(1, 4_000_000 // max(1, b.size))
    return np.concatenate([np.sqrt(((a[i:i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2)) for i in range(0, len(a), step)] or [np.zeros((0, len(b)))])


def _vectors(column) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _chained(x: np.ndarray) -> np.ndarray:
    """The rows in an order in which the next is the nearest of those left, so neighbours in it lie close."""
    left, order = np.ones(len(x), dtype=bool), [0]
    left[0] = False
    while left.any():
        d = np.where(left, ((x - x[order[-1]]) ** 2).sum(axis=1), np.inf)
        order.append(int(d.argmin()))
        left[order[-1]] = False
    return x[order]


def _packed(held: np.ndarray, cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of each group: small groups in a row share a part, large ones have several."""
    first, parts = np.zeros(len(held), dtype=int), np.maximum(np.ceil(held / cell_rows).astype(int), 1)
    part, full = 0, 0.0
    for i, n in enumerate(held):
        if full and full + n > cell_rows:
            part, full = part + 1, 0.0
        first[i] = part
        part, full = (part + parts[i], 0.0) if parts[i] > 1 else (part, full + n)
    return first, parts


def _best_of(ia: np.ndarray, ib: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, reach: np.ndarray, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of all rows of b that may be among a query's k nearest, none farther than its reach.

    Products of matrices tell which rows come into question, with room for their rounding; distances are
    then taken from the differences of those rows alone.
    """
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    huge = not (na.max(initial=0) < 1e300 and nb.max(initial=0) < 1e300)  # products would overflow
    slack = 1e-12 * a.shape[1] * (na + nb.max())  # far above the rounding of a product, far below a distance that counts
    limit = (reach * (1 + SLACK)) ** 2
    found = []
    step = max(1, 2_000_000 // len(b))
    for i in range(0, len(a), step):
        at = slice(i, i + step)
        if huge:
            d = _between(a[at], b) ** 2
        else:
            d = a[at] @ (-2.0 * b.T)
            d += na[at, None]
            d += nb
        if skip_self:
            d[ia[at, None] == ib[None, :]] = np.inf
        top = limit[at]
        if len(b) > k and np.isinf(top).any():
            top = np.minimum(top, np.partition(d, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero((d < np.inf) if huge else (d <= (top + 2 * slack[at])[:, None]) & (d < np.inf))
        for j in range(0, len(row), 100_000):
            r, c = row[j:j + 100_000] + i, col[j:j + 100_000]
            found.append((r, ib[c], np.sqrt(((a[r] - b[c]) ** 2).sum(axis=1))))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, int) for i in range(3))


def knn(train: DataFrame, queries: DataFrame, key: str, names: list[str], k: int, cell_rows: int = 8192, skip_self: bool = False) -> DataFrame:
    """Exact k nearest training rows of each query: (key, neighbours array<struct<dist, id>>, compared).

    Training rows go to the nearest of some pivots and there to a ring of distances, at most
    ``MOST_PIVOTS`` x ``MOST_RINGS`` rings whatever the table's size; rings are cut into
    blocks of about ``cell_rows`` by a hash, so copies of one row fill many blocks, and small
    rings of near pivots share a block. A query first meets the rings nearest to it that hold
    k rows, and then those rings only that the triangle inequality does not put beyond the k-th
    distance found: |d(q, p) - d(x, p)|, and half of d(q, p) - d(q, own pivot) as x is nearest
    to p. Ties go to the smaller key. ``compared`` counts the training rows a query met. Queries
    travel in chunks of about ``cell_rows`` of near pivots, a block goes once to each chunk that
    needs it, and a cell returns each query's k best, in the second round none beyond that distance.
    Rows with a null or non-finite component are nobody's neighbour and get no row.
    """
    vec = F.array(*[F.col(n).cast("double") for n in names])
    whole = lambda df: df.select(F.col(key).cast("long").alias("id"), vec.alias("x")).where(F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    t, q = whole(train), whole(queries)
    out = "id long, near array<struct<dist: double, id: long>>, compared long"
    total = t.count()
    if not total:
        return q.sparkSession.createDataFrame([], out).withColumnRenamed("id", key)
    marks = [r["x"] for r in t.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(min(MOST_PIVOTS, math.ceil(math.sqrt(total)))).collect()]
    pivots = _chained(np.unique(np.array(marks, dtype=float), axis=0))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _between(_vectors(b["x"]), pivots)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b["id"], b["x"], pa.array(own, pa.int32()), pa.array(d[np.arange(len(d)), own])], names=["id", "x", "pivot", "d"])

    schema = "id long, x array<double>, pivot int, d double"
    t = materialize(t.mapInArrow(home, schema))
    rings = min(MOST_RINGS, max(1, math.ceil(total / len(pivots) / cell_rows)))
    if rings > 1:
        cuts = t.groupBy("pivot").agg(F.percentile_approx("d", [i / rings for i in range(1, rings)], 1000).alias("cuts"))  # a row per pivot
        t = t.join(F.broadcast(cuts), "pivot").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("d")))).drop("cuts")
    else:
        t = t.withColumn("ring", F.lit(0))
    found = t.groupBy("pivot", "ring").agg(F.min("d"), F.max("d"), F.count(F.lit(1))).orderBy("pivot", "ring").collect()  # a row per ring
    owner = np.array([r[0] for r in found])
    low, high, held = (np.array([r[i] for r in found], dtype=float) for i in (2, 3, 4))
    first, parts = _packed(held, cell_rows)
    place = q.sparkSession.createDataFrame([(r[0], r[1], i, int(f), int(n)) for i, (r, f, n) in enumerate(zip(found, first, parts))], "pivot int, ring int, place int, first int, parts int")
    share = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    t = t.join(F.broadcast(place), ["pivot", "ring"]).select("id", "x", "place", (F.col("first") + share).alias("block"))  # a row per ring

    q = materialize(q.mapInArrow(home, schema).drop("d"))
    asking = q.groupBy("pivot").agg(F.count(F.lit(1))).orderBy("pivot").collect()  # a row per pivot
    if not asking:
        return q.sparkSession.createDataFrame([], out).withColumnRenamed("id", key)
    shares = [(r[0], int(f), int(n)) for r, f, n in zip(asking, *_packed(np.array([r[1] for r in asking], dtype=float), cell_rows))]
    shares = q.sparkSession.createDataFrame(shares, "pivot int, first int, parts int")
    q = q.join(F.broadcast(shares), "pivot").select("id", "x", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(2)), "parts")).cast("int").alias("chunk"))
    enough = k + int(skip_self)

    def blocks_of(again: bool):
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                d = _between(_vectors(b["x"]), pivots)
                far = d[:, owner]
                bound = np.maximum(np.maximum(far - high, low - far), (far - d.min(axis=1)[:, None]) / 2)
                order = np.argsort(bound, axis=1, kind="stable")
                start = np.zeros(bound.shape, dtype=bool)
                ahead = np.cumsum(held[order], axis=1) - held[order]
                np.put_along_axis(start, order, ahead < enough, axis=1)
                take = start
                if again:
                    reach = b["reach"].to_numpy(zero_copy_only=False)
                    take = ~start & (bound <= (reach * (1 + SLACK) + SLACK * far.max(axis=1))[:, None])
                lists = []
                for row in take:
                    blocks: dict[int, list[int]] = {}
                    for w in np.flatnonzero(row).tolist():
                        for block in range(first[w], first[w] + parts[w]):
                            blocks.setdefault(block, []).append(w)
                    lists.append([{"block": block, "places": places} for block, places in blocks.items()])
                kind = pa.list_(pa.struct([("block", pa.int32()), ("places", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([b["id"], b["x"], b["chunk"], b["reach"], pa.array(lists, kind)], names=["id", "x", "chunk", "reach", "blocks"])

        return choose

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _vectors(left["x"]), _vectors(right["x"])
        ia, ib, reach, ring = (c.to_numpy() for c in (left["id"], right["id"], left["reach"], right["place"]))
        lists = left["places"].combine_chunks()
        asked, wants = np.repeat(np.arange(len(ia)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        met, parts = np.zeros(len(ia), dtype=np.int64), []
        for w in np.unique(wants):
            here, to = asked[wants == w], np.flatnonzero(ring == w)
            if len(to):
                r, ids, d = _best_of(ia[here], ib[to], a[here], b[to], k, reach[here], skip_self)
                parts.append((here[r], ids, d))
                own = np.sort(ib[to])
                met[here] += len(to) - (np.searchsorted(own, ia[here], "right") - np.searchsorted(own, ia[here]) if skip_self else 0)
        r, ids, d = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, int) for i in range(3))
        order = np.lexsort((ids, d, r))
        r, ids, d = r[order], ids[order], d[order]
        kept = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, ids, d = r[kept], ids[kept], d[kept]
        ends = np.searchsorted(r, np.arange(len(ia) + 1)).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(ids, pa.int64())], ["dist", "id"]))
        return pa.table({"id": left["id"], "near": near, "compared": pa.array(met)})

    def search(x: DataFrame, again: bool) -> DataFrame:
        kind = "id long, x array<double>, chunk int, reach double, blocks array<struct<block: int, places: array<int>>>"
        asked = x.mapInArrow(blocks_of(again), kind)
        to = asked.select(F.explode("blocks.block").alias("block"), F.col("chunk").alias("chunk")).distinct()
        asked = asked.select("id", "x", "chunk", "reach", F.inline("blocks"))
        return asked.groupBy("block", "chunk").cogroup(t.join(to, "block").groupBy("block", "chunk")).applyInArrow(nearest, out)

    def best(cells: DataFrame) -> DataFrame:
        return cells.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"), F.sum("compared").alias("compared"))

    near = materialize(best(search(q.withColumn("reach", F.lit(float("inf"))), False)))
    reach = near.select("id", F.when(F.size("near") >= k, F.element_at("near", -1)["dist"]).otherwise(float("inf")).alias("reach"))
    more = search(q.join(reach, "id"), True)
    return best(near.unionByName(more)).withColumnRenamed("id", key)


def fit_lof(train: DataFrame, key: str, names: list[str], k: int = 20) -> DataFrame:
    """Per training row its k-distance and local reachability density."""
    near = materialize(knn(train, train, key, names, k, skip_self=True))
    kd = near.select(key, F.element_at("near", -1)["dist"].alias("k_distance"))
    return _density(near, kd, key).join(kd, key)


def _density(near: DataFrame, kd: DataFrame, key: str) -> DataFrame:
    """1 / mean reachability distance over a row's neighbours."""
    pairs = near.select(key, F.inline("near"))
    reach = pairs.join(kd.withColumnRenamed(key, "id"), "id").withColumn("reach", F.greatest("dist", "k_distance"))
    return reach.groupBy(key).agg((1.0 / (F.avg("reach") + 1e-10)).alias("lrd"))


def score_lof(queries: DataFrame, train: DataFrame, model: DataFrame, key: str, names: list[str], k: int = 20) -> DataFrame:
    """Minus the local outlier factor of unseen rows (lower = more anomalous)."""
    near = materialize(knn(train, queries, key, names, k))
    own = _density(near, model.select(key, "k_distance"), key)
    nb = near.select(key, F.inline("near")).join(model.select(F.col(key).alias("id"), F.col("lrd").alias("n_lrd")), "id")
    x = nb.groupBy(key).agg(F.avg("n_lrd").alias("n_lrd")).join(own, key)
    return x.select(key, (-F.col("n_lrd") / F.col("lrd")).alias("score"))


# --- robust covariance ------------------------------------------------------------------------------

def chi2_quantile(p: float, d: int) -> float:
    """Point below which a share p of a chi-squared variable with d degrees of freedom lies."""

    def share(x: float) -> float:
        a, x = d / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))

    low, high = 0.0, d + 20 * math.sqrt(2 * d) + 20
    while high - low > 1e-12 * high:
        mid = (low + high) / 2
        low, high = (mid, high) if share(mid) < p else (low, mid)
    return (low + high) / 2


def _unfolded(flat: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and covariance from the upper triangle of the products of (1, columns)."""
    m = np.zeros((d + 1, d + 1))
    m[np.triu_indices(d + 1)] = flat
    m = m + np.triu(m, 1).T
    mean = m[0, 1:] / m[0, 0]
    return m[0, 0], mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean)


def _moments(x: DataFrame, names: list[str]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance per ``start``, from sums that each batch makes and Spark adds up.

    starts x d x d numbers reach the driver. Sums are taken about the origin, so the columns
    should be standardised.
    """
    d = len(names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = b["start"].to_numpy()
            data = np.column_stack([np.ones(b.num_rows), *[b[n].to_numpy(zero_copy_only=False).astype(float) for n in names]])
            for s in np.unique(start):
                own = data[start == s]
                m = (own.T @ own)[np.triu_indices(d + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), s), pa.int32()), pa.array(np.arange(len(m)), pa.int32()), pa.array(m)], names=["start", "cell", "v"])

    found: dict[int, np.ndarray] = {}
    for s, cell, v in x.select("start", *names).mapInArrow(sums, "start int, cell int, v double").groupBy("start", "cell").agg(F.sum("v")).collect():
        found.setdefault(s, np.zeros((d + 1) * (d + 2) // 2))[cell] = v
    return {s: _unfolded(flat, d) for s, flat in found.items()}


def _log_volume(cov: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(cov)
    return float(value) if sign > 0 else -math.inf


def _concentrate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Concentration steps on a few rows: (log determinant, mean, covariance)."""
    volume = math.inf
    for _ in range(steps):
        away = x - mean
        dist = ((away @ np.linalg.pinv(cov)) * away).sum(axis=1)
        part = x[np.argsort(dist, kind="stable")[:h]]
        mean, cov = part.mean(axis=0), np.cov(part.T, bias=True).reshape(x.shape[1], -1)
        now = _log_volume(cov)
        if now >= volume - 1e-9 or now == -math.inf:
            return now, mean, cov
        volume = now
    return volume, mean, cov


def _first_shapes(x: np.ndarray, h: int, tries: int, starts: int, seed: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Best shapes of ``tries`` random starts: two steps each, the ten best to their end."""
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(tries):
        part = x[rng.choice(len(x), x.shape[1] + 1, replace=False)]
        found.append(_concentrate(x, part.mean(axis=0), np.cov(part.T, bias=True).reshape(x.shape[1], -1), h, 2))
    ended = sorted((_concentrate(x, mean, cov, h, 100) for _, mean, cov in sorted(found, key=lambda e: e[0])[:10]), key=lambda e: e[0])
    out = ended[:1]
    for e in ended[1:]:
        if len(out) < starts and e[0] > out[-1][0] + 1e-6:
            out.append(e)
    return out


def fit_mahalanobis(rows: DataFrame, key: str, names: list[str], keep: float | None = None, core: int = 1500, tries: int = 500, starts: int = 3, seed: int = 0, most_steps: int = 100):
    """Minimum covariance determinant: (mean, inverse covariance, covariance) of the most central rows.

    Starting shapes come from ``tries`` random starts on at most ``core`` rows, drawn by a hash of
    the key (the published two-level search; the bound keeps the driver's part small). The
    ``starts`` best are then concentrated on all rows: a step keeps the ``keep`` share
    (by default (n + d + 1) / 2 rows) with the smallest distances, by an exact order
    statistic, and estimates again, so the determinant cannot rise. A shape ends when its determinant
    has stopped falling or is zero, all share each pass, and the smallest wins. The covariance is
    then made consistent (median distance over the chi-squared median), and all rows within
    the 97.5 % point give the estimate returned. Rows with a null or non-finite component
    take no part; without d + 2 other rows there is no estimate and an error says so.
    """
    d = len(names)
    sound = F.forall(F.array(*[F.col(n).cast("double") for n in names]), lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    rows = materialize(rows.where(sound).select(F.col(key).alias("_key"), *[F.col(n).cast("double") for n in names]))
    n = rows.count()
    if n <= d + 1:
        raise ValueError(f"{n} rows do not determine a covariance of {d} columns")
    h = min(n, math.ceil((n + d + 1) / 2) if keep is None else max(d + 1, math.ceil(keep * n)))
    few = rows.orderBy(F.xxhash64(F.col("_key").cast("string"), F.lit(seed)), "_key").limit(max(core, d + 2)).select(*names).collect()
    first = _first_shapes(np.array([tuple(r) for r in few]), max(d + 1, math.ceil(h * len(few) / n)), tries, starts, seed)
    now, last, done = {s: (0, mean, cov) for s, (_, mean, cov) in enumerate(first)}, {s: math.inf for s in range(len(first))}, {}
    for _ in range(most_steps):
        shapes = {s: (mean, np.linalg.pinv(cov)) for s, (_, mean, cov) in now.items()}
        now = _nearest_moments(rows, names, shapes, h)
        for s, (_, mean, cov) in list(now.items()):
            volume = _log_volume(cov)
            if volume == -math.inf or volume >= last[s] - 1e-9:
                done[s] = (volume, mean, cov)
                del now[s]
            last[s] = volume
        if not now:
            break
    done.update({s: (last[s], mean, cov) for s, (_, mean, cov) in now.items()})
    _, mean, cov = min((done[s] for s in sorted(done)), key=lambda e: e[0])
    dist = _distances(rows, names, {0: (mean, np.linalg.pinv(cov))})
    middle = quantiles(dist, [], "dist", {"m": (0.5, "linear")}).first()[0]
    factor = middle / chi2_quantile(0.5, d)
    cov = cov * (factor or 1.0)
    inside = _distances(rows, names, {0: (mean, np.linalg.pinv(cov))}).where(F.col("dist") < chi2_quantile(0.975, d))
    final = _moments(inside, names)
    if final:
        _, mean, cov = final[0]
    return mean, np.linalg.pinv(cov), cov


def _distances(rows: DataFrame, names: list[str], shapes: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Each row once per start with its squared distance under that start's shape."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = np.column_stack([b[n].to_numpy(zero_copy_only=False).astype(float) for n in names])
            for s, (mean, inv) in shapes.items():
                away = data - mean
                dist = np.maximum(np.einsum("ij,jk,ik->i", away, inv, away), 0)
                yield pa.RecordBatch.from_arrays([*[b[n] for n in names], pa.array(np.full(len(data), s), pa.int32()), pa.array(dist)], names=[*names, "start", "dist"])

    return rows.select(*names).mapInArrow(measure, ", ".join(f"{n} double" for n in names) + ", start int, dist double")


def _nearest_moments(rows: DataFrame, names: list[str], shapes: dict[int, tuple[np.ndarray, np.ndarray]], h: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance per start of the ``h`` rows nearest to its shape, and of those as near as the last of them.

    The h-th distance is found exactly by the digits of its binary form, which order as distances do: each of three passes
    counts rows by the next 21 bits and adds up the products of rows that the pass before has shown to be nearer.
    Nothing is written, and only counts by digit and starts x d x d numbers reach the driver.
    """
    d = len(names)
    cells = np.triu_indices(d + 1)
    nearer = {s: np.zeros(len(cells[0])) for s in shapes}
    span = {s: (0, 0, 1 << 63) for s in shapes}  # distances from the first to the second are nearer, up to the third are open
    below = dict.fromkeys(shapes, 0.0)  # rows nearer than the open ones

    def passed(batches: Iterator[pa.RecordBatch], span: dict[int, tuple[int, int, int]], shift: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = np.column_stack([np.ones(b.num_rows), *[b[n].to_numpy(zero_copy_only=False).astype(float) for n in names]])
            made = []
            for s, (mean, inv) in shapes.items():
                away = data[:, 1:] - mean
                dist = np.einsum("ij,jk,ik->i", away, inv, away)
                key = (np.where(np.isnan(dist), np.inf, np.maximum(dist, 0)) + 0.0).view(np.uint64)
                sure, low, high = map(np.uint64, span[s])
                own = data[(key >= sure) & (key < low)]
                if len(own):
                    made.append((s, np.full(len(cells[0]), -1), np.arange(len(cells[0])), (own.T @ own)[cells]))
                there = (key >= low) & (key < high)
                digit, back, count = np.unique(key[there] >> np.uint64(shift), return_inverse=True, return_counts=True)
                if shift:
                    made.append((s, digit.astype(np.int64), np.zeros(len(digit), int), count.astype(float)))
                    continue
                own = data[there]
                for i, k in enumerate(digit):  # few: the values of 42 equal bits
                    part = own[back == i]
                    made.append((s, np.full(len(cells[0]), int(k)), np.arange(len(cells[0])), (part.T @ part)[cells]))
            for s, digit, cell, v in made:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), s), pa.int32()), pa.array(digit, pa.int64()), pa.array(cell, pa.int32()), pa.array(v)], names=["start", "digit", "cell", "v"])

    for shift in (42, 21, 0):
        now = dict(span)
        found = rows.select(*names).mapInArrow(lambda it: passed(it, now, shift), "start int, digit long, cell int, v double").groupBy("start", "digit", "cell").agg(F.sum("v").alias("v")).toArrow()
        start, digit, cell, v = (found[c].to_numpy() for c in found.column_names)
        for s in shapes:
            own = (start == s) & (digit < 0)
            nearer[s][cell[own]] += v[own]
            own = (start == s) & (digit >= 0) & (cell == 0)
            order = np.argsort(digit[own])
            digits, upto = digit[own][order], below[s] + np.cumsum(v[own][order])
            at = min(int(np.searchsorted(upto, h - 0.5)), len(digits) - 1)
            if shift:
                first = int(digits[at]) << shift
                below[s] = upto[at - 1] if at else below[s]
                # the last pass takes the next digit too, for distances equal but for rounding
                span[s] = (span[s][1], first, min(first + ((1 if shift > 21 else 2) << shift), 1 << 63))
                continue
            limit = np.uint64(digits[at]).view(np.float64) * (1 + 1e-12)
            own = (start == s) & (digit >= 0)
            own[own] = digit[own].astype(np.uint64).view(np.float64) <= limit
            np.add.at(nearer[s], cell[own], v[own])
    return {s: _unfolded(nearer[s], d) for s in shapes}


def score_mahalanobis(rows: DataFrame, names: list[str], mean: np.ndarray, inv: np.ndarray) -> DataFrame:
    """Rows with ``score`` = minus the squared distance."""
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]) - mean
            s = -np.einsum("ij,jk,ik->i", x, inv, x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, "score"])

    return rows.mapInArrow(score, schema)


# --- thresholds -----------------------------------------------------------------------------------

def threshold_quantile(scores: DataFrame, by: list[str], score: str = "score", alpha: float = 0.05) -> DataFrame:
    return quantiles(scores, by, score, {"threshold": (alpha, "linear")})


def lower_tail(scores: DataFrame, by: list[str], score: str, episode: str, alpha: float = 0.05, order: str = "row_id") -> DataFrame:
    """Order-statistic threshold sorted[floor(alpha n)] with ties, strict alerts and episodes.

    The prefix holds the k lowest rows; rows tied with the threshold enter it in ``order``,
    found with a rank over the tied rows' order values only.
    """
    scores = scores.select(*by, score, episode, order)
    v = ordered_counts(scores, by, score)
    k = F.floor(F.col("total") * F.lit(float(alpha)))
    t = v.where((F.col("below") <= k) & (k < F.col("below") + F.col("n"))).select(
        *by, F.col("v").alias("threshold"), F.col("below").alias("strict_alerts"), F.col("n").alias("ties"), k.alias("k"), F.col("total").alias("windows"))
    x = scores.join(t, by) if by else scores.join(F.broadcast(t))
    tied = x.where(F.col(score) == F.col("threshold"))
    tie_rank = ordered_counts(tied, by, order).select(*by, F.col("v").alias(order), F.col("below").alias("_tie"))
    x = x.join(tie_rank, [*by, order], "left")
    alert = F.col(score) < F.col("threshold")
    prefix = alert | ((F.col(score) == F.col("threshold")) & (F.col("_tie") < F.col("k") - F.col("strict_alerts")))
    eps = x.groupBy(*by).agg(
        F.count_distinct(F.when(alert, F.col(episode))).alias("alert_episodes"), F.count_distinct(F.when(prefix, F.col(episode))).alias("prefix_episodes"))
    return t.join(eps, by) if by else t.join(F.broadcast(eps))


def alpha_table(scores: DataFrame, alphas: list[float], score: str = "score", part: str = "partition", label: str = "label", inclusive: bool = False) -> DataFrame:
    """Threshold of each alpha on validation rows, and what it flags elsewhere."""
    val = scores.where(F.col(part) == "validation")
    wide = quantiles(val, [], score, {f"a{i}": (a, "linear") for i, a in enumerate(alphas)})
    t = wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"a{i}").alias("threshold")) for i, a in enumerate(alphas)])))
    x = scores.where(F.col(part) == "test").join(F.broadcast(t))  # one row per alpha
    hit = F.col(score) <= F.col("threshold") if inclusive else F.col(score) < F.col("threshold")
    bad = F.col(label) == "anomaly"
    return x.groupBy("alpha", "threshold").agg(F.count_if(hit & ~bad).alias("false_alerts"), F.count_if(~bad).alias("normal"), F.count_if(hit & bad).alias("detected"), F.count_if(bad).alias("anomalies"))


def detection_summary(scores: DataFrame, by: list[str], threshold: float, score: str = "score") -> DataFrame:
    x = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(score) < threshold).alias("detected"), F.round(F.min(score), 4).alias("score_min"), F.round(F.max(score), 4).alias("score_max"))
    q = quantiles(scores, by, score, {"score_median": (0.5, "linear")}).withColumn("score_median", F.round("score_median", 4))
    x = x.withColumn("rate", F.round(safe_ratio(F.col("detected"), F.col("rows")), 6))
    return x.join(q, by) if by else x.join(F.broadcast(q))


def first_alert(scored: DataFrame, starts: DataFrame, by: list[str], ts: str, threshold: float, score: str = "score") -> DataFrame:
    """First alert of each entity after its start, and the time it took."""
    x = scored.join(starts, by).where(F.col(ts) >= F.col("start_us"))
    a = x.groupBy(*by).agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col(score) < threshold).alias("alerts"), F.min(F.when(F.col(score) < threshold, F.col(ts))).alias("first_us"), F.first("start_us").alias("start_us"))
    return a.withColumn("delay_us", F.col("first_us") - F.col("start_us"))


def evaluate(scored: DataFrame, threshold: float, real_source: str, score: str = "score") -> DataFrame:
    """Locked evaluation as a long report: test FPR, detection by source class and profile, episodes."""
    hit = F.col(score) < threshold
    bad = F.col("label") == "anomaly"
    test = scored.where(~bad & (F.col("partition") == "test"))
    an = scored.where(bad)
    two = [F.count(F.lit(1)).alias("windows"), F.count_if(hit).alias("detected")]
    kind = F.when(F.col("entity_ip") == real_source, "real").otherwise("legacy")
    out = test.agg(*two).select(F.lit("test").alias("section"), F.lit("all").alias("name"), "windows", "detected")
    out = out.unionByName(an.agg(*two).select(F.lit("anomaly").alias("section"), F.lit("all").alias("name"), "windows", "detected"))
    out = out.unionByName(an.groupBy(kind.alias("name")).agg(*two).select(F.lit("source").alias("section"), "name", "windows", "detected"))
    out = out.unionByName(an.groupBy(F.col("profile").alias("name")).agg(*two).select(F.lit("profile").alias("section"), "name", "windows", "detected"))
    eps = an.agg(F.count_distinct("episode_id").alias("windows"), F.count_distinct(F.when(hit, F.col("episode_id"))).alias("detected"))
    out = out.unionByName(eps.select(F.lit("episodes").alias("section"), F.lit("all").alias("name"), "windows", "detected"))
    return out.withColumn("rate", safe_ratio(F.col("detected"), F.col("windows")))


def seed_stability(rows: DataFrame, holdout: DataFrame, key: str, names: list[str], seeds: list[int], trees: int, sample: int, alpha: float) -> DataFrame:
    """Threshold and alerts on held-out rows for several seeds."""
    parts = []
    for s in seeds:
        m = fit_iforest(rows, key, {"all": names}, trees, sample, s)
        parts.append(score_iforest(holdout, m, {"all": names}).select(key, F.lit(s).alias("seed"), F.col("score_all").alias("score"), F.col("episode_id")))
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    return lower_tail(x, ["seed"], "score", "episode_id", alpha, key)


def substitute_sensitivity(rows: DataFrame, feature: str, least: float, substitutes: list[float], score: Callable[[DataFrame], DataFrame], thresholds: dict[str, float], attackers: list[str]) -> DataFrame:
    """Verdict changes when a saturated feature is replaced, by alpha and party.

    ``score`` adds a ``score`` column; the substitutes are one exploded dimension.
    """
    top = rows.where(F.col(feature) >= least)
    base = score(top).withColumnRenamed("score", "base")
    x = base.withColumn("substitute", F.explode(F.array(*map(F.lit, substitutes)))).withColumn(feature, F.col("substitute"))
    x = score(x)
    party = F.when(F.col("entity_ip").isin(attackers), "attacker").otherwise("legitimate")
    levels = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(u).alias("threshold")) for a, u in thresholds.items()])
    y = x.select(party.alias("party"), "substitute", "base", "score", F.inline(levels))
    b, s, u = F.col("base"), F.col("score"), F.col("threshold")
    return y.groupBy("substitute", "alpha", "party").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(b < u).alias("alerts_before"), F.count_if((b >= u) & (u > s)).alias("permit_to_alert"),
        F.count_if((s >= u) & (u > b)).alias("alert_to_permit"), F.avg(s - b).alias("mean_delta"))


def reject_non_finite(scores: DataFrame, score: str = "score") -> DataFrame:
    """The scores unchanged; a NULL, NaN or infinite one fails the job."""
    bad = F.col(score).isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return scores.where(F.when(bad, F.raise_error(F.lit("non-finite score")).cast("boolean")).otherwise(F.lit(True)))
