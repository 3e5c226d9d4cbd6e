"""Building blocks: hopping windows, range joins, ordered scans, folds, quantiles.

Every ordered operator here splits a key's history into time slices, so that one
hot key is spread over many tasks: slices are solved independently and only one
small summary row per (key, slice) is carried across the slice borders.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netlens.functions.columns import ceil_bucket, idiv

SECOND = 1_000_000
MINUTE = 60 * SECOND


# --- lineage ----------------------------------------------------------------------

def scratch_path(spark: SparkSession) -> str:
    """A new folder under the shared one of the session."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="netlens-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/netlens-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate once and read it back, where several branches need it.

    The table goes to the shared folder the session names in ``spark.checkpoint.dir``, so a
    lost executor never costs the work before it. Only a session on one machine without that
    setting (tests) gets a temporary folder; on a cluster its absence is an error.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# --- hopping windows -------------------------------------------------------------

def hop(df: DataFrame, buckets: int, bucket: str = "bucket", anchor: str = "anchor") -> DataFrame:
    """Send each bucket to the anchors whose trailing window of ``buckets`` steps holds it."""
    return df.withColumn("off", F.explode(F.array(*[F.lit(i) for i in range(buckets)]))).withColumn(
        anchor, F.col(bucket) + F.col("off")
    )


def dense_grid(df: DataFrame, entity: str, ts: str, step_us: int) -> DataFrame:
    """Every anchor from an entity's first to its last instant, gaps included.

    An entity whose only instants lie on one grid point has first > last and gets none.
    """
    span = df.groupBy(entity).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    first = idiv(F.col("lo"), step_us) + 1
    last = ceil_bucket(F.col("hi"), step_us)
    return (
        span.select(entity, first.alias("first"), last.alias("last"))
        .where("first <= last")
        .select(entity, F.explode(F.sequence("first", "last")).alias("anchor"))
    )


# --- interval joins -----------------------------------------------------------------

def point_in_interval(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, lo: str, hi: str,
    how: str = "inner", width_us: int = MINUTE, lo_open: bool = False, hi_open: bool = False,
) -> DataFrame:
    """Join points with the intervals that hold them, as an equi-join on time cells.

    Intervals are listed once per cell they touch, points have exactly one cell, so a
    pair meets at most once and no nested loop is planned. Where only membership counts,
    overlapping intervals are merged first, so a point meets at most one of them.
    """
    if how in ("left_semi", "left_anti"):
        intervals = merged_intervals(intervals, keys, lo, hi, 64 * width_us)
    p = points.withColumn("_cell", idiv(F.col(point), width_us))
    r = intervals.where(F.col(lo) <= F.col(hi)).withColumn(
        "_cell", F.explode(F.sequence(idiv(F.col(lo), width_us), idiv(F.col(hi), width_us)))
    )
    left, right = p.alias("l"), r.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l._cell") == F.col("r._cell")]
    x, a, b = F.col(f"l.{point}"), F.col(f"r.{lo}"), F.col(f"r.{hi}")
    on.append(x > a if lo_open else x >= a)
    on.append(x < b if hi_open else x <= b)
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = left.join(right, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_cell")
    extra = [F.col(f"r.{c}") for c in intervals.columns if c not in keys]
    return joined.select(*[F.col(f"l.{c}") for c in points.columns], *extra)


def merged_intervals(intervals: DataFrame, keys: Sequence[str], lo: str, hi: str, slice_us: int) -> DataFrame:
    """Disjoint intervals that cover the same instants per key."""
    ks = list(keys) or ["_k"]
    x = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_k", F.lit(0)).select(*ks, lo, hi).distinct()
    x = scan(materialize(x), ks, [lo, hi], lo, slice_us, {"_reach": ("max", F.col(hi), False)})
    x = x.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(lo) > F.col("_reach")), 1).otherwise(0))
    x = scan(x, ks, [lo, hi], lo, slice_us, {"_part": ("sum", F.col("_new"), True)})
    return x.groupBy(*ks, "_part").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).select(*keys, lo, hi)


# --- ordered scans ------------------------------------------------------------------

def near_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, str],
    ts: str, tol_us: int, slice_us: int,
) -> DataFrame:
    """Previous row of the key, when it is at most ``tol_us`` older; else NULL.

    The last ``tol_us`` of each slice is copied into the next one as context.
    """
    slice_us = max(slice_us, tol_us + 1)
    home = idiv(F.col(ts), slice_us)
    near_end = F.col(ts) - home * slice_us >= slice_us - tol_us
    x = df.withColumn("_home", home).withColumn(
        "_slice", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    w = Window.partitionBy(*keys, "_slice").orderBy(*order)
    x = x.withColumn("_pts", F.lag(ts).over(w))
    for source, target in cols.items():
        if source != ts:
            x = x.withColumn(target, F.lag(source).over(w))
    near = F.col(ts) - F.col("_pts") <= tol_us
    for source, target in cols.items():
        x = x.withColumn(target, F.when(near, F.col("_pts" if source == ts else target)))
    return x.where("_home = _slice").drop("_home", "_slice", "_pts")


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, slice_us: int,
    specs: dict[str, tuple[str, Column, bool]],
) -> DataFrame:
    """Running aggregates over the whole history of a key.

    ``specs``: name -> (sum | min | max | last, expression, include the current row).
    ``last`` skips NULLs, so it is also the as-of join primitive. A slice is solved in
    its own window partition; the totals of earlier slices arrive as one joined row.
    """
    keys = list(keys)
    inputs = {f"_in_{n}": e for n, (_, e, _) in specs.items()}
    x = df.withColumn("_slice", idiv(F.col(ts), slice_us)).withColumns(inputs)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    made = {}
    totals = []
    carried = []
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, _, current) in specs.items():
        c = F.col(f"_in_{name}")
        frame = local.rowsBetween(Window.unboundedPreceding, 0 if current else -1)
        fn = {"sum": F.sum, "min": F.min, "max": F.max}.get(kind)
        if fn is None:
            made[f"_lo_{name}"] = F.last(c, ignorenulls=True).over(frame)
            at = F.when(c.isNotNull(), F.struct(*order))
            totals.append(F.max_by(c, at).alias(f"_to_{name}"))
            carried.append(F.last(f"_to_{name}", ignorenulls=True).over(before).alias(f"_ca_{name}"))
        else:
            made[f"_lo_{name}"] = fn(c).over(frame)
            totals.append(fn(c).alias(f"_to_{name}"))
            carried.append(fn(f"_to_{name}").over(before).alias(f"_ca_{name}"))
    sums = x.groupBy(*keys, "_slice").agg(*totals)
    carry = sums.select(*keys, "_slice", *carried)
    out = x.withColumns(made).join(carry, [*keys, "_slice"], "left")
    results = {}
    for name, (kind, _, _) in specs.items():
        lo, ca = F.col(f"_lo_{name}"), F.col(f"_ca_{name}")
        if kind == "sum":
            results[name] = F.coalesce(lo + ca, lo, ca)
        elif kind == "min":
            results[name] = F.least(lo, ca)
        elif kind == "max":
            results[name] = F.greatest(lo, ca)
        else:
            results[name] = F.coalesce(lo, ca)
    out = out.withColumns(results)
    return out.select(*df.columns, *specs)


def interval_totals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, lo: str, hi: str, by: Sequence[str],
    totals: dict[str, Column], slice_us: int, lo_open: bool = False, hi_open: bool = False, count: str = "n", last: str | None = None,
) -> DataFrame:
    """Whole-number sums over the points that intervals hold, per ``by``, without forming the pairs.

    The same rows as an inner :func:`point_in_interval` grouped by ``by``: ``count`` pairs, the sum of each total and, if
    named, the ``last`` point. Running sums of the points, one row an instant, are read at both ends of each interval, so the
    work grows with points and intervals and not with how many points an interval holds.
    """
    keys, by = list(keys), list(by)
    ks = keys or ["_k"]
    p = points.withColumn("_k", F.lit(0)).where(F.col(point).isNotNull()).groupBy(*ks, F.col(point).alias("_t")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(e).cast("long").alias(f"_s_{n}") for n, e in totals.items()]
    )
    a, b = F.col(lo), F.col(hi)
    held = intervals.withColumn("_k", F.lit(0)).where(a < b if lo_open and hi_open else a <= b)
    for k in ks:
        p, held = p.where(F.col(k).isNotNull()), held.where(F.col(k).isNotNull())
    # An end that counts the points of its instant is read after them, one that does not before them.
    ends = F.array(
        F.struct(a.alias("_t"), F.lit(2 if lo_open else 0).alias("_side"), F.lit(-1).alias("_sign"), a.alias("_from")),
        F.struct(b.alias("_t"), F.lit(0 if hi_open else 2).alias("_side"), F.lit(1).alias("_sign"), a.alias("_from")),
    )
    edges = held.select(*ks, F.struct(*by).alias("_by"), F.inline(ends))
    both = edges.unionByName(p.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    specs = {"_run_n": ("sum", F.col("_n"), True)} | {f"_run_{n}": ("sum", F.col(f"_s_{n}"), True) for n in totals}
    if last:
        specs["_last"] = ("max", F.when(F.col("_side") == 1, F.col("_t")), True)
    x = scan(both, ks, ["_t", "_side"], "_t", slice_us, specs).where("_sign is not null")
    inside = lambda n: F.sum(F.col("_sign") * F.coalesce(f"_run_{n}", F.lit(0)))
    reached = F.col("_last") > F.col("_from") if lo_open else F.col("_last") >= F.col("_from")
    out = x.groupBy("_by").agg(
        F.sum(F.col("_sign") * F.coalesce("_run_n", F.lit(0))).alias(count), *[inside(n).alias(n) for n in totals],
        *([F.max(F.when((F.col("_sign") == 1) & reached, F.col("_last"))).alias(last)] if last else []),
    )
    return out.where(F.col(count) > 0).select("_by.*", count, *totals, *([last] if last else []))


def previous(df, keys, order, cols: dict[str, str], ts: str, slice_us: int) -> DataFrame:
    """Previous row's values, however old it is (NULL for a key's first row).

    Values travel inside a struct so that a NULL value stays a NULL of the previous row.
    """
    packed = F.struct(*[F.col(c).alias(t) for c, t in cols.items()])
    x = scan(df, keys, order, ts, slice_us, {"_prev": ("last", packed, False)})
    return x.withColumns({t: F.col(f"_prev.{t}") for t in cols.values()}).drop("_prev")


def following(df, keys, order, cols: dict[str, str], ts: str, slice_us: int) -> DataFrame:
    """Next row's values (NULL for a key's last row): a slice's last row asks the next slice."""
    keys = list(keys)
    packed = F.struct(*[F.col(c).alias(t) for c, t in cols.items()])
    x = df.withColumn("_slice", idiv(F.col(ts), slice_us)).withColumn("_pack", packed)
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    heads = x.groupBy(*keys, "_slice").agg(F.min_by("_pack", F.struct(*order)).alias("_head"))
    nxt = heads.select(
        *keys, "_slice", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_far")
    )
    out = x.withColumn("_near", F.lead("_pack").over(local)).join(nxt, [*keys, "_slice"], "left")
    out = out.withColumn("_next", F.coalesce("_near", "_far"))
    return out.select(*df.columns, *[F.col(f"_next.{t}").alias(t) for t in cols.values()])


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
    cols: dict[str, str], slice_us: int, forward: bool = False, tie: Sequence[str] = (),
) -> DataFrame:
    """Each left row with the nearest right row at or before it (``forward``: at or after).

    Both sides are ordered together, so no pairs are formed; ``cols`` maps right columns
    to output names, NULL where there is none. ``tie`` orders right rows of one instant.
    """
    keys = list(keys)
    sign = -1 if forward else 1
    val = F.struct(*[F.col(c).alias(t) for c, t in cols.items()])
    r = right.select(*keys, (F.col(right_ts) * sign).alias("_t"), F.lit(0).alias("_side"), F.struct(F.lit(0), *tie).alias("_tie"), val.alias("_val"))
    l = left.select(*keys, (F.col(left_ts) * sign).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = l.unionByName(r, allowMissingColumns=True)
    got = scan(both, keys, ["_t", "_side", "_tie"], "_t", slice_us, {"_hit": ("last", F.col("_val"), True)})
    return got.where("_side = 1").select("_row.*", *[F.col(f"_hit.{t}").alias(t) for t in cols.values()])


def islands(df, keys, order, ts: str, gap_us: int, slice_us: int, name: str = "island") -> DataFrame:
    """Number the runs of rows whose consecutive gaps do not exceed ``gap_us``."""
    x = near_previous(df, keys, order, {ts: "_near_ts"}, ts, gap_us, slice_us)
    x = x.withColumn("_new", F.when(F.col("_near_ts").isNull(), 1).otherwise(0)).drop("_near_ts")
    return scan(x, keys, order, ts, slice_us, {name: ("sum", F.col("_new"), True)}).drop("_new")


def runs(df, keys, order, state: str, ts: str, slice_us: int, name: str = "run") -> DataFrame:
    """Number the stretches of rows that share one value of ``state`` (gap and island)."""
    x = previous(df.withColumn("_one", F.lit(1)), keys, order, {state: "_ps", "_one": "_has"}, ts, slice_us)
    start = F.when(F.col("_has").isNull() | ~F.col("_ps").eqNullSafe(F.col(state)), 1).otherwise(0)
    x = x.withColumn("_new", start).drop("_ps", "_has", "_one")
    return scan(x, keys, order, ts, slice_us, {name: ("sum", F.col("_new"), True)}).drop("_new")


# --- retained-row fold ------------------------------------------------------------------

_NONE = -1
#: A slice of a history is cut shorter where it would hold many more rows than this.
FOLD_ROWS = 1 << 16


def _fold_key(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys])


def _fold_id(order: Sequence[str]) -> Column:
    return F.concat_ws("#", *[F.col(c).cast("string") for c in order])


def _successors(t: np.ndarray, v: np.ndarray | None, gap_us: int, inclusive: bool) -> np.ndarray:
    """For each row, should it be the retained one, the row that is retained after it (``len(t)``: none).

    What follows a retained row depends on that row alone: the first later row out of its gap or, with values,
    the first that is not the same or one lower.
    """
    n = len(t)
    after = np.searchsorted(t, t + gap_us, side="right" if inclusive else "left")
    after = np.maximum(after, np.arange(1, n + 1))
    if v is not None:
        for c in np.unique(v):
            own, other = np.flatnonzero(v == c), np.flatnonzero((v != c) & (v != c - 1))
            at = np.searchsorted(other, own, side="right")
            after[own] = np.minimum(after[own], np.append(other, n)[at])
        lone = np.flatnonzero(np.isnan(v))  # without a value a row is no copy of another
        after[lone] = lone + 1
    return after


def _last_states(after: np.ndarray) -> np.ndarray:
    """For each row, should it be the retained one, the retained row at the end; leaps are doubled."""
    n = len(after)
    end = np.where(after < n, after, np.arange(n))
    while True:
        further = end[end]
        if np.array_equal(further, end):
            return end
        end = further


def retained_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, gap_us: int,
    inclusive: bool = False, value: str | None = None, slice_us: int | None = None,
) -> DataFrame:
    """Rows dropped because they repeat the *retained* row of their key: (fold_key, fold_id).

    The rule is sequential: a row is compared with the last kept one, not with its
    neighbour. With ``value`` (a TTL) copies may differ by one and the higher value wins,
    otherwise the first wins. Three passes keep it exact and parallel for a hot key:
    each slice is folded from every entry state it can meet (the retained row can only be
    one of the last ``gap_us`` of the slice before; entries in a row with one outcome are one),
    the slices are chained through that table, and each slice is folded once more
    from its now known entry. What follows a retained row is found by search and leaps are doubled, so
    the work of a slice does not depend on how many rows a gap holds. Slices are at most ``slice_us``
    (4096 gaps) long, shorter where rows are dense, and never under two gaps.
    """
    order = list(order)
    slice_us = max(slice_us or 4096 * gap_us, 2 * gap_us, 1)
    swap = value is not None
    base = df.select(
        _fold_key(keys).alias("fold_key"), F.col(ts).alias("t"), F.struct(*order).alias("ord"),
        (F.col(value) if swap else F.lit(0)).cast("long").alias("v"),
    )
    base = materialize(base)
    held = base.groupBy("fold_key", idiv(F.col("t"), slice_us).alias("s")).agg(F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t") + 1).alias("span"))
    room = held.where(F.col("n") > FOLD_ROWS).agg(F.min(F.col("span") / F.col("n") * FOLD_ROWS)).first()[0]
    if room is not None:
        slice_us = max(min(slice_us, int(room)), 2 * gap_us, 1)
    # Only rows with a neighbour within the gap can be copies or have copies.
    w_cols = {"t": "p"}
    x = near_previous(base, ["fold_key"], ["ord"], w_cols, "t", gap_us, slice_us)
    x = x.withColumn("head", F.col("p").isNull())
    x = following(x, ["fold_key"], ["ord"], {"head": "next_head"}, "t", slice_us)
    sort_cols = [f"o{i}" for i in range(len(order))]
    contested = x.where(~F.col("head") | (F.col("next_head") == F.lit(False))).select(
        "fold_key", "t", "v", *[F.col(f"ord.{c}").alias(o) for o, c in zip(sort_cols, order)]
    )
    contested = materialize(contested)
    home = idiv(F.col("t"), slice_us)
    near_end = F.col("t") - home * slice_us >= slice_us - gap_us
    sliced = contested.withColumn("slice", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))))

    def prepare(table: pa.Table):
        table = table.sort_by([(c, "ascending") for c in sort_cols])
        here = table["slice"][0].as_py()
        t = table["t"].to_numpy()
        after = _successors(t, table["v"].to_numpy() if swap else None, gap_us, inclusive)
        return table, here, int(np.searchsorted(t, here * slice_us)), t, after

    def transitions(table: pa.Table) -> pa.Table:
        table, here, n_halo, t, after = prepare(table)
        border = int(np.searchsorted(t, (here + 1) * slice_us - gap_us))
        entry = np.arange(-1, n_halo)
        leave = np.full(len(entry), _NONE)
        if n_halo < len(t):
            end = _last_states(after)
            state = np.append(end[n_halo], end[:n_halo])  # entered with none, or with a row of the halo
            leave = np.where(state >= border, state - border, _NONE)
        new = np.append([True, True][: len(entry)], leave[2:] != leave[1:-1])
        key = table["fold_key"][0].as_py()
        return pa.table({
            "fold_key": pa.array([key] * int(new.sum()), pa.string()), "slice": pa.array(np.full(int(new.sum()), here), pa.int64()),
            "entry": pa.array(entry[new], pa.int64()), "leave": pa.array(leave[new], pa.int64()),
        })

    trans = sliced.groupBy("fold_key", "slice").applyInArrow(transitions, "fold_key string, slice long, entry long, leave long")

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by([("slice", "ascending"), ("entry", "ascending")])
        s, e, o = (table[c].to_numpy() for c in ("slice", "entry", "leave"))
        slices, begins = np.unique(s, return_index=True)
        ends = np.append(begins[1:], len(s))
        state, last, entries = _NONE, None, []
        for at, lo, hi in zip(slices.tolist(), begins.tolist(), ends.tolist()):
            entry = state if last == at - 1 else _NONE
            entries.append(entry)
            state, last = int(o[lo + int(np.searchsorted(e[lo:hi], entry, side="right")) - 1]), at
        return pa.table({
            "fold_key": pa.array([table["fold_key"][0].as_py()] * len(slices), pa.string()),
            "slice": pa.array(slices, pa.int64()), "entry": pa.array(entries, pa.int64()),
        })

    entries = trans.groupBy("fold_key").applyInArrow(chain, "fold_key string, slice long, entry long")

    def drops(table: pa.Table) -> pa.Table:
        table, _, n_halo, _, after = prepare(table)
        n, entry = len(after), table["entry"][0].as_py()
        at = entry if entry != _NONE else n_halo
        kept, follow = np.zeros(n + 1, dtype=bool), after.tolist()
        while at < n:
            kept[at] = True
            at = follow[at]
        gone = ~kept[:n]
        if swap:  # a retained row goes too if a higher copy within its gap takes its place
            t, v, own = table["t"].to_numpy(), table["v"].to_numpy(), np.flatnonzero(kept[:n])
            a, b = own[:-1], own[1:]
            dt = t[b] - t[a]
            taken = ((dt <= gap_us) if inclusive else (dt < gap_us)) & (abs(v[b] - v[a]) <= 1)
            # a halo row that goes is named here, as the row that takes its place is of this slice
            gone[a[taken]] = True
        halo = np.arange(n) < n_halo
        if entry != _NONE:
            halo[entry] = False  # it is kept, or replaced by a row of this slice
        return table.filter(pa.array(gone & ~halo)).select(["fold_key", *sort_cols])

    types = dict(contested.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ["fold_key", *sort_cols])
    out = sliced.join(entries, ["fold_key", "slice"]).groupBy("fold_key", "slice").applyInArrow(drops, schema)
    return out.select("fold_key", _fold_id(sort_cols).alias("fold_id"))


def drop_repeats(df, keys, order, ts, gap_us, inclusive=False, value=None, slice_us=None) -> DataFrame:
    """``df`` without the rows that :func:`retained_fold` names; rows of other keys at the same place in the order stay."""
    gone = retained_fold(df, keys, order, ts, gap_us, inclusive, value, slice_us).select("fold_key", "fold_id")
    named = df.withColumns({"fold_key": _fold_key(keys), "fold_id": _fold_id(order)})
    return named.join(gone, ["fold_key", "fold_id"], "left_anti").drop("fold_key", "fold_id")


# --- exact order statistics -------------------------------------------------------------

def ordered_counts(
    df: DataFrame, keys: Sequence[str], value: str, buckets: int = 64, weights: dict[str, Column] | None = None
) -> DataFrame:
    """Distinct values with their exact rank range [below, below+n) and the total per key.

    Equal values collapse before the ranking, and values are ranked inside cells cut at
    approximate quantiles, so neither a heavy tie nor one large key lands in one task.
    Each weight adds its sum at the value (``w``) and over the smaller values (``w_below``).
    """
    keys, weights = list(keys), weights or {}
    src = df.where(F.col(value).isNotNull()).withColumns({f"_w_{w}": e for w, e in weights.items()})
    if not keys:
        src = src.withColumn("_all", F.lit(0))
    ks = keys or ["_all"]
    sums = ["n", *weights]
    vc = src.groupBy(*ks, F.col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"_w_{w}").alias(w) for w in weights]
    )
    ps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = vc.groupBy(*ks).agg(F.percentile_approx("v", ps, F.lit(10000)).alias("cuts"))
    x = vc.join(cuts if keys else F.broadcast(cuts), ks)  # without keys: one row
    x = x.withColumn("_b", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    inner = Window.partitionBy(*ks, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    tot = x.groupBy(*ks, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    outer = Window.partitionBy(*ks)
    before = outer.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(
        *ks, "_b", F.sum("_t_n").over(outer).alias("total"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_base_{c}") for c in sums],
    )
    out = x.withColumns({f"_cum_{c}": F.sum(c).over(inner) for c in sums}).join(tot, [*ks, "_b"])
    below = lambda c: F.col(f"_base_{c}") + F.col(f"_cum_{c}") - F.col(c)
    return out.select(
        *keys, "v", "n", below("n").alias("below"), "total",
        *[y for w in weights for y in (F.col(w), below(w).alias(f"{w}_below"))],
    )


def _position(p: float, method: str) -> Column:
    n = F.col("total")
    last = n - 1
    if method == "linear":
        return last * F.lit(float(p))
    if method == "trunc":
        return F.floor(last * F.lit(float(p))).cast("double")
    if method == "round":
        return F.bround(last * F.lit(float(p)), 0).cast("double")
    if method == "half":
        return idiv(n, 2).cast("double")
    if method == "share":
        return F.greatest(F.floor(n * F.lit(float(p))) - 1, F.lit(0)).cast("double")
    if method == "count":  # order statistic floor(p*n), kept inside the list
        return F.least(F.floor(n * F.lit(float(p))), last).cast("double")
    raise ValueError(f"unknown quantile method {method!r}")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, tuple[float, str]], buckets: int = 64
) -> DataFrame:
    """Exact quantiles per key: name -> (p, linear | trunc | round | half | share | count)."""
    x = ordered_counts(df, keys, value, buckets)
    aggs = []
    for name, (p, method) in wanted.items():
        pos = _position(p, method)
        lo, hi = F.floor(pos), F.ceil(pos)
        def at(i):
            return F.max(F.when((F.col("below") <= i) & (i < F.col("below") + F.col("n")), F.col("v").cast("double")))
        aggs += [at(lo).alias(f"_a_{name}"), at(hi).alias(f"_b_{name}"), F.max(pos - lo).alias(f"_f_{name}")]
    out = x.groupBy(*keys).agg(*aggs)
    cols = [
        (F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n) for n in wanted
    ]
    return out.select(*keys, *cols)


# --- long and wide ----------------------------------------------------------------------

def to_long(df: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per (row, column): feature, value."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*ids, F.inline(pairs))


