"""Capture and processing quality. NULL means not measured and never turns into false or 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from netlens.functions.columns import idiv, tri_and
from netlens.operators.core import SECOND, asof, following, interval_totals, materialize, previous, quantiles, scan

MEASURED = ("cero_explicito", "descartes")
K_CRITERIA = ("K1", "K2", "K3", "K4a", "K5")


def _yes(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


# --- counters --------------------------------------------------------------------------

def increments(samples: DataFrame, slice_us: int) -> DataFrame:
    """Difference of each sample with the one before: ok, restart, missing or same instant.

    samples: component, sample_id, ts_us, pid, uptime_s, packets, drops.
    """
    cols = {"ts_us": "from_us", "pid": "pid0", "uptime_s": "up0", "packets": "p0", "drops": "d0"}
    x = previous(samples, ["component"], ["ts_us", "sample_id"], cols, "ts_us", slice_us).where("from_us is not null")
    c = F.col
    missing = reduce(lambda a, b: a | b, [c(n).isNull() for n in ("uptime_s", "packets", "drops", "up0", "p0", "d0")])
    restart = (c("pid") != c("pid0")) | (c("uptime_s") < c("up0")) | (c("packets") < c("p0")) | (c("drops") < c("d0"))
    state = F.when(missing, "missing").when(restart, "restart").when(c("ts_us") == c("from_us"), "same").otherwise("ok")
    x = x.withColumn("state", state)
    ok = c("state") == "ok"
    return x.withColumns({"d_packets": F.when(ok, c("packets") - c("p0")), "d_drops": F.when(ok, c("drops") - c("d0"))})


def _between(
    rows: DataFrame, periods: DataFrame, edge_us: int, whole: dict[str, Column], inner: dict[str, Column], ends: list[str], slice_us: int, pids: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Periods with the last sample at most ``edge_us`` before and the first after them, and sums per period_id between the two.

    rows: samples with ``x_us``, the instant of the sample before. ``whole`` sums over all samples from a_us to b_us, ``inner``
    over those whose sample before is one of them too, ``ends`` is how much a value grows from the first to the last, ``pids``
    tells 0, 1 and several processes (2) apart. Samples collapse to instants with running sums, and a period reads them at its
    two bounds, so the work does not grow with how many samples a period holds.
    """
    c = F.col
    order = F.struct("ts_us", "sample_id")
    x = rows.where("ts_us is not null")
    if pids:  # a change belongs to the later of two processes that follow each other
        x = scan(x, ["component"], ["ts_us", "sample_id"], "ts_us", slice_us, {"_pid0": ("last", c("pid"), False)})
        x = x.withColumn("_change", F.coalesce(c("pid") != c("_pid0"), F.lit(False)).cast("long"))
    new = c("x_us").isNull() | (c("x_us") < c("ts_us"))  # an instant's first sample
    sums = whole | inner | ({"_known": c("pid").isNotNull().cast("long"), "_changes": c("_change")} if pids else {})
    first = [F.min_by(v, order).alias(f"_first_{v}") for v in ends]
    if pids:
        named = F.when(c("pid").isNotNull(), order)
        first += [F.min_by("_change", named).alias("_turn"), F.max_by("pid", named).alias("_pid")]
    at = x.groupBy("component", "ts_us").agg(
        *[F.coalesce(F.sum(e), F.lit(0)).cast("long").alias(f"_n_{n}") for n, e in sums.items()],
        *[F.coalesce(F.sum(F.when(new, e)), F.lit(0)).cast("long").alias(f"_new_{n}") for n, e in inner.items()],
        *first, *[F.max_by(v, order).alias(f"_last_{v}") for v in ends],
    )
    specs = {f"_run_{n}": ("sum", c(f"_n_{n}"), True) for n in sums}
    if pids:
        specs["_pid_here"] = ("last", c("_pid"), True)
    at = scan(at, ["component"], ["ts_us"], "ts_us", slice_us, specs)
    if pids:  # does the first known process from here on differ from the one before it?
        at = scan(at.withColumn("_back", -c("ts_us")), ["component"], ["_back"], "_back", slice_us, {"_turns": ("last", c("_turn"), True)})
    before = {n: c(f"_run_{n}") - c(f"_n_{n}") + (c(f"_new_{n}") if n in inner else F.lit(0)) for n in sums}
    at = materialize(at.select(
        "component", "ts_us",
        F.struct(F.lit(0).alias("_"), *[e.alias(n) for n, e in before.items()], *[c(f"_first_{v}").alias(v) for v in ends], *([c("_turns")] if pids else [])).alias("_a"),
        F.struct(F.lit(0).alias("_"), *[c(f"_run_{n}").alias(n) for n in sums], *[c(f"_last_{v}").alias(v) for v in ends], *([c("_pid_here")] if pids else [])).alias("_b"),
    ))
    p = asof(periods, at, ["component"], "t0_us", "ts_us", {"ts_us": "a_us", "_a": "_a"}, slice_us)
    p = asof(p, at, ["component"], "t1_us", "ts_us", {"ts_us": "b_us", "_b": "_b"}, slice_us, forward=True)
    far = lambda n, d: F.when(d <= edge_us, c(n))
    p = materialize(p.withColumns({"a_us": far("a_us", c("t0_us") - c("a_us")), "b_us": far("b_us", c("b_us") - c("t1_us"))}))
    both = p.where("component is not null and a_us <= b_us")
    inside = lambda n: c(f"_b.{n}") - c(f"_a.{n}")
    aggs = [F.sum(inside(n)).alias(n) for n in [*whole, *inner]]
    aggs += [(F.max_by(f"_b.{v}", "b_us") - F.min_by(f"_a.{v}", "a_us")).alias(f"d_{v}") for v in ends]
    if pids:
        known = inside("_known") > 0
        several = known & (inside("_changes") - F.coalesce("_a._turns", F.lit(0)) > 0)
        pid = F.when(known, c("_b._pid_here"))
        aggs.append(F.when(F.max(several) | (F.min(pid) != F.max(pid)), 2).when(F.max(pid).isNotNull(), 1).otherwise(0).alias("pids"))
    return p.drop("_a", "_b"), both.groupBy("period_id").agg(*aggs)


def measure_drops(samples: DataFrame, periods: DataFrame, now_us: int, edge_us: int, gap_us: int, tol_s: float, slice_us: int) -> DataFrame:
    """State of the drop measurement of each period, with packets and drops when it is one.

    cero_explicito, descartes, ausente, desactualizada, error_lectura, cobertura_insuficiente.
    periods: period_id, component, t0_us, t1_us.
    """
    c = F.col
    cols = {"ts_us": "x_us", "uptime_s": "xu", "packets": "xp", "drops": "xd"}
    pairs = previous(samples, ["component"], ["ts_us", "sample_id"], cols, "ts_us", slice_us)
    start = lambda t, u: c(t) / SECOND - c(u)
    same = (F.abs(start("ts_us", "uptime_s") - start("x_us", "xu")) <= tol_s) & (c("uptime_s") >= c("xu"))
    frozen = (c("uptime_s") == c("xu")) & (c("ts_us") - c("x_us") > tol_s * SECOND)
    near = F.abs(start("ts_us", "uptime_s") - start("x_us", "xu")) <= tol_s
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("long")
    p, agg = _between(
        pairs, periods, edge_us, {"missing": flag(c("packets").isNull() | c("drops").isNull() | c("uptime_s").isNull())},
        {"frozen": flag(frozen), "restarts": flag(~frozen & ~same), "falls": flag(~frozen & same & ((c("drops") < c("xd")) | (c("packets") < c("xp")))),
         "gaps": flag(c("ts_us") - c("x_us") > gap_us), "partial_drops": F.when(near & (c("drops") > c("xd")), c("drops") - c("xd"))},
        ["packets", "drops"], slice_us)
    last = samples.groupBy("component").agg(F.max("ts_us").alias("last_us"))
    y = p.join(agg, "period_id", "left").join(last, "component", "left")
    state = (
        F.when(c("last_us").isNull(), "ausente")
        .when(c("b_us").isNull() & (c("last_us") < c("t1_us")) & (F.lit(now_us) - c("last_us") > gap_us), "desactualizada")
        .when(c("a_us").isNull() | c("b_us").isNull(), "cobertura_insuficiente").when(c("falls") > 0, "error_lectura").when(c("missing") > 0, "ausente")
        .when(c("frozen") > 0, "desactualizada").when((c("restarts") > 0) | (c("gaps") > 0), "cobertura_insuficiente").when(c("d_drops") > 0, "descartes").otherwise("cero_explicito")
    )
    y = y.withColumn("state", state)
    ok = c("state").isin(*MEASURED)
    return y.select("period_id", "component", "t0_us", "t1_us", "state", F.when(ok, c("d_packets")).alias("packets"), F.when(ok, c("d_drops")).alias("drops"), F.coalesce("partial_drops", F.lit(0)).alias("partial_drops"))


def precondition(samples: DataFrame, now_us: int, window_us: int, edge_us: int, gap_us: int, tol_s: float, slice_us: int) -> DataFrame:
    """No drops in the window before the last sample? cumple, no_cumple or no_demostrable."""
    last = samples.groupBy("component").agg(F.max("ts_us").alias("t1_us"))
    p = last.select(F.col("component").alias("period_id"), "component", (F.col("t1_us") - window_us).alias("t0_us"), "t1_us")
    m = measure_drops(samples, p, now_us, edge_us, gap_us, tol_s, slice_us)
    m = m.withColumn("state", F.when(F.lit(now_us) - F.col("t1_us") > gap_us, "desactualizada").otherwise(F.col("state")))
    out = F.when(F.col("state") == "cero_explicito", "cumple").when((F.col("state") == "descartes") | (F.col("partial_drops") > 0), "no_cumple").otherwise("no_demostrable")
    return m.select("component", "state", "partial_drops", out.alias("verdict"))


def reading_coverage(readings: DataFrame, periods: DataFrame, limit_us: int, slice_us: int) -> DataFrame:
    """Do the readings of one process prove its drops in the period?

    Bounds and gaps within the limit, one pid, valid and never decreasing counters.
    """
    c = F.col
    pairs = previous(readings, ["component"], ["ts_us", "sample_id"], {"ts_us": "x_us", "packets": "xp", "drops": "xd"}, "ts_us", slice_us)
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("long")
    p, agg = _between(
        pairs, periods, 10**15, {"invalid": flag(c("packets").isNull() | c("drops").isNull() | (c("packets") < 0))},
        {"gaps": flag(c("ts_us") - c("x_us") > limit_us), "falls": flag((c("packets") < c("xp")) | (c("drops") < c("xd")))}, ["drops"], slice_us, pids=True)
    y = p.join(agg, "period_id", "left")
    bounds = c("a_us").isNull() | c("b_us").isNull()
    reasons = F.array_compact(F.array(
        F.when(bounds, "not bounded"), F.when(c("t0_us") - c("a_us") > limit_us, "start bound too old"), F.when(c("b_us") - c("t1_us") > limit_us, "end bound too late"),
        F.when(c("pids") > 1, "several pids"), F.when(c("gaps") > 0, "gap between readings"), F.when(c("invalid") > 0, "invalid counters"),
        F.when((c("invalid") == 0) & (c("pids") == 1) & (c("falls") > 0), "counter decreases")))
    y = y.withColumn("reasons", reasons)
    ok = F.size("reasons") == 0
    return y.select("period_id", "component", "reasons", ok.alias("ok"), F.when(ok, c("d_drops")).alias("kernel_drops"))


def classify_period(measured: DataFrame, coverage: DataFrame, incs: DataFrame, gap_us: int, width_us: int) -> DataFrame:
    """C0 (clean), C1 (sensor drops), C2 (capture drops), C3 (not evaluable), with motives."""
    c = F.col
    p = measured.select("component", "period_id", "t0_us", "t1_us")
    agg = interval_totals(
        incs, p, ["component"], "ts_us", "t0_us", "t1_us", ["period_id"],
        {"restarts": (c("state") == "restart").cast("long"), "gaps": F.coalesce(c("ts_us") - c("from_us") > gap_us, F.lit(False)).cast("long")}, width_us)
    y = measured.join(agg, "period_id", "left").join(coverage.select("period_id", "ok", "kernel_drops"), "period_id", "left")
    c3 = F.array_compact(F.array(
        F.when(c("gaps") > 0, "stretch without samples"), F.when(c("restarts") > 0, "restart"), F.when(~c("state").isin(*MEASURED), F.concat(F.lit("sensor "), c("state"))),
        F.when(~F.coalesce("ok", F.lit(False)), "readings incomplete")))
    c2 = F.array_compact(F.array(F.when(c("ok") & (c("kernel_drops") > 0), "capture drops")))
    c1 = F.array_compact(F.array(F.when(c("state") == "descartes", "sensor drops")))
    y = y.withColumns({"_3": c3, "_2": c2, "_1": c1})
    cls = F.when(F.size("_3") > 0, "C3").when(F.size("_2") > 0, "C2").when(F.size("_1") > 0, "C1").otherwise("C0")
    return y.select("period_id", "component", cls.alias("period_class"), F.array_join(F.concat("_3", "_2", "_1"), "; ").alias("motives"))


def segments(samples: DataFrame, slice_us: int) -> DataFrame:
    """Counter totals per process lifetime (a new one where uptime or a counter falls)."""

    ok = samples.where("packets is not null and drops is not null and uptime_s is not null")
    x = previous(ok, ["component"], ["ts_us", "sample_id"], {"uptime_s": "u0", "packets": "p0", "drops": "d0"}, "ts_us", slice_us)
    c = F.col
    new = (c("uptime_s") < c("u0")) | (c("packets") < c("p0")) | (c("drops") < c("d0"))
    x = scan(x.withColumn("_new", F.when(new, 1).otherwise(0)), ["component"], ["ts_us", "sample_id"], "ts_us", slice_us, {"segment": ("sum", c("_new"), True)})
    g = x.groupBy("component", "segment").agg(
        F.min("ts_us").alias("from_us"), F.max("ts_us").alias("to_us"), (F.max_by("packets", F.struct("ts_us", "sample_id")) - F.min_by("packets", F.struct("ts_us", "sample_id"))).alias("packets"),
        (F.max_by("drops", F.struct("ts_us", "sample_id")) - F.min_by("drops", F.struct("ts_us", "sample_id"))).alias("drops"))
    return g.withColumn("drops_per_million", F.round(F.try_divide(c("drops") * 1e6, c("packets").cast("double")), 3))


def drop_intensity(incs: DataFrame, burst_packets: int) -> DataFrame:
    """Per component: packets per interval, bursts, drops per million, restarts."""
    ok = incs.where("state in ('ok', 'same')")
    q = quantiles(ok.where("state = 'ok'"), ["component"], "d_packets", {"p50": (0.5, "trunc"), "p95": (0.95, "trunc")})
    dt = F.col("ts_us") - F.col("from_us")
    n = incs.groupBy("component").agg(
        F.count_if(F.col("state") == "ok").alias("intervals"), F.count_if(F.col("state") == "restart").alias("restarts"), F.sum("d_packets").alias("packets"), F.sum("d_drops").alias("drops"),
        F.max("d_packets").alias("max_packets"), F.count_if(F.col("d_packets") >= burst_packets).alias("bursts"), F.count_if(F.col("d_drops") > 0).alias("intervals_with_drops"),
        F.max(F.try_divide(F.col("d_packets").cast("double"), dt / SECOND)).alias("max_rate"))
    n = n.withColumn("drops_per_million", F.round(F.try_divide(F.col("drops") * 1e6, F.col("packets").cast("double")), 3))
    return n.join(q, "component", "left")


# --- files and deliveries -----------------------------------------------------------------

def _tri(bad: Column, unknown: Column) -> Column:
    return F.when(unknown, F.lit(None).cast("boolean")).when(bad, F.lit(False)).otherwise(F.lit(True))


def file_chain(files: DataFrame, t0_us: int, t1_us: int, jump_us: int, retention_us: int, slice_us: int) -> DataFrame:
    """Is the chain of capture files over [t0, t1) complete? Tri-state readable and continuous.

    files: component, file, start_us, records, error, read_us. The chain runs from the last
    start at or before t0 to the first at or after t1.
    """
    c = F.col
    one = files.groupBy("component", "file").agg(F.min("start_us").alias("start_us"), F.min("records").alias("records"), F.min("error").alias("error"), F.min("read_us").alias("read_us"), F.count_distinct(F.coalesce("records", F.lit(-1)), F.coalesce("error", F.lit(""))).alias("versions"))
    w = one.groupBy("component").agg(F.max(F.when(c("start_us") <= t0_us, c("start_us"))).alias("lo_us"), F.min(F.when(c("start_us") >= t1_us, c("start_us"))).alias("hi_us"))
    chain = one.join(w, "component").where((c("start_us") >= F.coalesce("lo_us", F.lit(t0_us))) & (c("start_us") <= F.coalesce("hi_us", F.lit(2**62))))
    chain = following(chain, ["component"], ["start_us", "file"], {"start_us": "next_us"}, "start_us", slice_us)
    inside = c("start_us") < t1_us
    fmt = c("error").isNotNull() & ~c("error").startswith("read")
    agg = chain.groupBy("component").agg(
        F.count(F.lit(1)).alias("files_chain"), F.count_if(inside).alias("files_inside"), F.count_if(c("next_us") - c("start_us") > jump_us).alias("jumps"), F.max(c("next_us") - c("start_us")).alias("max_jump_us"),
        F.count_if(inside & fmt).alias("format_errors"), F.count_if(c("error").startswith("read") | (c("error").isNull() & c("records").isNull())).alias("unchecked"),
        F.count_if(inside & c("error").isNull() & (c("records") == 0)).alias("empty"), F.sum(F.when(inside, c("records"))).alias("records"))
    # Passes of the reader: the first soon enough, none too far apart, the last past the end.
    passes = one.where("read_us is not null").select("component", "read_us").distinct()
    passes = previous(passes, ["component"], ["read_us"], {"read_us": "r0"}, "read_us", slice_us)
    limit = retention_us - jump_us
    rd = passes.groupBy("component").agg(F.min("read_us").alias("r_first"), F.max("read_us").alias("r_last"), F.max(c("read_us") - c("r0")).alias("r_gap"))
    ver = one.groupBy("component").agg(F.count_if(c("versions") > 1).alias("conflicts"))
    y = w.join(agg, "component", "left").join(rd, "component", "left").join(ver, "component", "left")
    partial = c("r_first").isNull() | (c("r_first") > t0_us + limit) | F.coalesce(c("r_gap") > limit, F.lit(False)) | (c("r_last") < t1_us + 2 * jump_us)
    y = y.withColumn("reading_complete", ~partial)
    contradiction = c("conflicts") > 0
    readable = F.when(contradiction, F.lit(None).cast("boolean")).when(c("format_errors") > 0, F.lit(False)).when(partial | (c("unchecked") > 0) | (c("files_inside") == 0), F.lit(None).cast("boolean")).otherwise(F.lit(True))
    broken = c("lo_us").isNull() | c("hi_us").isNull() | (c("jumps") > 0) | (c("empty") > 0)
    continuous = F.when(contradiction | partial | (c("unchecked") > 0), F.lit(None).cast("boolean")).otherwise(~broken)
    return y.select("component", "files_chain", "files_inside", "jumps", "max_jump_us", "format_errors", "unchecked", "empty", "records", "conflicts", "reading_complete", readable.alias("readable"), continuous.alias("continuous"))


def sequence_check(deliveries: DataFrame, receptions: DataFrame, publications: DataFrame, slice_us: int) -> DataFrame:
    """Delivered feeds accepted, accepted in strict order, publisher never back: tri-state each.

    All by target. deliveries: seq. receptions: seq, state, ts_us. publications: seq (NULL = failed read), ts_us.
    """
    c = F.col
    acc = receptions.where("state = 'aceptado'")
    d = deliveries.groupBy("target").agg(F.count(F.lit(1)).alias("n_del"), F.count_if(c("seq").isNull()).alias("no_seq"))
    lost = deliveries.where("seq is not null").select("target", "seq").distinct().join(acc.select("target", "seq").distinct(), ["target", "seq"], "left_anti").groupBy("target").agg(F.count(F.lit(1)).alias("not_accepted"))
    a = previous(acc, ["target"], ["ts_us", "rec_id"], {"seq": "s0"}, "ts_us", slice_us).groupBy("target").agg(F.count(F.lit(1)).alias("n_acc"), _yes(c("seq") <= c("s0")).alias("disorder"), F.count_if(c("seq").isNull()).alias("acc_no_seq"))
    good = publications.where("seq is not null")
    p = previous(good, ["target"], ["ts_us", "rec_id"], {"seq": "s0"}, "ts_us", slice_us).groupBy("target").agg(F.count(F.lit(1)).alias("n_pub"), _yes(c("seq") < c("s0")).alias("regress"))
    f = publications.groupBy("target").agg(F.count_if(c("seq").isNull()).alias("failed"))
    x = d.join(lost, "target", "left").join(a, "target", "full_outer").join(p, "target", "full_outer").join(f, "target", "full_outer").na.fill(0)
    null = F.lit(None).cast("boolean")
    delivered = F.when((c("n_del") == 0) | (c("no_seq") > 0), null).when(c("not_accepted") > 0, F.lit(False)).otherwise(F.lit(True))
    ordered = F.when(c("disorder") > 0, F.lit(False)).when((c("acc_no_seq") > 0) | (c("n_acc") < 2), null).otherwise(F.lit(True))
    forward = F.when(c("regress") > 0, F.lit(False)).when((c("n_pub") < 2) | (c("failed") > 0), null).otherwise(F.lit(True))
    x = x.withColumns({"delivered_accepted": delivered, "accepted_in_order": ordered, "publisher_forward": forward})
    return x.select("target", "n_del", "not_accepted", "disorder", "regress", "failed", "delivered_accepted", "accepted_in_order", "publisher_forward",
                    tri_and([c("delivered_accepted"), c("accepted_in_order"), c("publisher_forward")]).alias("verdict"))


def polled_checks(samples: DataFrame, t0_us: int, t1_us: int, margin_us: int, min_free: float, slice_us: int) -> DataFrame:
    """Polled host criteria over [t0, t1]: same process, free disk, constant rules, nothing applied.

    samples: component, sample_id, ts_us, pid, active, free, ruleset, applied. Without readings
    at most ``margin_us`` apart that cover the period nothing is known.
    """
    c = F.col
    s = samples.where(c("ts_us").between(t0_us - margin_us, t1_us + margin_us))
    s = previous(s, ["component"], ["ts_us", "sample_id"], {"ts_us": "x_us"}, "ts_us", slice_us)
    ins = c("ts_us").between(t0_us, t1_us)
    x = s.groupBy("component").agg(
        F.count_if(ins).alias("inside"), (F.lit(t0_us) - F.max(F.when(c("ts_us") <= t0_us, c("ts_us")))).alias("before"), (F.min(F.when(c("ts_us") >= t1_us, c("ts_us"))) - t1_us).alias("after"),
        F.max(c("ts_us") - c("x_us")).alias("gap"), F.count_distinct("pid").alias("pids"), F.count_if(~c("active")).alias("inactive"), F.count_if(c("pid").isNull() | c("active").isNull()).alias("no_proc"),
        F.min(F.when(ins, c("free"))).alias("free_min"), F.count_if(ins & c("free").isNull()).alias("no_free"), F.count_distinct("ruleset").alias("rulesets"), F.count_if(c("ruleset").isNull() | c("applied").isNull()).alias("no_rules"),
        (F.max_by("applied", F.struct("ts_us", "sample_id")) - F.min_by("applied", F.struct("ts_us", "sample_id"))).alias("new_applied"))
    covered = (c("inside") > 0) & (c("before") <= margin_us) & (c("after") <= margin_us) & (F.coalesce("gap", F.lit(0)) <= margin_us)
    x = x.withColumn("covered", F.coalesce(covered, F.lit(False)))
    no = ~c("covered")
    return x.select("component", "covered",
                    _tri((c("pids") > 1) | (c("inactive") > 0), no | (c("no_proc") > 0)).alias("same_process"), _tri(c("free_min") < min_free, no | (c("no_free") > 0) | c("free_min").isNull()).alias("disk_free"),
                    _tri((c("rulesets") != 1) | (c("new_applied") != 0), no | (c("no_rules") > 0) | c("new_applied").isNull()).alias("rules_constant"))


# --- saturation -------------------------------------------------------------------------------

def saturation(samples: DataFrame, limits: dict[str, float], pressure: float, pair_max_us: int, slice_us: int) -> DataFrame:
    """Per component and pair of samples: is each resource saturated? NULL where unreadable.

    samples: component, sample_id, ts_us, pid, and cumulative busy_us, total_us, thread_us,
    softirq_us, disk_us, psi_cpu_us, psi_io_us, psi_mem_us.
    """
    names = ["pid", "busy_us", "total_us", "thread_us", "softirq_us", "disk_us", "psi_cpu_us", "psi_io_us", "psi_mem_us"]
    x = previous(samples, ["component"], ["ts_us", "sample_id"], {"ts_us": "x_us", **{n: f"x_{n}" for n in names}}, "ts_us", slice_us).where("x_us is not null")
    c = F.col
    dt = c("ts_us") - c("x_us")
    d = lambda n: F.when(c(n) >= c(f"x_{n}"), c(n) - c(f"x_{n}"))
    pct = lambda n, by: 100.0 * F.try_divide(d(n).cast("double"), by.cast("double"))
    good = (dt > 0) & (dt <= pair_max_us)
    psi = lambda n: pct(n, dt) >= pressure
    res = {
        "cpu": (pct("busy_us", d("total_us")) >= limits["cpu"]) & psi("psi_cpu_us"), "threads": F.when(c("pid") == c("x_pid"), pct("thread_us", dt) >= limits["threads"]),
        "softirq": pct("softirq_us", d("total_us")) >= limits["softirq"], "disk": (pct("disk_us", dt) >= limits["disk"]) & psi("psi_io_us"), "memory": psi("psi_mem_us"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("resource"), F.when(good, e).alias("saturated")) for n, e in res.items()])
    return x.select("component", "sample_id", "x_us", "ts_us", F.inline(rows))


def saturation_episodes(pairs: DataFrame, t0_us: int, t1_us: int, min_us: int, coverage_min: float, gap_max_us: int, slice_us: int) -> DataFrame:
    """Per component and resource: proved and possible episodes of at least ``min_us``, coverage.

    Pairs are clipped to the period; what no valid pair covers is unknown. A proved episode
    is a stretch of saturated pairs; a possible one is a stretch without a calm pair that
    contains unknown time and no proved episode.
    """
    keys = ["component", "resource"]
    c = F.col
    p = pairs.where("saturated is not null").withColumns({"lo": F.greatest("x_us", F.lit(t0_us)), "hi": F.least("ts_us", F.lit(t1_us))}).where("hi > lo")
    p = materialize(p.select(*keys, "lo", "hi", F.when(c("saturated"), "S").otherwise("N").alias("state")))
    nxt = following(p, keys, ["lo", "hi"], {"lo": "next_lo"}, "lo", slice_us)
    holes = nxt.where(c("next_lo") > c("hi")).select(*keys, c("hi").alias("lo"), c("next_lo").alias("hi"), F.lit("U").alias("state"))
    ends = p.groupBy(*keys).agg(F.min("lo").alias("a"), F.max("hi").alias("b"))
    head = ends.where(c("a") > t0_us).select(*keys, F.lit(t0_us).alias("lo"), c("a").alias("hi"), F.lit("U").alias("state"))
    tail = ends.where(c("b") < t1_us).select(*keys, c("b").alias("lo"), F.lit(t1_us).alias("hi"), F.lit("U").alias("state"))
    tl = p.unionByName(holes).unionByName(head).unionByName(tail).withColumns({"calm": c("state") == "N", "len": c("hi") - c("lo"), "_one": F.lit(1)})
    tl = materialize(tl)
    x = previous(tl, keys, ["lo", "hi"], {"state": "ps", "calm": "pc", "_one": "had"}, "lo", slice_us)
    turn = lambda now, before: F.when(c("had").isNull() | (c(now) != c(before)), 1).otherwise(0)
    x = x.withColumns({"_t1": turn("calm", "pc"), "_t2": turn("state", "ps")})
    r2 = materialize(scan(x, keys, ["lo", "hi"], "lo", slice_us, {"stretch": ("sum", c("_t1"), True), "sub": ("sum", c("_t2"), True)}))
    proved = r2.where("state = 'S'").groupBy(*keys, "stretch", "sub").agg(F.sum("len").alias("d")).where(c("d") >= min_us)
    per = proved.groupBy(*keys, "stretch").agg(F.count(F.lit(1)).alias("proved"))
    st = r2.where("not calm").groupBy(*keys, "stretch").agg(F.sum("len").alias("possible"), F.sum(F.when(c("state") == "U", c("len")).otherwise(0)).alias("unknown"))
    st = st.join(per, [*keys, "stretch"], "left").na.fill(0, ["proved"])
    e = st.groupBy(*keys).agg(F.sum("proved").alias("proved"), F.count_if((c("proved") == 0) & (c("unknown") > 0) & (c("possible") >= min_us)).alias("doubtful"))
    cov = tl.groupBy(*keys).agg(F.sum(F.when(c("state") != "U", c("len")).otherwise(0)).alias("covered_us"), F.max(F.when(c("state") == "U", c("len")).otherwise(0)).alias("max_hole_us"))
    y = cov.join(e, keys, "left").na.fill(0, ["proved", "doubtful"])
    return y.withColumn("coverage_ok", (c("covered_us") >= coverage_min * (t1_us - t0_us)) & (c("max_hole_us") <= gap_max_us))


def saturation_verdict(window: DataFrame, base: DataFrame) -> DataFrame:
    """Saturation that is new against the baseline: false; none with full coverage: true; else NULL."""
    keys = ["component", "resource"]
    b = base.select(*keys, *[F.col(x).alias(f"b_{x}") for x in ("proved", "doubtful", "coverage_ok")])
    x = window.join(b, keys, "left")
    c = F.col
    calm = F.coalesce(c("b_coverage_ok") & (c("b_proved") == 0) & (c("b_doubtful") == 0), F.lit(False))
    v = F.when(c("proved") > 0, F.when(calm, F.lit(False))).when(c("coverage_ok") & (c("doubtful") == 0), F.lit(True))
    x = x.withColumn("value", v)
    overall = x.groupBy("component").agg(F.when(F.count_if(~c("value")) > 0, F.lit(False)).when(F.count_if(c("value").isNull()) == 0, F.lit(True)).alias("overall"))
    return x.select(*keys, "proved", "doubtful", "coverage_ok", "value").join(overall, "component")


def counter_rise(samples: DataFrame, counter: str, t0_us: int, t1_us: int, edge_us: int, slice_us: int) -> DataFrame:
    """Rise of a counter between the readings nearest to both edges; NULL if one is missing or it fell."""
    c = F.col
    s = samples.where(c(counter).isNotNull())
    near = lambda t: F.min_by(c("ts_us"), F.when(F.abs(c("ts_us") - t) <= edge_us, F.struct(F.abs(c("ts_us") - t), c("ts_us"))))
    e = s.groupBy("component").agg(near(t0_us).alias("a"), near(t1_us).alias("b"))
    x = previous(s, ["component"], ["ts_us", "sample_id"], {counter: "v0", "ts_us": "x_us"}, "ts_us", slice_us).join(e, "component")
    x = x.where(c("ts_us").between(c("a"), c("b")))
    agg = x.groupBy("component").agg(_yes((c("x_us") >= c("a")) & (c(counter) < c("v0"))).alias("falls"), (F.max_by(counter, F.struct("ts_us", "sample_id")) - F.min_by(counter, F.struct("ts_us", "sample_id"))).alias("rise"))
    return e.join(agg, "component", "left").select("component", F.when(c("falls") == 0, c("rise")).alias("rise"))


def resource_summary(samples: DataFrame, slice_us: int) -> DataFrame:
    """Fine samples per component: CPU share p95, least memory, longest time without growth."""

    c = F.col
    x = previous(samples, ["component"], ["ts_us", "sample_id"], {"ts_us": "x_us", "busy_us": "b0", "total_us": "t0", "bytes": "y0"}, "ts_us", slice_us)
    x = x.withColumn("share", F.when((c("total_us") > c("t0")) & (c("busy_us") >= c("b0")), 100.0 * (c("busy_us") - c("b0")) / (c("total_us") - c("t0"))))
    still = c("x_us").isNotNull() & (c("bytes") == c("y0"))
    x = scan(x.withColumn("_grew", F.when(still, 0).otherwise(1)), ["component"], ["ts_us", "sample_id"], "ts_us", slice_us, {"island": ("sum", c("_grew"), True)})
    stall = x.groupBy("component", "island").agg((F.max("ts_us") - F.min("ts_us")).alias("d")).groupBy("component").agg(F.max("d").alias("longest_stall_us"))
    q = quantiles(x, ["component"], "share", {"cpu_p50": (0.5, "trunc"), "cpu_p95": (0.95, "trunc")})
    n = x.groupBy("component").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("pid").alias("pids"), F.min("free").alias("free_min"), F.max(c("ts_us") - c("x_us")).alias("gap_max_us"))
    return n.join(stall, "component").join(q, "component", "left")


# --- load and verdicts ----------------------------------------------------------------------------

def slot_coverage(flows: DataFrame, profiles: DataFrame, t0_us: int, t1_us: int, slot_us: int) -> DataFrame:
    """Slots of each profile without a flow; a remainder belongs to the last slot."""
    n = max(1, (t1_us - t0_us) // slot_us)
    slot = F.least(idiv(F.col("ts_us") - t0_us, slot_us), F.lit(n - 1).cast("long"))
    seen = flows.where((F.col("ts_us") >= t0_us) & (F.col("ts_us") < t1_us)).select("entity_ip", slot.alias("slot")).distinct()
    every = profiles.select("profile", "entity_ip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("slot"))
    return every.join(seen, ["entity_ip", "slot"], "left_anti")


def burst_episodes(starts: DataFrame, t0_us: int, t1_us: int, bin_us: int, width: int, min_sum: int, min_active: int, design: float) -> DataFrame:
    """Runs of five-bin sums over three times the reference load, merged where they overlap.

    Counts per bin come first, so the ordered window runs over bins, not over flows.
    """
    n = -(-(t1_us - t0_us) // bin_us)
    b = F.least(idiv(F.col("ts_us") - t0_us, bin_us), F.lit(n - 1).cast("long"))
    got = starts.where((F.col("ts_us") >= t0_us) & (F.col("ts_us") < t1_us)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = starts.sparkSession.range(n).withColumnRenamed("id", "bin").join(got, "bin", "left").na.fill(0, ["c"])
    ref = got.agg(F.greatest(F.sum("c") / n, F.lit(float(design))).alias("ref"))
    need = F.greatest(F.lit(min_sum).cast("long"), F.ceil(3 * F.col("ref") * width - 1e-9))
    w = Window.orderBy("bin").rowsBetween(0, width - 1)  # one row per bin
    x = grid.withColumns({"s": F.sum("c").over(w), "act": F.sum((F.col("c") > 0).cast("int")).over(w)}).where(F.col("bin") <= n - width)
    hot = x.join(F.broadcast(ref)).where((F.col("s") >= need) & (F.col("act") >= min_active))
    o = Window.orderBy("bin")
    hot = hot.withColumn("_new", F.when(F.col("bin") - F.lag("bin").over(o) <= width - 1, 0).otherwise(1)).withColumn("ep", F.sum("_new").over(o))
    spans = hot.groupBy("ep").agg(F.min("bin").alias("a"), (F.max("bin") + width - 1).alias("z"), F.max("s").alias("max_sum"))
    y = spans.withColumn("bin", F.explode(F.sequence("a", "z"))).join(grid, "bin")
    return y.groupBy("ep", "a", "z", "max_sum").agg(F.sum("c").alias("flows"))


def load_verdict(criteria: DataFrame) -> DataFrame:
    """Verdict per case from nullable load (K) and stability (S) criteria and the measurements.

    criteria: case_id, k_false, k_null, s_false, s_null, period_class, sensor_state, packets, drops, s12.
    """
    c = F.col
    base = (
        F.when(c("k_false") > 0, "carga insuficiente").when(c("k_null") + c("s_null") > 0, "no demostrable")
        .when(c("s_false") > 0, "no estable").otherwise("estable con carga suficiente")
    )
    measured = c("sensor_state").isin(*MEASURED)
    contradictions = F.array_compact(F.array(
        F.when((c("sensor_state") == "cero_explicito") & (c("drops") != 0), "explicit zero with drops"), F.when((c("sensor_state") == "descartes") & (c("drops") == 0), "drops without drops"),
        F.when(~measured & (c("packets").isNotNull() | c("drops").isNotNull()), "numbers without a measurement"),
        F.when(measured & ~F.coalesce("s12", F.lit(False)) | ~measured & F.coalesce("s12", F.lit(False)), "S12 against the measurement"),
        F.when((c("period_class") == "C0") & ((c("sensor_state") != "cero_explicito") | (F.coalesce("drops", F.lit(1)) != 0)), "C0 against the measurement"),
        F.when((c("period_class") == "C1") & ((c("sensor_state") != "descartes") | (F.coalesce("drops", F.lit(0)) == 0)), "C1 against the measurement"),
        F.when((c("period_class") == "C2") & ~measured, "C2 without a measurement")))
    x = criteria.withColumns({"base": base, "contradictions": contradictions})
    v = (
        F.when((F.size("contradictions") > 0) & (c("base") != "carga insuficiente"), "no demostrable")
        .when(c("period_class").isin("C3", "no_evaluable") & (c("base") == "estable con carga suficiente"), "no demostrable").otherwise(c("base"))
    )
    x = x.withColumn("verdict", v)
    ok = (c("verdict") == "estable con carga suficiente") & (F.size("contradictions") == 0) & ~c("period_class").isin("C3", "no_evaluable")
    return x.select("case_id", "verdict", ok.alias("enables"), F.array_join("contradictions", "; ").alias("contradictions"))


def criteria_table(cases: DataFrame, sources: dict[str, DataFrame], names: dict[str, list[str]]) -> DataFrame:
    """Criteria of each case in long form with their provenance; a missing source leaves NULL.

    Each source holds case_id, period_ok and boolean columns; another period counts as missing.
    """
    x = cases
    items = []
    for source, df in sources.items():
        cols = names[source]
        x = x.join(df.select("case_id", F.col("period_ok").alias(f"ok_{source}"), *[F.col(c).alias(f"{source}_{c}") for c in cols]), "case_id", "left")
        items += [F.struct(F.lit(c).alias("criterion"), F.lit(source).alias("source"), F.when(F.col(f"ok_{source}"), F.col(f"{source}_{c}")).alias("value")) for c in cols]
    return x.select("case_id", F.inline(F.array(*items)))


def watch_conditions(rounds: DataFrame, jump_us: int, silence_us: int, offset_max_s: float, slice_us: int) -> DataFrame:
    """Pause (P) and cancel (X) conditions present in each round of a watch.

    rounds: component, sample_id, ts_us, active, pid, ring_jump_us, failures, kernel_drops,
    reading_us, offset_s, applied, off_list, bad_share.
    """
    c = F.col
    x = previous(rounds, ["component"], ["ts_us", "sample_id"], {"pid": "pid0", "failures": "f0", "kernel_drops": "d0"}, "ts_us", slice_us)
    pause = F.array_compact(F.array(
        F.when(c("active").isNull() | ~c("active") | (c("pid") != c("pid0")), "P1"), F.when(F.abs("offset_s") > offset_max_s, "P2"),
        F.when(c("ring_jump_us").isNull() | (c("ring_jump_us") > jump_us) | (c("failures") > c("f0")), "P3"),
        F.when((c("ts_us") - c("reading_us") > silence_us) | c("reading_us").isNull() | ((c("pid") == c("pid0")) & (c("kernel_drops") > c("d0"))), "P4")))
    cancel = F.array_compact(F.array(F.when(c("bad_share") > 0.2, "X1"), F.when(c("applied") > 0, "X2"), F.when(c("off_list") > 0, "X3")))
    x = x.withColumns({"pauses": pause, "cancels": cancel})
    state = F.when(F.size("cancels") > 0, "cancelar").when(F.size("pauses") > 0, "pausa").otherwise("continuar")
    return x.select("component", "sample_id", "ts_us", F.array_join("pauses", ",").alias("pauses"), F.array_join("cancels", ",").alias("cancels"), state.alias("state"))


def watch_decisions(conditions: DataFrame, clean_us: int, slice_us: int) -> DataFrame:
    """A cancellation is final; a pause holds until ``clean_us`` have passed without a condition."""

    c = F.col
    x = scan(conditions, ["component"], ["ts_us", "sample_id"], "ts_us", slice_us, {
        "_dead": ("max", F.when(c("state") == "cancelar", 1).otherwise(0), True), "_bad": ("max", F.when(c("state") == "pausa", c("ts_us")), True)})
    out = F.when(c("_dead") == 1, "cancelar").when((c("state") == "pausa") | (c("ts_us") - c("_bad") < clean_us), "pausa").otherwise("continuar")
    return x.select("component", "sample_id", out.alias("decision"))


def offlist(events: DataFrame, origin: str, allowed: DataFrame) -> DataFrame:
    """Events of one origin to addresses outside the list, by destination."""
    x = events.where(F.col("src_ip") == origin).join(allowed.select(F.col("ip").alias("dest_ip")).distinct(), "dest_ip", "left_anti")
    return x.groupBy("dest_ip").agg(F.count(F.lit(1)).alias("events"), F.min("ts_us").alias("first_us"))
