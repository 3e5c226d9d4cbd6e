"""Continuous learning that resists poisoning: lots, limits, drift, influence, lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


from netlens.operators.core import point_in_interval, previous, quantiles, scan, to_long

EPS = 1e-4
USABLE = ("aceptado", "aceptado_a_mano")


def marks(decisions: DataFrame, alerts: DataFrame, t0_us: int, t1_us: int) -> DataFrame:
    """(address, instant) of everything suspicious in [t0, t1): decisions and sensor alerts."""
    d = decisions.where((F.col("decision") != "PERMIT") | (F.col("rule") != "")).select("entity_ip", F.col("window_us").alias("mark_us"))
    a = alerts.select(F.explode(F.array("src_ip", "dest_ip")).alias("entity_ip"), F.col("ts_us").alias("mark_us"))
    both = d.unionByName(a).where(F.col("entity_ip").isNotNull())
    return both.where((F.col("mark_us") >= t0_us) & (F.col("mark_us") < t1_us)).distinct()


def sanitize(rows: DataFrame, marked: DataFrame, ts: str, margin_us: int) -> DataFrame:
    """Rows without a mark of their address within the margin (both ends included)."""
    spans = marked.select("entity_ip", (F.col("mark_us") - margin_us).alias("lo_us"), (F.col("mark_us") + margin_us).alias("hi_us")).distinct()
    return point_in_interval(rows, spans, ["entity_ip"], ts, "lo_us", "hi_us", "left_anti", 2 * margin_us)


def limits(gold: DataFrame, names: list[str], q: float = 0.999) -> DataFrame:
    """Per feature: low and high quantile of the gold set and their distance (1 if equal)."""
    x = quantiles(to_long(gold, [], names), ["feature"], "value", {"lo": (1 - q, "linear"), "hi": (q, "linear")})
    width = F.col("hi") - F.col("lo")
    return x.withColumn("width", F.when(width == 0, F.lit(1.0)).otherwise(width))


def outliers(rows: DataFrame, lim: DataFrame, names: list[str], tolerance: float = 0.5) -> DataFrame:
    """Rows with the number of features beyond the limits by more than the tolerance.

    The limits become one row of two maps, so the rows are not unpivoted.
    """
    pad = F.lit(tolerance) * F.col("width")
    one = lim.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.col("lo") - pad))).alias("_lo"),
        F.map_from_entries(F.collect_list(F.struct("feature", F.col("hi") + pad))).alias("_hi"),
    )  # one row, one entry per feature
    x = rows.join(F.broadcast(one))
    out = lambda n: F.when((F.col(n) > F.col("_hi")[n]) | (F.col(n) < F.col("_lo")[n]), 1).otherwise(0)
    return x.withColumn("outlier_features", reduce(lambda a, b: a + b, [out(n) for n in names])).drop("_lo", "_hi")


def cut_points(reference: DataFrame, boxes: int = 10) -> DataFrame:
    """Distinct linear deciles of each feature of a long reference, sorted."""
    names = {f"q{i}": (i / boxes, "linear") for i in range(1, boxes)}
    q = quantiles(reference, ["feature"], "value", names)
    return q.select("feature", F.array_sort(F.array_distinct(F.array(*names))).alias("cuts"))


def psi(reference: DataFrame, new: DataFrame, boxes: int = 10) -> DataFrame:
    """Population stability of each feature; both inputs are long (feature, value).

    A value's box is the number of cut points strictly below it. Counts per box combine
    map-side; the cut points are one small row per feature.
    """
    cuts = cut_points(reference, boxes)
    box = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    side = lambda df, name: df.where("value is not null").select("feature", "value", F.lit(name).alias("side"))
    both = side(reference, "ref").unionByName(side(new, "new")).join(F.broadcast(cuts), "feature")  # one row per feature
    n = both.groupBy("feature", box.alias("box")).agg(F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "new").alias("w"))
    every = cuts.select("feature", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("box"))
    total = n.groupBy("feature").agg(F.sum("r").alias("tr"), F.sum("w").alias("tw"))
    x = every.join(n, ["feature", "box"], "left").na.fill(0, ["r", "w"]).join(total, "feature")
    p, q = F.greatest(F.try_divide(F.col("r"), F.col("tr")), F.lit(EPS)), F.greatest(F.try_divide(F.col("w"), F.col("tw")), F.lit(EPS))
    term = (q - p) * F.ln(q / p)
    return x.groupBy("feature").agg(F.round(F.sum(F.when((F.col("tr") > 0) & (F.col("tw") > 0), term).otherwise(0.0)), 6).alias("psi"))


def close_lot(rows: DataFrame, marked: DataFrame, gold: DataFrame, names: list[str], ts: str, margin_us: int, policy: dict) -> tuple[DataFrame, DataFrame]:
    """A day's lot: the rows that survive, and its one-row record with state and reasons.

    Order: eligible rows, then without contamination, then without too many outlier
    features; the lot is rejected when it has drifted too far from the gold set.
    """
    ok = rows.where("eligible")
    clean = sanitize(ok, marked, ts, margin_us)
    kept = outliers(clean, limits(gold, names, policy["quantile"]), names, policy["tolerance"]).where(F.col("outlier_features") < policy["max_outliers"]).drop("outlier_features")
    p = psi(to_long(gold, [], names), to_long(kept, [], names))
    worst = p.agg(F.max("psi").alias("psi_max"), F.max_by("feature", F.struct("psi", "feature")).alias("psi_worst"))
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    rec = count(rows, "n_input").join(F.broadcast(count(ok, "n_ok"))).join(F.broadcast(count(clean, "n_clean"))).join(F.broadcast(count(kept, "n_output"))).join(F.broadcast(worst))
    state = (
        F.when(F.col("n_output") < policy["min_rows"], "insuficiente")
        .when(F.col("psi_max") > policy["psi_reject"], "aceptado_a_mano" if policy.get("accept") else "rechazado").otherwise("aceptado")
    )
    rec = rec.select(
        "n_input", (F.col("n_input") - F.col("n_ok")).alias("n_not_eligible"), (F.col("n_ok") - F.col("n_clean")).alias("n_contaminated"),
        (F.col("n_clean") - F.col("n_output")).alias("n_outlier"), "n_output", "psi_max", "psi_worst", state.alias("state"))
    return kept, rec


# --- lineage -----------------------------------------------------------------------------

def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)


def content_digest(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Order-free digest of a table per key: row count and folded row hashes."""
    h = F.conv(F.substring(row_digest(columns), 1, 15), 16, 10).cast("long")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_digest"))


def append_lineage(entries: DataFrame, seq: str, body: str, slice_rows: int = 1000) -> DataFrame:
    """Log entries with the hash of the entry before (64 zeros for the first).

    The hash covers the entry's own text, so the chain is one ordered look-back.
    """
    x = entries.withColumn("entry_hash", F.sha2(F.col(body), 256)).withColumn("_k", F.lit(0))
    x = previous(x, ["_k"], [seq], {"entry_hash": "previous_hash"}, seq, slice_rows)
    return x.withColumn("previous_hash", F.coalesce("previous_hash", F.lit("0" * 64))).drop("_k")


def verify_lineage(log: DataFrame, seq: str, body: str, digests: DataFrame, slice_rows: int = 1000) -> DataFrame:
    """Breaks of the chain, and lots whose content is gone or no longer matches.

    log: seq, body, previous_hash, lot, lot_digest. digests: lot, digest.
    """
    x = log.withColumn("_h", F.sha2(F.col(body), 256)).withColumn("_k", F.lit(0))
    x = previous(x, ["_k"], [seq], {"_h": "_want"}, seq, slice_rows)
    x = x.join(digests, "lot", "left")
    problems = F.array_compact(F.array(
        F.when(F.col("previous_hash") != F.coalesce("_want", F.lit("0" * 64)), F.lit("chain broken")),
        F.when(F.col("lot").isNotNull() & F.col("digest").isNull(), F.lit("lot missing")),
        F.when(F.col("digest") != F.col("lot_digest"), F.lit("lot altered")),
    ))
    return x.select(seq, "lot", F.explode(problems).alias("problem"))


def make_gold(rows: DataFrame, partition: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The gold set: eligible rows of one partition, and its digest to check later."""
    gold = rows.where((F.col("partition") == partition) & F.col("eligible"))
    return gold, content_digest(gold, [], columns)


# --- influence -----------------------------------------------------------------------------

def even_subsample(rows: DataFrame, keys: list[str], order: list[str], ts: str, n: Column, slice_us: int) -> DataFrame:
    """Elements int(i * N / n) of each key's time-ordered list.

    The rank is a running count over time slices, so a hot key is spread; row r is chosen
    when some i satisfies int(i * N / n) = r.
    """

    x = scan(rows, keys, order, ts, slice_us, {"_rank": ("sum", F.lit(1), True)})
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    x = x.join(total, keys).withColumn("_n", n)
    step = F.col("_total") / F.col("_n")
    r = F.col("_rank") - 1
    guess = F.floor(r / step)
    hit = lambda i: (i >= 0) & (i < F.col("_n")) & (F.floor(i * step) == r)
    chosen = (F.col("_n") >= F.col("_total")) | ((F.col("_n") > 0) & (hit(guess) | hit(guess + 1) | hit(guess - 1)))
    return x.where(chosen).drop("_rank", "_total", "_n")


def limit_influence(new: DataFrame, n_base: int, f_new: float, f_ip: float, ts: str, tie: str, slice_us: int) -> DataFrame:
    """Cap each address's share of the new rows, then the new rows' share of the whole."""
    total = new.count()
    per_ip = max(1, int(f_ip * total))
    x = even_subsample(new, ["entity_ip"], [ts, tie], ts, F.lit(per_ip), slice_us)
    cap = int(f_new / (1 - f_new) * n_base)
    y = even_subsample(x.withColumn("_k", F.lit(0)), ["_k"], [ts, "entity_ip", tie], ts, F.lit(cap), slice_us)
    return y.drop("_k")


# --- drift and decisions ------------------------------------------------------------------------

def drift(gold: DataFrame, lots: DataFrame, decisions: DataFrame, threshold: float, psi_alert: float, rate_max: float) -> DataFrame:
    """Per day: gold FPR, PSI of the scores, anomaly rate of the lot, alert rate, signal.

    gold: score. lots: day, score. decisions: day, decision.
    """
    ref = gold.select(F.col("score").alias("value"))
    days = lots.select("day").distinct()
    cuts = cut_points(ref.withColumn("feature", F.lit("score")))
    box = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    g = ref.join(F.broadcast(cuts.select("cuts"))).groupBy(box.alias("box")).agg(F.count(F.lit(1)).alias("r"))
    n = lots.select("day", F.col("score").alias("value")).join(F.broadcast(cuts.select("cuts"))).groupBy("day", box.alias("box")).agg(F.count(F.lit(1)).alias("w"))
    every = days.join(F.broadcast(cuts.select("cuts"))).select("day", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("box"))
    tot = lots.groupBy("day").agg(F.count(F.lit(1)).alias("lot_rows"), F.round(F.count_if(F.col("score") < threshold) / F.count(F.lit(1)), 6).alias("lot_anomaly_rate"))
    gt = gold.agg(F.count(F.lit(1)).alias("tr"), F.round(F.count_if(F.col("score") < threshold) / F.count(F.lit(1)), 6).alias("gold_fpr"))
    x = every.join(F.broadcast(g), "box", "left").join(n, ["day", "box"], "left").na.fill(0, ["r", "w"]).join(tot, "day").join(F.broadcast(gt))
    p, q = F.greatest(F.col("r") / F.col("tr"), F.lit(EPS)), F.greatest(F.col("w") / F.col("lot_rows"), F.lit(EPS))
    out = x.groupBy("day").agg(
        F.first("gold_fpr").alias("gold_fpr"), F.first("lot_rows").alias("lot_rows"), F.first("lot_anomaly_rate").alias("lot_anomaly_rate"),
        F.round(F.sum((q - p) * F.ln(q / p)), 6).alias("psi_scores"))
    eng = decisions.groupBy("day").agg(F.round(F.count_if(F.col("decision") != "PERMIT") / F.count(F.lit(1)), 6).alias("engine_alert_rate"), F.count(F.lit(1)).alias("engine_decisions"))
    out = out.join(eng, "day", "left")
    return out.withColumn("signal", (F.col("psi_scores") > psi_alert) | (F.col("lot_anomaly_rate") > rate_max))


def sustained_drift(days: DataFrame, n: int) -> DataFrame:
    """Are the last n measured days all flagged? (one row; the table has one row per day)"""
    last = days.orderBy(F.col("day").desc()).limit(n)
    return last.agg((F.count(F.lit(1)) >= n).alias("enough"), F.coalesce(F.every("signal"), F.lit(False)).alias("all")).select((F.col("enough") & F.col("all")).alias("sustained"))


def retrain_reason(sustained: DataFrame, candidates: DataFrame, gold_day: int | None, today: int, cadence: int, n: int) -> DataFrame:
    """Why to train now: sustained drift, else days since the last candidate (or the gold set)."""
    last = candidates.agg(F.max("day").alias("last")).select(F.coalesce("last", F.lit(gold_day).cast("long")).alias("last"))
    x = sustained.join(F.broadcast(last))  # one row each
    why = F.when(F.col("sustained"), F.lit(f"sustained drift {n} days")).when(F.lit(today) - F.col("last") >= cadence, F.lit(f"cadence of {cadence} days"))
    return x.select("sustained", "last", why.alias("reason"))


def pending_lots(lots: DataFrame, used: DataFrame) -> DataFrame:
    """Accepted lots that no promoted model has used."""
    return lots.where(F.col("state").isin(*USABLE)).join(used.select("lot"), "lot", "left_anti")


def candidate_rows(base: DataFrame, gold: DataFrame, new: DataFrame, key: list[str], ts: str, f_new: float, f_ip: float, tie: str, slice_us: int, columns: list[str]) -> DataFrame:
    """Training rows: the base without the gold set, and the limited new rows."""
    g = gold.select(*key).distinct()
    b = base.where(F.col("partition").isin("train", "validation") & F.col("eligible")).join(g, key, "left_anti")
    n = limit_influence(new.join(g, key, "left_anti"), b.count(), f_new, f_ip, ts, tie, slice_us)
    return b.select(*columns, F.lit("base").alias("origin")).unionByName(n.select(*columns, F.lit("new").alias("origin")))


def verdict(models: DataFrame, fpr_tolerance: float, detection_tolerance: float) -> DataFrame:
    """Promote a candidate? Columns: current_fpr, candidate_fpr, current_detection, candidate_detection."""
    fa, fc, da, dc = (F.col(c) for c in ("current_fpr", "candidate_fpr", "current_detection", "candidate_detection"))
    out = (
        F.when(fa.isNull() | fc.isNull(), "EVALUACION_INCOMPLETA").when(fc > fa + fpr_tolerance, "NO_PROMOVER")
        .when(da.isNull() | dc.isNull(), "EVALUACION_INCOMPLETA").when(dc < da - detection_tolerance, "NO_PROMOVER").otherwise("PROMOVIBLE")
    )
    return models.withColumn("verdict", out)
