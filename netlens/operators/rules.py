"""Transparent rules, the model decision and the bookkeeping of windows."""

from __future__ import annotations

from copy import deepcopy

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netlens.functions.columns import in_scope
from netlens.operators.core import point_in_interval

# Thresholds, their version, severities.
RULES_VERSION = "2026-11-02.1"
THRESHOLDS = {
    "brute_force": {"min_http_req_60s": 5, "min_auth_fail_ratio_60s": 0.8, "action": "BLOCK"},
    "port_scan": {
        "min_flow_attempt_30s": 20, "min_unique_dst_port_ratio_30s": 0.45, "max_syn_completion_ratio_10s": 0.3,
        "min_flow_attempt_burst_30s": 200, "max_syn_completion_burst_10s": 0.1,
        "min_unique_dst_port_ratio_burst_30s": 0.1, "action": "BLOCK",
    },
    "http_abuse": {"min_http_req_60s": 600, "max_auth_fail_ratio_60s": 0.8, "action": "LIMIT"},
    "dns_entropy": {"min_queries_60s": 30, "min_nxdomain_ratio_60s": 0.5, "min_unique_names_ratio_60s": 0.8, "action": "LIMIT"},
}
SEVERITY = {"BLOCK": 2, "LIMIT": 1}
RULE_ORDER = ("brute_force", "port_scan", "http_abuse", "dns_entropy")
AUTH_MIN_REQUESTS, AUTH_MIN_RATIO = 5, 0.8


def severity(action: Column) -> Column:
    return F.when(action == "BLOCK", 2).when(action == "LIMIT", 1).otherwise(0)


def with_overrides(overrides: dict[str, dict]) -> dict[str, dict]:
    """Default thresholds with some values replaced; unknown names are an error."""
    out = deepcopy(THRESHOLDS)
    for rule, values in overrides.items():
        for name, value in values.items():
            if name not in out[rule]:
                raise KeyError(f"{rule}.{name}")
            out[rule][name] = value
    return out


def threshold_table(spark: SparkSession, versions: dict[str, dict[str, dict]]) -> DataFrame:
    """Threshold sets as a small dimension: one row per version, one column per value."""
    rows = [
        {"version": v, **{f"{r}__{k}": (float(x) if k != "action" else x) for r, kv in t.items() for k, x in kv.items()}}
        for v, t in versions.items()
    ]
    return spark.createDataFrame(rows)


def _limits(thresholds: dict | None):
    """Literal thresholds, or the columns of a joined threshold table."""
    def get(rule: str, name: str) -> Column:
        if thresholds is None:
            return F.col(f"{rule}__{name}")
        return F.lit(thresholds[rule][name])
    return get


def _has(df_cols: list[str], name: str) -> bool:
    return name in df_cols


def fired(cols: list[str], thresholds: dict | None = THRESHOLDS) -> dict[str, Column]:
    """Rule -> condition. A rule whose view is absent, or NULL in a row, does not fire."""
    u = _limits(thresholds)
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    never = F.lit(False)
    out: dict[str, Column] = {}
    http = "httph_requests_60s" in cols
    seen = F.col("httph_requests_60s").isNotNull() if http else never
    req, auth = (c("httph_requests_60s"), c("httph_auth_failure_ratio_60s")) if http else (F.lit(0), F.lit(0))
    out["brute_force"] = seen & (req >= u("brute_force", "min_http_req_60s")) & (auth >= u("brute_force", "min_auth_fail_ratio_60s"))
    if "flow_attempt_count_30s" in cols:
        fa, up, sc = c("flow_attempt_count_30s"), c("unique_dst_port_ratio_30s"), c("syn_completion_ratio_10s")
        normal = (fa >= u("port_scan", "min_flow_attempt_30s")) & (up >= u("port_scan", "min_unique_dst_port_ratio_30s")) & (sc <= u("port_scan", "max_syn_completion_ratio_10s"))
        burst = (fa >= u("port_scan", "min_flow_attempt_burst_30s")) & (sc <= u("port_scan", "max_syn_completion_burst_10s")) & (up >= u("port_scan", "min_unique_dst_port_ratio_burst_30s"))
        out["port_scan_normal"], out["port_scan_burst"], out["port_scan"] = normal, burst, normal | burst
    else:
        out["port_scan"] = never
    out["http_abuse"] = seen & (req >= u("http_abuse", "min_http_req_60s")) & (auth < u("http_abuse", "max_auth_fail_ratio_60s"))
    if "dnsh_queries_60s" in cols:
        n = c("dnsh_queries_60s")
        odd = (c("dnsh_nxdomain_ratio_60s") >= u("dns_entropy", "min_nxdomain_ratio_60s")) | (c("dnsh_unique_names_ratio_60s") >= u("dns_entropy", "min_unique_names_ratio_60s"))
        out["dns_entropy"] = F.col("dnsh_queries_60s").isNotNull() & (n >= u("dns_entropy", "min_queries_60s")) & odd
    else:
        out["dns_entropy"] = never
    return out


def _motive(rule: str, cols: list[str]) -> Column:
    i = lambda n: F.coalesce(F.round(F.col(n), 0).cast("long"), F.lit(0)).cast("string") if n in cols else F.lit("0")
    p = lambda n: F.coalesce(F.round(100 * F.col(n), 0).cast("long"), F.lit(0)).cast("string") if n in cols else F.lit("0")
    if rule == "brute_force":
        return F.concat(i("httph_requests_60s"), F.lit(" HTTP requests/60s, "), p("httph_auth_failure_ratio_60s"), F.lit("% failing authentication ("), i("httph_late_excluded_60s"), F.lit(" late records excluded)"))
    if rule == "port_scan":
        return F.concat(i("flow_attempt_count_30s"), F.lit(" attempts/30s to many ports, "), p("syn_completion_ratio_10s"), F.lit("% completed"))
    if rule == "http_abuse":
        return F.concat(i("httph_requests_60s"), F.lit(" HTTP requests/60s"))
    return F.concat(i("dnsh_queries_60s"), F.lit(" own DNS queries/60s, "), p("dnsh_nxdomain_ratio_60s"), F.lit("% NXDOMAIN, "), p("dnsh_unique_names_ratio_60s"), F.lit("% unique names ("), i("dnsh_forwards_excluded_60s"), F.lit(" forwards excluded)"))


def all_rules(df: DataFrame, thresholds: dict | None = THRESHOLDS, name: str = "rules") -> DataFrame:
    """Every firing rule in declared order, with action and motive."""
    conds = fired(df.columns, thresholds)
    u = _limits(thresholds)
    items = [
        F.when(conds[r], F.struct(F.lit(r).alias("rule"), u(r, "action").alias("action"), _motive(r, df.columns).alias("motive")))
        for r in RULE_ORDER
    ]
    return df.withColumn(name, F.array_compact(F.array(*items)))


def top_rule(df: DataFrame, rules: str = "rules", name: str = "top") -> DataFrame:
    """The most severe rule; equal severities keep the declared order."""
    best = F.reduce(
        rules, F.lit(None).cast("struct<rule:string,action:string,motive:string>"),
        lambda acc, x: F.when(acc.isNull() | (severity(x["action"]) > severity(acc["action"])), x).otherwise(acc),
    )
    return df.withColumn(name, best)


# --- decisions ------------------------------------------------------------------------------

def decide(scored: DataFrame, threshold: float, detector: str = "iforest") -> DataFrame:
    """Model decision: strictly below the threshold alerts; windows without packets are not scored."""
    dead = F.col("packet_count_10s") == 0
    empty = dead & (F.col("http_request_count_60s") == 0) & (F.col("dns_query_count_60s") == 0) & (F.col("tls_observation_count_60s") == 0)
    return scored.withColumns({
        "detector_name": F.when(empty, F.lit("empty_window_heuristic")).when(dead, F.lit("no_live_packets_heuristic")).otherwise(F.lit(detector)),
        "decision": F.when(~dead & (F.col("score") < threshold), F.lit("ALERT")).otherwise(F.lit("PERMIT")),
        "score": F.when(~dead, F.col("score")),
    })


def auth_failure(decided: DataFrame, min_requests: float = AUTH_MIN_REQUESTS, min_ratio: float = AUTH_MIN_RATIO) -> DataFrame:
    """Raise PERMIT to ALERT only on what the HTTP view confirms; the raw columns are recorded."""
    raw = (F.col("http_request_count_60s") >= min_requests) & (F.col("http_auth_failure_ratio_60s") >= min_ratio)
    seen = (F.coalesce("httph_requests_60s", F.lit(0)) >= min_requests) & (F.coalesce("httph_auth_failure_ratio_60s", F.lit(0.0)) >= min_ratio)
    lift = (F.col("decision") == "PERMIT") & seen
    return decided.withColumns({
        "auth_historic": raw, "auth_authorises": lift,
        "decision_model": F.col("decision"),
        "decision": F.when(lift, F.lit("ALERT")).otherwise(F.col("decision")),
        "detector_name": F.when(lift, F.lit("auth_failure_heuristic")).otherwise(F.col("detector_name")),
    })


def complete_windows(windows: DataFrame, packets: DataFrame, step_us: int, guard_us: int = 5_000) -> DataFrame:
    """Windows whose end the packet stream has passed by the guard (events do not hold it)."""
    mark = packets.agg(F.max("ts_us").alias("high_us"))
    return windows.join(F.broadcast(mark)).withColumn("complete", F.col("high_us") >= F.col("anchor") * step_us + guard_us)  # one row


def window_status(pending: DataFrame, rows: DataFrame, content: DataFrame, step_us: int, high_us: int, now_us: int, expiry_us: int) -> DataFrame:
    """State of every window that was pending or has a row.

    decided, or with a reason: no_elegible, fila_no_generada, ventana_no_regenerada,
    pcap_incompleto, sin_contenido_en_su_horizonte; otherwise still pending.
    """
    keys = ["entity_ip", "anchor"]
    x = (
        pending.withColumn("was_pending", F.lit(True))
        .join(rows.select(*keys, "eligible").withColumn("has_row", F.lit(True)), keys, "full_outer")
        .join(content.select(*keys).distinct().withColumn("has_content", F.lit(True)), keys, "left")
    )
    end = F.col("anchor") * step_us
    row, has = F.coalesce("has_row", F.lit(False)), F.coalesce("has_content", F.lit(False))
    late, old = end > high_us, F.lit(now_us) - end > expiry_us
    def state(status: str, reason: str | Column = "") -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(status).alias("status"), reason.alias("reason"))

    lost = F.when(old, F.lit("ventana_no_regenerada")).otherwise(F.lit("fila_no_generada"))
    status = (
        F.when(late & ~old, state("pending"))
        .when(late, state("not_evaluated", "pcap_incompleto"))
        .when(row & F.col("eligible"), state("decided"))
        .when(row, state("not_evaluated", "no_elegible"))
        .when(has, state("not_evaluated", lost))
        .otherwise(state("cancelled", "sin_contenido_en_su_horizonte"))
    )
    return x.withColumn("_s", status).select(*keys, "_s.status", "_s.reason")


def full_history(windows: DataFrame, packet_start_us: int, event_start_us: int, step_us: int, horizon_us: int) -> DataFrame:
    """Does the window's horizon begin after both sources do?"""
    start = F.col("anchor") * step_us - horizon_us
    return windows.withColumn("full_history", (start >= packet_start_us) & (start >= event_start_us))


def sustained(decisions: DataFrame, now_us: int, window_us: int, min_n: int, detector: str, excluded: list[str], hosts: list[str]) -> DataFrame:
    """Addresses with at least ``min_n`` model alerts lately, without infrastructure."""
    last_octet = F.element_at(F.split("entity_ip", r"\."), -1)
    x = decisions.where((F.col("decision") == "ALERT") & (F.col("detector_name") == detector) & (F.col("logged_us") >= now_us - window_us))
    x = x.groupBy("entity_ip").agg(F.count(F.lit(1)).alias("alerts"), F.max("logged_us").alias("last_us")).where(F.col("alerts") >= min_n)
    out = in_scope(F.col("entity_ip"), excluded) if excluded else F.lit(False)
    return x.where(~last_octet.isin("1", "2", "254") & ~F.col("entity_ip").isin(hosts) & ~out)


# --- studies of the rules -------------------------------------------------------------------------

def dns_rule_grid(view: DataFrame, grid: DataFrame, min_nx: float) -> DataFrame:
    """View rows that each (min_queries, min_unique) combination fires on; the grid is a dimension."""
    hit = (F.col("dnsh_queries_60s") >= F.col("min_queries")) & (
        (F.col("dnsh_nxdomain_ratio_60s") >= min_nx) | (F.col("dnsh_unique_names_ratio_60s") >= F.col("min_unique"))
    )
    return view.join(F.broadcast(grid), hit)  # a parameter table of fixed size


def grid_summary(hits: DataFrame, episodes: DataFrame, step_us: int, tail_us: int, width_us: int) -> DataFrame:
    """Per combination: episodes reached, reached before their end, and windows outside.

    episodes: entity_ip, episode_id, t0_us, t1_us. Windows end in (t0, t1 + tail].
    """
    p = hits.withColumn("end_us", F.col("anchor") * step_us)
    e = episodes.withColumn("lo_us", F.col("t0_us")).withColumn("hi_us", F.col("t1_us") + tail_us)
    combo = ["min_queries", "min_unique"]
    inside = point_in_interval(p, e, ["entity_ip"], "end_us", "lo_us", "hi_us", "inner", width_us, lo_open=True)
    per_ep = inside.groupBy(*combo, "episode_id").agg(F.min("end_us").alias("first_us"), F.first("t1_us").alias("t1_us"))
    got = per_ep.groupBy(*combo).agg(F.count(F.lit(1)).alias("reached"), F.count_if(F.col("first_us") <= F.col("t1_us")).alias("before_end"))
    out = point_in_interval(p, e, ["entity_ip"], "end_us", "lo_us", "hi_us", "left_anti", width_us, lo_open=True)
    legit = out.groupBy(*combo).agg(F.count(F.lit(1)).alias("outside"), F.count_distinct("entity_ip").alias("outside_entities"))
    return got.join(legit, combo, "full_outer").na.fill(0)


def worst_cases(view: DataFrame, attackers: list[str]) -> DataFrame:
    """Per legitimate entity its largest count, the window it fell in (latest on ties) and most forwards."""
    at = F.max_by("anchor", F.struct("dnsh_queries_60s", "anchor")).alias("anchor")
    return view.where(~F.col("entity_ip").isin(attackers)).groupBy("entity_ip").agg(
        F.max("dnsh_queries_60s").alias("max_own"), at, F.max("dnsh_forwards_excluded_60s").alias("max_forwards")
    )


def decision_diff(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Windows whose final decision or detector differs between two logs (or exist in one only)."""
    keys = ["entity_ip", "anchor"]
    cols = ["decision", "detector_name", "score"]
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in cols], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in cols], F.lit(True).alias("in_b"))
    x = left.join(right, keys, "full_outer")
    side = F.when(F.col("in_b").isNull(), F.lit("only_a")).when(F.col("in_a").isNull(), F.lit("only_b")).otherwise(F.lit("both"))
    same = (F.col("decision_a") == F.col("decision_b")) & (F.col("detector_name_a") == F.col("detector_name_b"))
    pure = F.when(F.col("score_a").isNotNull(), F.when(F.col("score_a") < threshold, F.lit("ALERT")).otherwise(F.lit("PERMIT")))
    x = x.withColumns({"side": side, "model_only": pure, "score_changed": ~F.col("score_a").eqNullSafe(F.col("score_b"))})
    return x.where((F.col("side") != "both") | ~same).drop("in_a", "in_b")
