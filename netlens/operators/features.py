"""Feature rows per (entity, window end): trailing windows of 1, 3 and 6 steps.

Windows are open on the left and closed on the right. Packets and events are first
reduced to one row per (entity, bucket) - a partial aggregate that runs map-side - and
only those rows are sent to the 1/3/6 anchors they feed. Distinct counts travel as
de-duplicated (entity, bucket, kind, value) rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from netlens.functions.columns import ACK, ICMP, RST, SYN, TCP, ceil_bucket, clamped_ratio, flow_key, has_flag, in_scope, safe_ratio
from netlens.operators.core import SECOND, asof, dense_grid, hop, materialize, previous
from netlens.operators.prep import ORDER, flow_owner, in_native_vlan, mac_transitions, native_vlan

# Feature names in contract order, with the measures they need.
PACKET_FEATURES = (
    "packet_rate_10s", "byte_rate_10s", "mean_ip_len_10s", "large_ip_ratio_10s", "icmp_ratio_10s",
    "flow_attempt_rate_10s", "syn_rate_10s", "syn_completion_ratio_10s", "rst_ratio_10s", "ttl_mean_10s",
    "fragment_ratio_10s", "tcp_retransmission_ratio_10s", "tx_rx_byte_ratio_30s",
)
PACKET_COUNTS = ("packet_count_10s", "flow_attempt_count_30s", "syn_count_10s", "tcp_data_segment_count_10s")
PACKET_DISTINCT = (
    "unique_dst_ip_ratio_30s", "unique_dst_port_ratio_30s", "protocol_diversity_30s", "flow_duration_mean_30s",
)
APP_FEATURES = (
    "http_error_ratio_60s", "dns_nxdomain_ratio_60s", "http_request_rate_60s", "http_auth_failure_ratio_60s",
    "dns_query_rate_60s", "tls_handshake_failure_ratio_60s", "tls_version_ratio_60s", "http_status_5xx_ratio_60s",
)
APP_COUNTS = ("http_request_count_60s", "dns_query_count_60s", "tls_observation_count_60s")
APP_DISTINCT = ("tls_session_rate_60s", "http_method_entropy_60s", "unique_dns_name_ratio_60s")
L2_FEATURES = ("arp_request_rate_10s", "unique_src_mac_30s", "mac_ip_binding_changes_60s")
L2_COUNTS = ("native_vlan", "arp_request_count_10s", "l2_frame_count_30s")
CONTRACT_V2 = (
    "packet_rate_10s", "byte_rate_10s", "mean_ip_len_10s", "large_ip_ratio_10s", "unique_dst_ip_ratio_30s",
    "icmp_ratio_10s", "flow_attempt_rate_10s", "syn_rate_10s", "syn_completion_ratio_10s", "rst_ratio_10s",
    "unique_dst_port_ratio_30s", "http_error_ratio_60s", "dns_nxdomain_ratio_60s", "tls_session_rate_60s",
    "ttl_mean_10s", "fragment_ratio_10s", "protocol_diversity_30s", "tcp_retransmission_ratio_10s",
    "flow_duration_mean_30s", "tx_rx_byte_ratio_30s", "http_request_rate_60s", "http_method_entropy_60s",
    "http_auth_failure_ratio_60s", "dns_query_rate_60s", "unique_dns_name_ratio_60s",
    "tls_handshake_failure_ratio_60s", "tls_version_ratio_60s", "http_status_5xx_ratio_60s",
)
OBS_COLUMNS = (
    "ts_us", "entity_ip", "peer_ip", "target_port", "protocol", "ip_length", "ttl", "fragmented", "tcp_payload_length",
    "flow_attempt", "flow_duration_us", "outbound", "syn", "syn_ack", "rst", "retransmission", "bucket",
)
CONTRACT_V1 = CONTRACT_V2[:14]
CONTRACT_V3 = CONTRACT_V2 + L2_FEATURES
COUNTS = PACKET_COUNTS + APP_COUNTS


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def _packet_part(obs: DataFrame) -> DataFrame:
    """Decomposable packet measures per (entity, anchor), *_1 over one step, *_3 over three."""
    tcp = F.col("protocol") == 6
    data = tcp & (F.col("tcp_payload_length") > 0)
    long_len = F.col("ip_length").cast("long")
    base = obs.groupBy("entity_ip", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(long_len).alias("bytes"),
        _n(F.col("ip_length").between(500, 1500)).alias("large"), _n(F.col("protocol") == 1).alias("icmp"),
        _n(F.col("flow_attempt")).alias("att"), _n(F.col("flow_attempt") & (F.col("target_port") > 0)).alias("attp"),
        _n(F.col("syn")).alias("syn"), _n(F.col("syn_ack")).alias("synack"), _n(F.col("rst")).alias("rst"),
        _n(tcp).alias("tcp"), F.sum(F.col("ttl").cast("long")).alias("ttl"), _n(F.col("fragmented")).alias("frag"),
        _n(F.col("retransmission")).alias("retr"), _n(data).alias("data"),
        F.sum(F.when(F.col("outbound"), long_len).otherwise(0)).alias("tx"),
    )
    here = F.col("off") == 0
    ones = ["n", "bytes", "large", "icmp", "att", "syn", "synack", "rst", "tcp", "ttl", "frag", "retr", "data"]
    return hop(base, 3).groupBy("entity_ip", "anchor").agg(
        *[F.sum(F.when(here, F.col(c))).alias(f"{c}_1") for c in ones],
        *[F.sum(c).alias(f"{c}_3") for c in ("n", "bytes", "att", "attp", "tx")],
    )


def _packet_distinct_part(obs: DataFrame) -> DataFrame:
    """Distinct peers, ports, protocols and the mean of the longest duration per flow id."""
    kinds = F.array(
        F.when(F.col("flow_attempt"), F.struct(F.lit("peer").alias("kind"), F.col("peer_ip").alias("val"))),
        F.when(F.col("flow_attempt") & (F.col("target_port") > 0),
               F.struct(F.lit("port").alias("kind"), F.col("target_port").cast("string").alias("val"))),
        F.struct(F.lit("proto").alias("kind"), F.col("protocol").cast("string").alias("val")),
        F.struct(F.lit("flow").alias("kind"), F.concat_ws("|", "peer_ip", "target_port", "protocol").alias("val")),
    )
    rows = obs.select("entity_ip", "bucket", "flow_duration_us", F.inline(F.array_compact(kinds)))
    rows = rows.groupBy("entity_ip", "bucket", "kind", "val").agg(F.max("flow_duration_us").alias("dur"))
    per = hop(rows, 3).groupBy("entity_ip", "anchor", "kind", "val").agg(F.max("dur").alias("dur"))
    kind = F.col("kind")
    return per.groupBy("entity_ip", "anchor").agg(
        _n(kind == "peer").alias("peers"), _n(kind == "port").alias("ports"), _n(kind == "proto").alias("protos"),
        F.avg(F.when(kind == "flow", F.col("dur"))).alias("dur_us"),
    )


def _app_part(app: DataFrame) -> DataFrame:
    kind = F.col("kind")
    http, tls = kind == "http", kind == "tls"
    base = app.groupBy("entity_ip", "bucket").agg(
        _n(http).alias("http"), _n(http & (F.col("status") >= 400)).alias("err"),
        _n(http & F.col("status").isin(401, 403)).alias("auth"), _n(http & F.col("status").between(500, 599)).alias("s5"),
        _n(kind == "dns_query").alias("q"), _n(kind == "dns_nxdomain").alias("nx"),
        _n(tls).alias("tls"), _n(tls & (F.col("tls_version") == "")).alias("tls_bad"),
        _n(tls & F.col("tls_version").contains("1.3")).alias("v13"),
    )
    cols = ["http", "err", "auth", "s5", "q", "nx", "tls", "tls_bad", "v13"]
    return hop(base, 6).groupBy("entity_ip", "anchor").agg(*[F.sum(c).alias(c) for c in cols])


def _app_distinct_part(app: DataFrame) -> DataFrame:
    """Distinct sessions and names, and the entropy of the HTTP methods ('' is a method)."""
    kind = F.col("kind")
    val = (
        F.when(kind == "tls", F.col("event_key")).when(kind == "http", F.col("method"))
        .when((kind == "dns_query") & (F.col("dns_name") != ""), F.col("dns_name"))
    )
    rows = app.withColumn("val", val).where("val is not null").groupBy("entity_ip", "bucket", "kind", "val").agg(
        F.count(F.lit(1)).alias("n")
    )
    per = hop(rows, 6).groupBy("entity_ip", "anchor", "kind", "val").agg(F.sum("n").alias("n"))
    n = F.col("n").cast("double")
    http_n = F.sum(F.when(kind == "http", n))
    return per.groupBy("entity_ip", "anchor").agg(
        _n(kind == "tls").alias("sessions"), _n(kind == "dns_query").alias("names"),
        (F.log2(http_n) - F.sum(F.when(kind == "http", n * F.log2(n))) / http_n).alias("entropy"),
    )


def _l2_part(l2: DataFrame, step_us: int) -> DataFrame:
    """Layer-2 measures in the native VLAN on the entity's own dense grid."""
    own = in_native_vlan(l2).withColumn("bucket", ceil_bucket(F.col("ts_us"), step_us))
    grid = dense_grid(own, "sender_ip", "ts_us", step_us)
    counts = own.groupBy("sender_ip", "bucket").agg(
        _n(F.col("arp_request")).alias("arp"), F.count(F.lit(1)).alias("frames")
    )
    counts = hop(counts, 3).groupBy("sender_ip", "anchor").agg(
        F.sum(F.when(F.col("off") == 0, F.col("arp"))).alias("arp"), F.sum("frames").alias("frames")
    )
    macs = own.select("sender_ip", "bucket", "src_mac").distinct()
    macs = hop(macs, 3).select("sender_ip", "anchor", "src_mac").distinct().groupBy("sender_ip", "anchor").agg(
        F.count(F.lit(1)).alias("macs")
    )
    # A transition belongs to the windows that hold both of its frames.
    moves = mac_transitions(own, slice_us=6 * step_us, tol_us=6 * step_us)
    first, last = F.col("bucket"), ceil_bucket(F.col("prev_ts"), step_us) + 5
    moves = (
        moves.select("sender_ip", first.alias("lo"), last.alias("hi")).where("lo <= hi")
        .groupBy("sender_ip", "lo", "hi").agg(F.count(F.lit(1)).alias("moves"))
        .select("sender_ip", "moves", F.explode(F.sequence("lo", "hi")).alias("anchor"))
        .groupBy("sender_ip", "anchor").agg(F.sum("moves").alias("moves"))
    )
    keys = ["sender_ip", "anchor"]
    out = grid.join(counts, keys, "left").join(macs, keys, "left").join(moves, keys, "left")
    return out.withColumnRenamed("sender_ip", "entity_ip").withColumn("l2_row", F.lit(True))


def _expressions(seconds: float) -> dict[str, Column]:
    """Feature name -> expression over the joined measures. ``seconds`` is one step."""
    c = F.col
    z = lambda name: F.coalesce(c(name), F.lit(0))
    s1, s6 = seconds, 6 * seconds
    r = safe_ratio
    return {
        "packet_count_10s": z("n_1").cast("long"), "flow_attempt_count_30s": z("att_3").cast("long"),
        "syn_count_10s": z("syn_1").cast("long"), "tcp_data_segment_count_10s": z("data_1").cast("long"),
        "http_request_count_60s": z("http").cast("long"), "dns_query_count_60s": z("q").cast("long"),
        "tls_observation_count_60s": z("tls").cast("long"),
        "packet_rate_10s": z("n_1") / s1, "byte_rate_10s": z("bytes_1") / s1,
        "mean_ip_len_10s": r(z("bytes_1"), z("n_1")), "large_ip_ratio_10s": r(z("large_1"), z("n_1")),
        "unique_dst_ip_ratio_30s": r(z("peers"), z("att_3")), "icmp_ratio_10s": r(z("icmp_1"), z("n_1")),
        "flow_attempt_rate_10s": z("att_1") / s1, "syn_rate_10s": z("syn_1") / s1,
        "syn_completion_ratio_10s": r(F.least(z("syn_1"), z("synack_1")), z("syn_1")),
        "rst_ratio_10s": r(z("rst_1"), z("tcp_1")), "unique_dst_port_ratio_30s": r(z("ports"), z("attp_3")),
        "http_error_ratio_60s": r(z("err"), z("http")), "dns_nxdomain_ratio_60s": clamped_ratio(z("nx"), z("q")),
        "tls_session_rate_60s": z("sessions") / s6, "ttl_mean_10s": r(z("ttl_1"), z("n_1")),
        "fragment_ratio_10s": r(z("frag_1"), z("n_1")), "protocol_diversity_30s": r(z("protos"), z("n_3")),
        "tcp_retransmission_ratio_10s": r(z("retr_1"), z("data_1")),
        "flow_duration_mean_30s": F.coalesce(c("dur_us"), F.lit(0.0)) / SECOND,
        "tx_rx_byte_ratio_30s": r(z("tx_3"), z("bytes_3")), "http_request_rate_60s": z("http") / s6,
        "http_method_entropy_60s": F.abs(F.coalesce(c("entropy"), F.lit(0.0))),
        "http_auth_failure_ratio_60s": r(z("auth"), z("http")), "dns_query_rate_60s": z("q") / s6,
        "unique_dns_name_ratio_60s": clamped_ratio(z("names"), z("q")),
        "tls_handshake_failure_ratio_60s": r(z("tls_bad"), z("tls")),
        "tls_version_ratio_60s": r(z("v13"), z("tls") - z("tls_bad")),
        "http_status_5xx_ratio_60s": r(z("s5"), z("http")),
        "arp_request_count_10s": z("arp").cast("long"), "l2_frame_count_30s": z("frames").cast("long"),
        "arp_request_rate_10s": z("arp") / s1, "unique_src_mac_30s": z("macs").cast("double"),
        "mac_ip_binding_changes_60s": z("moves").cast("double"),
        "native_vlan": F.coalesce(c("native_vlan"), F.lit(0)),
    }


def capture_start(obs: DataFrame, app: DataFrame, explicit_us: int | None = None) -> DataFrame:
    """One row: when the capture began (first packet or event, never a layer-2 frame).

    An explicit start later than the first observation is an error.
    """
    seen = obs.select("ts_us").unionByName(app.select("ts_us")).agg(F.min("ts_us").alias("capture_us"))
    if explicit_us is None:
        return seen
    late = F.raise_error(F.lit("capture start is later than the first observation")).cast("long")
    return seen.select(F.when(F.col("capture_us") < explicit_us, late).otherwise(F.lit(explicit_us)).alias("capture_us"))


def features(
    obs: DataFrame, app: DataFrame, l2: DataFrame | None = None, step_us: int = 10 * SECOND,
    columns: Sequence[str] | None = None, grid: str = "dense", capture_us: int | None = None,
) -> DataFrame:
    """Feature rows keyed by (entity_ip, anchor); ``anchor * step_us`` is the window end.

    ``grid='dense'`` emits every anchor of an entity's span, ``'content'`` only anchors
    whose longest window holds a packet or event. Only the parts that ``columns`` need
    are planned. With ``l2`` entities without IP traffic get rows of zeros.
    """
    wanted = list(columns) if columns is not None else [
        "history_coverage_s", "eligible_training", *COUNTS, *CONTRACT_V2, *((L2_COUNTS + L2_FEATURES) if l2 is not None else ())
    ]
    obs = obs.withColumn("bucket", ceil_bucket(F.col("ts_us"), step_us))
    app = app.withColumn("bucket", ceil_bucket(F.col("ts_us"), step_us))
    keys = ["entity_ip", "anchor"]

    def need(*groups):
        return any(c in g for c in wanted for g in groups)

    dist = need(PACKET_DISTINCT)
    packet_parts = need(PACKET_FEATURES, PACKET_COUNTS) or dist
    if packet_parts:
        # Attribution costs two shuffles; its narrow result is written once for all readers.
        obs = materialize(obs.select(*[c for c in OBS_COLUMNS if c in obs.columns]))
    parts: list[DataFrame] = []
    if packet_parts:
        parts.append(_packet_part(obs))
    if dist:
        parts.append(_packet_distinct_part(obs))
    if need(APP_FEATURES, APP_COUNTS, APP_DISTINCT):
        parts.append(_app_part(app))
    if need(APP_DISTINCT):
        parts.append(_app_distinct_part(app))

    if grid == "dense":
        both = obs.select("entity_ip", "ts_us").unionByName(app.select("entity_ip", "ts_us"))
        rows = dense_grid(both, "entity_ip", "ts_us", step_us)
    else:
        both = obs.select("entity_ip", "bucket").unionByName(app.select("entity_ip", "bucket")).distinct()
        rows = hop(both, 6).select(*keys).distinct()
    for part in parts:
        rows = rows.join(part, keys, "left")
    if l2 is not None:
        rows = rows.join(_l2_part(l2, step_us), keys, "full_outer")
        vlans = native_vlan(l2).select(F.col("sender_ip").alias("entity_ip"), "native_vlan")
        rows = rows.join(vlans, "entity_ip", "left")

    exprs = _expressions(step_us / SECOND)
    if need(("history_coverage_s", "eligible_training")):
        start = capture_start(obs, app, capture_us)
        rows = rows.join(F.broadcast(start))  # one row
        span = F.lit(6 * step_us)
        cover = F.greatest(F.lit(0).cast("long"), F.least(span, F.col("anchor") * step_us - F.col("capture_us")))
        exprs["history_coverage_s"] = F.round(cover / SECOND, 6)
        exprs["eligible_training"] = cover >= span
    return rows.select(*keys, *[exprs[c].alias(c) for c in wanted])


# --- live rows ------------------------------------------------------------------------

#: What is summed of a flow's packets in a bucket.
LIVE_SUMS = ("n", "bytes", "large", "icmp", "tcp", "ttl", "frag", "rst", "data", "retr", "syns", "synacks")


def horizon_parts(packets: DataFrame, step_us: int, horizon_steps: int) -> tuple[DataFrame, DataFrame]:
    """What live rows need of the packets, whatever the anchor: sums and firsts per (flow, bucket).

    Sums are kept by sender, as the direction depends on the owner. ``retr`` counts data segments whose
    (direction, sequence) was used before in the horizon of the bucket's own anchor: all of a bucket if an
    earlier bucket of the horizon has the sequence, else all but the first.
    """
    flags, tcp = F.col("tcp_flags"), F.col("protocol") == TCP
    syn, ack = has_flag(flags, SYN), has_flag(flags, ACK)
    data, ln = tcp & (F.col("tcp_payload_length") > 0), F.col("ip_length").cast("long")
    p = packets.withColumn("flow", flow_key()).withColumn("bucket", ceil_bucket(F.col("ts_us"), step_us))
    side = ["flow", "bucket", "src_ip", "protocol"]
    sums = materialize(p.groupBy(*side).agg(
        F.count(F.lit(1)).alias("n"), F.sum(ln).alias("bytes"), _n(F.col("ip_length").between(500, 1500)).alias("large"),
        _n(F.col("protocol") == ICMP).alias("icmp"), _n(tcp).alias("tcp"), F.sum(F.col("ttl").cast("long")).alias("ttl"),
        _n(F.col("fragmented")).alias("frag"), _n(tcp & has_flag(flags, RST)).alias("rst"), _n(data).alias("data"),
        _n(tcp & syn & ~ack).alias("syns"), _n(tcp & syn & ack).alias("synacks"), F.max("ts_us").alias("last_us"),
        F.min_by(F.struct(flow_owner().alias("owner"), F.struct(*ORDER).alias("at")), F.struct(*ORDER)).alias("first"),
    ))
    used = ["flow", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "tcp_seq"]
    segments = p.where(data).groupBy(*used, "bucket").agg(F.count(F.lit(1)).alias("m"))
    segments = previous(materialize(segments), used, ["bucket"], {"bucket": "before"}, "bucket", 64 * horizon_steps)
    fresh = F.when(F.col("before") > F.col("bucket") - horizon_steps, 0).otherwise(1)
    retr = segments.groupBy(*side).agg(F.sum(F.col("m") - fresh).alias("retr"))
    firsts = sums.groupBy("flow", "bucket").agg(F.min_by("first.owner", "first.at").alias("o"))
    zero = F.lit(0).cast("long")
    sums = sums.drop("first").join(retr, side, "left").withColumn("retr", F.coalesce("retr", zero))
    return sums, firsts


def horizon_owners(firsts: DataFrame, horizon_steps: int) -> tuple[DataFrame, DataFrame]:
    """(flow, anchor) -> owner for the anchors with a packet of the flow in their longest window; and the attempts.

    Behind anchor A a flow begins with its first packet in the buckets after A - horizon: a forward as-of lookup. So the
    first packet of a bucket is an attempt from the anchor on whose horizon no longer holds the flow's bucket before.
    """
    firsts = materialize(firsts)
    wide = 64 * horizon_steps
    asked = hop(firsts.select("flow", "bucket"), 6).select("flow", "anchor").distinct()
    asked = asked.withColumn("from_bucket", F.col("anchor") - (horizon_steps - 1))
    owners = asof(asked, firsts, ["flow"], "from_bucket", "bucket", {"o": "o"}, wide, forward=True)
    before = previous(firsts, ["flow"], ["bucket"], {"bucket": "before"}, "bucket", wide)
    least = F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("before") + horizon_steps - F.col("bucket"), F.lit(0).cast("long")))
    attempts = hop(before.withColumn("least", least).where("least < 3"), 3).where("off >= least")
    return owners.select("flow", "anchor", "o.*"), attempts.select("anchor", "off", "o.*")


def features_at_horizon(
    packets: DataFrame, app: DataFrame, scope: str, step_us: int, horizon_steps: int,
    columns: Sequence[str],
) -> DataFrame:
    """Live rows: the flow state behind anchor A only knows packets in (A - horizon, A].

    Packets are reduced to (flow, bucket, sender) before anything is sent to anchors; those rows go to the six
    anchors of the longest window, where the owner of (flow, anchor) says to whom they belong.
    """
    if horizon_steps < 6:
        raise ValueError("a horizon is at least as long as the longest window")
    sums, firsts = horizon_parts(packets, step_us, horizon_steps)
    owners, attempts = horizon_owners(firsts, horizon_steps)
    x = hop(sums, 6).join(owners.where(in_scope(F.col("entity_ip"), scope)), ["flow", "anchor"])
    begun = attempts.where(in_scope(F.col("entity_ip"), scope))
    return rows_of_anchors(x, begun, app.withColumn("bucket", ceil_bucket(F.col("ts_us"), step_us)), step_us, columns)


def rows_of_anchors(x: DataFrame, att: DataFrame, app: DataFrame, step_us: int, columns: Sequence[str]) -> DataFrame:
    """Live rows from owned sums per (anchor, offset, sender), the attempts per (anchor, offset) and events with their bucket."""
    x = x.withColumn("outbound", F.col("src_ip") == F.col("entity_ip"))
    keys = ["entity_ip", "anchor"]
    one, three, ported = F.col("off") == 0, F.col("off") < 3, F.col("target_port") > 0
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    base = x.groupBy(*keys).agg(
        *[total(one, c).alias(f"{c}_1") for c in LIVE_SUMS if c not in ("syns", "synacks")],
        total(one & F.col("outbound"), "syns").alias("syn_1"), total(one & ~F.col("outbound"), "synacks").alias("synack_1"),
        total(three, "n").alias("n_3"), total(three, "bytes").alias("bytes_3"), total(three & F.col("outbound"), "bytes").alias("tx_3"),
    )
    begun = att.groupBy(*keys).agg(_n(one).alias("att_1"), F.count(F.lit(1)).alias("att_3"), _n(ported).alias("attp_3"))
    kind = F.col("kind")
    text = lambda k, c: F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("val"))
    none = F.lit(None).cast("long")
    values = att.select(*keys, none.alias("dur"), F.inline(F.array_compact(F.array(text("peer", "peer_ip"), F.when(ported, text("port", "target_port"))))))
    flows = F.struct(F.lit("flow").alias("kind"), F.concat_ws("|", "peer_ip", "target_port", "protocol").alias("val"))
    values = values.unionByName(x.where(three).select(*keys, (F.col("last_us") - F.col("t0")).alias("dur"), F.inline(F.array(text("proto", "protocol"), flows))))
    distinct = values.groupBy(*keys, "kind", "val").agg(F.max("dur").alias("dur")).groupBy(*keys).agg(
        _n(kind == "peer").alias("peers"), _n(kind == "port").alias("ports"), _n(kind == "proto").alias("protos"),
        F.avg(F.when(kind == "flow", F.col("dur"))).alias("dur_us"),
    )
    rows = base.join(begun, keys, "left").join(distinct, keys, "left").join(_app_part(app), keys, "full_outer").join(_app_distinct_part(app), keys, "left")
    exprs = _expressions(step_us / SECOND)
    return rows.select(*keys, *[exprs[c].alias(c) for c in columns])
