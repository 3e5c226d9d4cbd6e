"""Which records moved which feature: contributions, traceability, live views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netlens.functions.columns import ceil_bucket
from netlens.operators.features import CONTRACT_V2, CONTRACT_V3, COUNTS

# Which rule reads which feature.
RULE_READS = {
    "flow_attempt_count_30s": ("port_scan",),
    "unique_dst_port_ratio_30s": ("port_scan",),
    "syn_completion_ratio_10s": ("port_scan",),
}
APP_SOURCED = {n for n in CONTRACT_V2 if n.startswith(("http", "dns", "tls", "unique_dns"))}
L2_NAMES = tuple(n for n in CONTRACT_V3 if n not in CONTRACT_V2)


def _c(feature: str, text, when=None) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    item = F.struct(F.lit(feature).alias("feature"), text.alias("contribution"))
    return item if when is None else F.when(when, item)


def notable(df: DataFrame) -> DataFrame:
    """Packets worth showing: they open, mark, break or repeat something."""
    return df.where("flow_attempt or syn or syn_ack or rst or retransmission or fragmented or protocol = 1")


def packet_contributions(obs: DataFrame) -> DataFrame:
    """One row per (packet, feature it updates)."""
    a = F.col("flow_attempt")
    items = F.array(
        _c("packet_rate_10s", "+1"),
        _c("byte_rate_10s", F.concat(F.lit("+"), F.col("ip_length").cast("string"), F.lit(" B"))),
        _c("flow_attempt_rate_10s", "+1", a), _c("flow_attempt_count_30s", "+1", a),
        _c("unique_dst_ip_ratio_30s", F.concat(F.lit("peer "), F.col("peer_ip")), a),
        _c("unique_dst_port_ratio_30s", F.concat(F.lit("port "), F.col("target_port").cast("string")), a & (F.col("target_port") > 0)),
        _c("syn_rate_10s", "+1", F.col("syn")), _c("syn_completion_ratio_10s", "+1 attempt", F.col("syn")),
        _c("syn_completion_ratio_10s", "+1 completed", F.col("syn_ack")),
        _c("rst_ratio_10s", "+1 RST", F.col("rst")),
        _c("tcp_retransmission_ratio_10s", "+1 retransmission", F.col("retransmission")),
        _c("fragment_ratio_10s", "+1", F.col("fragmented")), _c("icmp_ratio_10s", "+1", F.col("protocol") == 1),
        _c("large_ip_ratio_10s", "+1", F.col("ip_length").between(500, 1500)),
    )
    return obs.select("*", F.inline(F.array_compact(items)))


def event_contributions(app: DataFrame) -> DataFrame:
    """One row per (application event, feature it updates)."""
    k = F.col("kind")
    http, q, tls = k == "http", k == "dns_query", k == "tls"
    st = F.col("status")
    or_ = lambda c, text: F.when(F.col(c) == "", F.lit(text)).otherwise(F.col(c))
    status_text = F.concat(F.lit("+1 ("), st.cast("string"), F.lit(")"))
    items = F.array(
        _c("http_request_rate_60s", "+1", http), _c("http_request_count_60s", "+1", http),
        _c("http_method_entropy_60s", or_("method", "no method"), http),
        _c("http_error_ratio_60s", status_text, http & (st >= 400)),
        _c("http_auth_failure_ratio_60s", status_text, http & st.isin(401, 403)),
        _c("http_status_5xx_ratio_60s", status_text, http & st.between(500, 599)),
        _c("dns_query_rate_60s", "+1", q), _c("dns_query_count_60s", "+1", q),
        _c("unique_dns_name_ratio_60s", or_("dns_name", "no name"), q),
        _c("dns_nxdomain_ratio_60s", "+1 query", q), _c("dns_nxdomain_ratio_60s", "+1 NXDOMAIN", k == "dns_nxdomain"),
        _c("tls_session_rate_60s", F.concat(F.lit("session "), F.col("event_key")), tls),
        _c("tls_version_ratio_60s", F.col("tls_version"), tls & (F.col("tls_version") != "")),
        _c("tls_handshake_failure_ratio_60s", "+1 no version", tls & (F.col("tls_version") == "")),
    )
    return app.select("*", F.inline(F.array_compact(items)))


def window_steps(feature: Column) -> Column:
    """Length of a feature's window in steps, from its suffix."""
    return F.when(feature.endswith("_60s"), 6).when(feature.endswith("_30s"), 3).otherwise(1)


def trace(contributions: DataFrame, rows: DataFrame, names: list[str], step_us: int, source_start_us: int | Column) -> DataFrame:
    """Each contribution with the value of the anchor row that absorbs it.

    ``partial`` marks windows that begin before the source does.
    """
    long = rows.select("entity_ip", "anchor", F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])))
    x = contributions.withColumn("anchor", ceil_bucket(F.col("ts_us"), step_us))
    start = source_start_us if isinstance(source_start_us, Column) else F.lit(source_start_us)
    x = x.withColumn("partial", (F.col("anchor") - window_steps(F.col("feature"))) * step_us < start)
    return x.join(long, ["entity_ip", "anchor", "feature"], "left")


def newest(df: DataFrame, n: int, ts: str = "ts_us", tie: str = "arrival") -> DataFrame:
    """The n newest rows (the report is the limit itself)."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def unmatched(records: DataFrame, observations: DataFrame, key: list[str], kind: str) -> DataFrame:
    """Records that produced no observation, counted by type."""
    return records.join(observations.select(*key).distinct(), key, "left_anti").groupBy(kind).agg(
        F.count(F.lit(1)).alias("unmatched")
    )


def traceability(spark: SparkSession, reads: DataFrame | None = None) -> DataFrame:
    """Feature -> layer, source, window, use and the rules that read it."""
    rows = []
    for name in [*CONTRACT_V3, *COUNTS]:
        app = name in APP_SOURCED or name.startswith(("http", "dns", "tls_obs"))
        layer = "L7" if app else "L2" if name in L2_NAMES else "L4" if name.startswith(("syn", "rst", "tcp", "flow", "unique_dst_port")) else "L3"
        use = "model" if name in CONTRACT_V2 else "count" if name in COUNTS else "extractor only"
        rows.append((name, layer, "events" if app else "frames", int(name.rsplit("_", 1)[1][:-1]), use, list(RULE_READS.get(name, ()))))
    return spark.createDataFrame(rows, "feature string, layer string, source string, window_s int, use string, rules array<string>")
