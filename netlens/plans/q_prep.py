"""Queries P01-P17 and D01-D15."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.functions import columns as C
from netlens.operators import exclusions as X, lineage, prep
from netlens.operators.features import features
from netlens.plans.adapt import DAY_US, SCOPE, STEP_US, sql, table, view
from netlens.plans.registry import add, r6

H = 3600 * 1_000_000

add("P01_scope_filter",
    lambda s, d: table(s, d, "packets").select("arrival", "src_ip", C.in_scope(F.col("src_ip"), SCOPE).alias("inside")),
    sql("packets", "SELECT arrival, src_ip, src_ip LIKE '10.10.%' AS inside FROM packets"))


def p02(s, d):
    kept, counted = prep.split_excluded(table(s, d, "packets"), "src_ip", ["10.20.0.0/30", "10.10.1.0/28"])
    kept = kept.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("kept"))
    return kept.unionByName(counted.select("src_ip", F.col("rows_excluded").alias("n"), F.lit("excluded").alias("side")))


add("P02_split_excluded", p02, sql("packets", """
SELECT src_ip, CASE WHEN src_ip IN ('10.20.0.0','10.20.0.1','10.20.0.2','10.20.0.3') OR (src_ip LIKE '10.10.1.%' AND CAST(split_part(src_ip,'.',4) AS INT) < 16)
  THEN 'excluded' ELSE 'kept' END AS side, CAST(count(*) AS BIGINT) AS n FROM packets GROUP BY 1, 2"""))

add("P03_drop_protocols",
    lambda s, d: prep.drop_protocols(table(s, d, "packets"), (1,)).groupBy("protocol").agg(F.count(F.lit(1)).alias("n")),
    sql("packets", "SELECT protocol, CAST(count(*) AS BIGINT) AS n FROM packets WHERE protocol <> 1 GROUP BY 1"))

FLOW = view("flowed", "packets", """SELECT *, CASE WHEN protocol IN (6,17) THEN
  CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN protocol||'|'||src_ip||':'||src_port||'|'||dst_ip||':'||dst_port||'|'
       ELSE protocol||'|'||dst_ip||':'||dst_port||'|'||src_ip||':'||src_port||'|' END
  ELSE protocol||'|'||least(src_ip,dst_ip)||':0|'||greatest(src_ip,dst_ip)||':0|'||icmp_id END AS flow FROM packets""")
add("P04_flow_key", lambda s, d: table(s, d, "packets").select("arrival", C.flow_key().alias("flow")),
    sql("flowed", "SELECT arrival, flow FROM flowed"))
add("P05_tcp_pair_key",
    lambda s, d: table(s, d, "http").select("arrival", C.tcp_pair_key("src_ip", "src_port", "dest_ip", "dest_port").alias("pair")),
    sql("http", """SELECT arrival, CASE WHEN (src_ip, src_port) <= (dest_ip, dest_port) THEN src_ip||':'||src_port||'|'||dest_ip||':'||dest_port
      ELSE dest_ip||':'||dest_port||'|'||src_ip||':'||src_port END AS pair FROM http"""))

# Attributed packets, written independently with window functions.
view("firsts", "flowed", """SELECT *, row_number() OVER w AS rn,
  first_value(struct_pack(t := ts_us, s := src_ip, d := dst_ip, sp := src_port, dp := dst_port,
    swap := (protocol=6 AND (tcp_flags & 2)<>0 AND (tcp_flags & 16)<>0), echo := (protocol=1 AND icmp_type=0))) OVER w AS f
  FROM flowed WINDOW w AS (PARTITION BY flow ORDER BY ts_us, arrival)""")
view("owned", "firsts", """SELECT *, CASE WHEN f.swap OR f.echo THEN f.d ELSE f.s END AS entity_ip,
  CASE WHEN f.swap OR f.echo THEN f.s ELSE f.d END AS peer_ip, CASE WHEN f.swap THEN f.sp ELSE f.dp END AS target_port,
  rn = 1 AS flow_attempt, ts_us - f.t AS flow_duration_us FROM firsts""")
view("obs", "owned", """SELECT ts_us, arrival, src_ip, dst_ip, src_port, dst_port, protocol, ip_length, ttl, fragmented, tcp_flags, tcp_seq, tcp_payload_length,
  flow, entity_ip, peer_ip, target_port, flow_attempt, flow_duration_us, src_ip = entity_ip AS outbound,
  protocol=6 AND src_ip=entity_ip AND (tcp_flags & 2)<>0 AND (tcp_flags & 16)=0 AS syn,
  protocol=6 AND src_ip<>entity_ip AND (tcp_flags & 2)<>0 AND (tcp_flags & 16)<>0 AS syn_ack,
  protocol=6 AND (tcp_flags & 4)<>0 AS rst,
  protocol=6 AND tcp_payload_length>0 AND row_number() OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port, tcp_seq, (protocol=6 AND tcp_payload_length>0) ORDER BY ts_us, arrival) > 1 AS retransmission
  FROM owned WHERE entity_ip LIKE '10.10.%'""")


def obs(s, d, ev=None):
    return prep.attribute(table(s, d, "packets", ev), SCOPE)


add("P06_packet_flags", lambda s, d: obs(s, d).select("arrival", "outbound", "syn", "syn_ack", "rst", "fragmented"),
    sql("obs", "SELECT arrival, outbound, syn, syn_ack, rst, fragmented FROM obs"))


def eve_dns(s, d):
    """Sensor-shaped name-service events: half carry rrname, half a queries list."""
    x = table(s, d, "dns")
    has = F.col("arrival") % 2 == 0
    q = F.array(F.struct(F.upper("name").alias("rrname"), F.col("rrtype").alias("rrtype")))
    return x.withColumn("dns", F.struct(
        F.when(has, F.upper("name")).alias("rrname"), F.when(has, F.col("rrtype")).alias("rrtype"),
        F.when(~has, q).alias("queries")))


add("P07_dns_name", lambda s, d: eve_dns(s, d).select("arrival", C.dns_name().alias("dns_name"), C.dns_type().alias("dns_type")),
    sql("dns", """SELECT arrival, name AS dns_name, CASE WHEN arrival % 2 = 0 AND name = '' THEN '' ELSE rrtype END AS dns_type FROM dns"""))


def p08(s, d):
    x = table(s, d, "ev")
    base = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    suffix = F.element_at(F.array(F.lit("Z"), F.lit("+00:00"), F.lit("+0000"), F.lit("+0200"), F.lit("?")), (F.col("event_id") % 5 + 1).cast("int"))
    return x.select("event_id", C.parse_ts_us(F.concat(base, suffix)).alias("us"))


add("P08_parse_ts", p08, sql("ev", """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN ts_us - 7200000000 ELSE ts_us END AS us FROM ev"""))
add("P09_safe_ratio",
    lambda s, d: r6(table(s, d, "ev").groupBy("user_id").agg(
        C.safe_ratio(F.count_if(F.col("event_type") == "error"), F.count_if(F.col("k") < 3)).alias("ratio"))),
    sql("ev", """SELECT user_id, CASE WHEN count(*) FILTER (WHERE k<3) = 0 THEN 0.0 ELSE
      round(count(*) FILTER (WHERE event_type='error') / CAST(count(*) FILTER (WHERE k<3) AS DOUBLE), 6) END AS ratio FROM ev GROUP BY 1"""))
add("P10_names",
    lambda s, d: table(s, d, "packets").select(
        "arrival", C.flag_name(F.col("tcp_flags")).alias("flags"), C.protocol_name(F.col("protocol")).alias("proto"),
        C.service_of(F.col("dst_port"), F.col("src_port")).alias("service")),
    sql("packets", """SELECT arrival, CASE tcp_flags WHEN 0 THEN '' WHEN 2 THEN 'SYN' WHEN 18 THEN 'SYN-ACK' WHEN 4 THEN 'RST' WHEN 24 THEN 'PSH-ACK' ELSE 'ACK' END AS flags,
      CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS proto,
      CASE WHEN dst_port = 443 THEN 'https' WHEN dst_port = 80 THEN 'http' WHEN dst_port = 53 THEN 'dns' WHEN dst_port = 22 THEN 'ssh'
      WHEN src_port = 443 THEN 'https' WHEN src_port = 80 THEN 'http' WHEN src_port = 53 THEN 'dns' WHEN src_port = 22 THEN 'ssh' ELSE 'other' END AS service FROM packets"""))

# --- lineage ------------------------------------------------------------------------------

add("P11_notable", lambda s, d: lineage.notable(obs(s, d)).select("arrival", "entity_ip"),
    sql("obs", "SELECT arrival, entity_ip FROM obs WHERE flow_attempt OR syn OR syn_ack OR rst OR retransmission OR fragmented OR protocol=1"))
view("contrib", "app", """
  SELECT arrival, 'http_request_rate_60s' AS feature, '+1' AS contribution FROM app WHERE kind='http'
  UNION ALL SELECT arrival, 'http_request_count_60s', '+1' FROM app WHERE kind='http'
  UNION ALL SELECT arrival, 'http_method_entropy_60s', CASE WHEN method='' THEN 'no method' ELSE method END FROM app WHERE kind='http'
  UNION ALL SELECT arrival, 'http_error_ratio_60s', '+1 ('||status||')' FROM app WHERE kind='http' AND status>=400
  UNION ALL SELECT arrival, 'http_auth_failure_ratio_60s', '+1 ('||status||')' FROM app WHERE kind='http' AND status IN (401,403)
  UNION ALL SELECT arrival, 'http_status_5xx_ratio_60s', '+1 ('||status||')' FROM app WHERE kind='http' AND status BETWEEN 500 AND 599
  UNION ALL SELECT arrival, 'dns_query_rate_60s', '+1' FROM app WHERE kind='dns_query'
  UNION ALL SELECT arrival, 'dns_query_count_60s', '+1' FROM app WHERE kind='dns_query'
  UNION ALL SELECT arrival, 'unique_dns_name_ratio_60s', CASE WHEN dns_name='' THEN 'no name' ELSE dns_name END FROM app WHERE kind='dns_query'
  UNION ALL SELECT arrival, 'dns_nxdomain_ratio_60s', '+1 query' FROM app WHERE kind='dns_query'
  UNION ALL SELECT arrival, 'dns_nxdomain_ratio_60s', '+1 NXDOMAIN' FROM app WHERE kind='dns_nxdomain'
  UNION ALL SELECT arrival, 'tls_session_rate_60s', 'session '||event_key FROM app WHERE kind='tls'
  UNION ALL SELECT arrival, 'tls_version_ratio_60s', tls_version FROM app WHERE kind='tls' AND tls_version<>''
  UNION ALL SELECT arrival, 'tls_handshake_failure_ratio_60s', '+1 no version' FROM app WHERE kind='tls' AND tls_version=''""")
add("P12_contributions",
    lambda s, d: lineage.event_contributions(table(s, d, "app")).select("arrival", "feature", "contribution"),
    sql("contrib", "SELECT * FROM contrib"))


def p13(s, d):
    app = table(s, d, "app")
    names = ["http_request_rate_60s", "dns_query_rate_60s"]
    rows = features(obs(s, d), app, None, STEP_US, names)
    start = app.agg(F.min("ts_us")).first()[0]
    x = lineage.trace(lineage.event_contributions(app).where(F.col("feature").isin(names)), rows, names, STEP_US, start)
    return r6(lineage.newest(x, 500).select("arrival", "entity_ip", "feature", "anchor", "value", "partial"), 9)


add("P13_trace", p13, sql("app", f"""
WITH st AS (SELECT min(ts_us) AS t0 FROM app),
c AS (SELECT *, (ts_us + {STEP_US} - 1) // {STEP_US} AS anchor, CASE kind WHEN 'http' THEN 'http_request_rate_60s' ELSE 'dns_query_rate_60s' END AS feature
  FROM app WHERE kind IN ('http','dns_query') ORDER BY ts_us DESC, arrival DESC LIMIT 500),
spans AS (SELECT entity_ip, min(ts_us) AS lo, max(ts_us) AS hi FROM app GROUP BY 1)
SELECT c.arrival, c.entity_ip, c.feature, CAST(c.anchor AS BIGINT) AS anchor,
 CASE WHEN c.anchor >= s.lo // {STEP_US} + 1 THEN round((SELECT count(*) FROM app a WHERE a.entity_ip=c.entity_ip AND a.kind=c.kind AND a.ts_us > (c.anchor-6)*{STEP_US} AND a.ts_us <= c.anchor*{STEP_US}) / 129600.0, 9) END AS value,
 (c.anchor - 6) * {STEP_US} < st.t0 AS partial
FROM c JOIN spans s USING (entity_ip) CROSS JOIN st"""))


def p14(s, d):
    """Traceability of the features that the events of the given table move, with their use."""
    used = lineage.event_contributions(table(s, d, "app")).groupBy("feature").agg(F.count(F.lit(1)).alias("records"))
    m = lineage.traceability(s)
    return used.join(F.broadcast(m), "feature").select("feature", "layer", "source", "window_s", "use", "records")


add("P14_traceability", p14, sql("contrib", """SELECT feature, 'L7' AS layer, 'events' AS source, 60 AS window_s,
  CASE WHEN feature LIKE '%_count_60s' THEN 'count' ELSE 'model' END AS use, CAST(count(*) AS BIGINT) AS records FROM contrib GROUP BY 1"""))
add("P15_unmatched",
    lambda s, d: lineage.unmatched(table(s, d, "packets"), obs(s, d), ["arrival"], "protocol"),
    sql("obs", "SELECT protocol, CAST(count(*) AS BIGINT) AS unmatched FROM packets WHERE arrival NOT IN (SELECT arrival FROM obs) GROUP BY 1"))


# --- exclusions -----------------------------------------------------------------------------


def ranges(s, d):
    """One exclusion text per signup: ``IP@start/end``; every tenth covers all addresses."""
    e = table(s, d, "app").where("kind = 'tls'")
    iso = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    who = F.when(F.col("arrival") % 40 == 0, F.lit("*")).otherwise(F.col("entity_ip"))
    return e.select(F.concat(who, F.lit("@"), iso(F.col("ts_us")), F.lit("/"), iso(F.col("ts_us") + F.lit(2 * H))).alias("text"))


EXCL = view("excl", "app", f"""SELECT a.* FROM app a WHERE EXISTS (SELECT 1 FROM app r WHERE r.kind='tls'
  AND (r.arrival % 40 = 0 OR r.entity_ip = a.entity_ip) AND a.ts_us BETWEEN r.ts_us AND r.ts_us + {2 * H})""")
add("P16_exclude_ranges",
    lambda s, d: X.exclude_ranges(table(s, d, "app"), X.parse_ranges(ranges(s, d)), "entity_ip", "ts_us").select("arrival", "entity_ip"),
    sql("app excl", "SELECT arrival, entity_ip FROM app WHERE arrival NOT IN (SELECT arrival FROM excl)"))


def p17(s, d):
    rows = table(s, d, "app").withColumn("eligible", F.col("arrival") % 5 > 0).withColumn(
        "partition", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("arrival") % 3 + 1).cast("int")))
    out, counts = X.mark_ineligible(rows, X.parse_ranges(ranges(s, d)), "entity_ip", "ts_us")
    return counts


add("P17_mark_ineligible", p17, sql("app excl", """SELECT list_value('train','validation','test')[CAST(arrival % 3 + 1 AS INT)] AS partition,
  CAST(count(*) AS BIGINT) AS flipped FROM excl WHERE arrival % 5 > 0 GROUP BY 1"""))

# --- copies and layer 2 ------------------------------------------------------------------------
M_GAP = 12 * H
_MK = ", ".join(prep.MIRROR_KEY)
add("D01_dedup_mirror", lambda s, d: prep.dedup_mirror(table(s, d, "mirror"), M_GAP).select("arrival", "src_ip", "ttl"), sql("mirror", f"""
WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY {_MK} ORDER BY ts_us, arrival) AS rn, dense_rank() OVER (ORDER BY {_MK}) AS kid FROM mirror),
walk AS (SELECT kid, rn, ts_us AS kt, ttl AS kv, arrival AS ka, CAST(-1 AS BIGINT) AS gone FROM n WHERE rn = 1
  UNION ALL SELECT n.kid, n.rn,
    CASE WHEN n.ts_us - w.kt <= {M_GAP} AND abs(n.ttl - w.kv) <= 1 AND n.ttl <= w.kv THEN w.kt ELSE n.ts_us END,
    CASE WHEN n.ts_us - w.kt <= {M_GAP} AND abs(n.ttl - w.kv) <= 1 AND n.ttl <= w.kv THEN w.kv ELSE n.ttl END,
    CASE WHEN n.ts_us - w.kt <= {M_GAP} AND abs(n.ttl - w.kv) <= 1 AND n.ttl <= w.kv THEN w.ka ELSE n.arrival END,
    CASE WHEN n.ts_us - w.kt <= {M_GAP} AND abs(n.ttl - w.kv) <= 1 THEN (CASE WHEN n.ttl > w.kv THEN w.ka ELSE n.arrival END) ELSE -1 END
  FROM walk w JOIN n ON n.kid = w.kid AND n.rn = w.rn + 1)
SELECT arrival, src_ip, ttl FROM mirror WHERE arrival NOT IN (SELECT gone FROM walk)"""))
TCPK = ("src_ip", "src_port", "ip_id", "tcp_flags")
view("lagged", "mirror", f"""SELECT *, lag(ts_us) OVER (PARTITION BY src_ip, src_port, ip_id, tcp_flags ORDER BY ts_us, arrival) AS p FROM mirror""")
add("D02_dedup_tcp", lambda s, d: prep.dedup_tcp(table(s, d, "mirror"), M_GAP, keys=TCPK, slice_us=2 * DAY_US).select("arrival", "src_ip"),
    sql("lagged", f"SELECT arrival, src_ip FROM lagged WHERE p IS NULL OR ts_us - p >= {M_GAP}"))


def _greedy_sql(source: str, keys: str, gap: int, out: str) -> str:
    """Sequential rule as a recursion over the row number inside each key."""
    return sql(source, f"""
WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts_us, arrival) AS rn, dense_rank() OVER (ORDER BY {keys}) AS kid FROM {source}),
walk AS (SELECT kid, rn, ts_us AS kept_at, arrival, true AS keep FROM n WHERE rn = 1
  UNION ALL SELECT n.kid, n.rn, CASE WHEN n.ts_us - w.kept_at < {gap} THEN w.kept_at ELSE n.ts_us END, n.arrival, n.ts_us - w.kept_at >= {gap}
  FROM walk w JOIN n ON n.kid = w.kid AND n.rn = w.rn + 1)
SELECT {out} FROM walk WHERE keep""")


add("D03_dedup_tcp_no_refresh", lambda s, d: prep.dedup_tcp(table(s, d, "mirror"), M_GAP, refresh=False, keys=TCPK).select("arrival"),
    _greedy_sql("mirror", "src_ip, src_port, ip_id, tcp_flags", M_GAP, "arrival"))
DGAP = 48 * H
add("D04_dedup_dns",
    lambda s, d: prep.drop_repeats(table(s, d, "dns"), ("dns_event", "dest_ip", "rrtype", "rcode"), prep.ORDER, "ts_us", DGAP).select("arrival"),
    _greedy_sql("dns", "dns_event, dest_ip, rrtype, rcode", DGAP, "arrival"))
add("D05_dedup_http", lambda s, d: prep.dedup_http(table(s, d, "http")).select("arrival", "flow_id", "tx_id", "url"),
    sql("http", "SELECT arrival, flow_id, tx_id, url FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, tx_id, url ORDER BY ts_us, arrival) AS rn FROM http) WHERE rn = 1"))
add("D06_dedup_dns_second", lambda s, d: prep.dedup_dns_second(table(s, d, "dns")).groupBy("src_ip").agg(F.count(F.lit(1)).alias("n")),
    sql("dns", "SELECT src_ip, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT src_ip, src_port, dns_id, name, ts_us // 1000000 FROM dns) GROUP BY 1"))
add("D07_attribute", lambda s, d: obs(s, d).select("arrival", "entity_ip", "peer_ip", "target_port", "outbound"),
    sql("obs", "SELECT arrival, entity_ip, peer_ip, target_port, outbound FROM obs"))
add("D08_flow_attempt", lambda s, d: obs(s, d).select("arrival", "flow_attempt", "flow_duration_us"),
    sql("obs", "SELECT arrival, flow_attempt, flow_duration_us FROM obs"))
add("D09_retransmission", lambda s, d: obs(s, d).where("retransmission").select("arrival", "entity_ip"),
    sql("obs", "SELECT arrival, entity_ip FROM obs WHERE retransmission"))
add("D10_attribute_basic",
    lambda s, d: prep.attribute_basic(table(s, d, "packets"), SCOPE).select("arrival", "entity_ip", "target_port", "flow_attempt", "syn", "rst"),
    sql("obs", "SELECT arrival, entity_ip, target_port, flow_attempt, syn, rst FROM obs"))
add("D12_forwarding_macs", lambda s, d: prep.forwarding_macs(table(s, d, "l2")),
    sql("l2", "SELECT src_mac, CAST(count(DISTINCT vlan) AS BIGINT) AS vlans FROM l2 GROUP BY 1 HAVING count(DISTINCT vlan) > 1"))
view("native", "l2", """SELECT sender_ip, native_vlan FROM (SELECT sender_ip, vlan AS native_vlan, row_number() OVER (PARTITION BY sender_ip ORDER BY
   (sum(own) > 0) DESC, CASE WHEN max(any_own) = 1 THEN sum(own) ELSE count(*) END DESC, vlan) AS rn
 FROM (SELECT *, max(own) OVER (PARTITION BY sender_ip) AS any_own FROM (SELECT *, CASE WHEN src_mac IN (SELECT src_mac FROM l2 GROUP BY 1 HAVING count(DISTINCT vlan)>1) THEN 0 ELSE 1 END AS own FROM l2))
 GROUP BY sender_ip, vlan) WHERE rn = 1""")
add("D13_native_vlan", lambda s, d: prep.native_vlan(table(s, d, "l2")), sql("native", "SELECT sender_ip, native_vlan FROM native"))
view("own_l2", "l2 native", "SELECT l2.*, native_vlan FROM l2 JOIN native USING (sender_ip) WHERE vlan = native_vlan")
add("D14_binding_changes",
    lambda s, d: prep.mac_transitions(prep.in_native_vlan(table(s, d, "l2")), DAY_US, 6 * STEP_US).select("arrival", "sender_ip", "prev_mac", "src_mac"),
    sql("own_l2", f"""SELECT arrival, sender_ip, prev_mac, src_mac FROM (SELECT *, lag(src_mac) OVER w AS prev_mac, lag(ts_us) OVER w AS pt FROM own_l2
      WINDOW w AS (PARTITION BY sender_ip ORDER BY ts_us, arrival)) WHERE prev_mac <> src_mac AND ts_us - pt <= {6 * STEP_US}"""))
add("D15_l2_scope", lambda s, d: prep.l2_scope(table(s, d, "l2"), "10.10.1.0/25", (6,)).select("arrival", "sender_ip"),
    sql("l2", "SELECT arrival, sender_ip FROM l2 WHERE protocol <> 6 AND sender_ip LIKE '10.10.1.%' AND CAST(split_part(sender_ip,'.',4) AS INT) < 128"))
