"""Queries F01-F37 and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netlens.operators import features as FT, prep
from netlens.operators.core import SECOND
from netlens.plans import q_prep  # noqa: F401  (named subqueries)
from netlens.plans.adapt import SCOPE, STEP_US, sql, table, view
from netlens.plans.q_prep import obs
from netlens.plans.registry import add, r6

S = STEP_US
SEC = S // SECOND

view("stamps", "obs app", "SELECT entity_ip, ts_us FROM obs UNION ALL SELECT entity_ip, ts_us FROM app")
view("grid", "stamps", f"""SELECT entity_ip, CAST(unnest(generate_series(lo // {S} + 1, (hi + {S} - 1) // {S})) AS BIGINT) AS a
  FROM (SELECT entity_ip, min(ts_us) AS lo, max(ts_us) AS hi FROM stamps GROUP BY 1) WHERE lo // {S} + 1 <= (hi + {S} - 1) // {S}""")
view("g3", "grid obs", f"""SELECT g.entity_ip, g.a, o.ts_us > (g.a-1)*{S} AS here, o.* EXCLUDE (entity_ip) FROM grid g
  LEFT JOIN obs o ON o.entity_ip = g.entity_ip AND o.ts_us > (g.a-3)*{S} AND o.ts_us <= g.a*{S}""")
view("g6", "grid app", f"""SELECT g.entity_ip, g.a, o.* EXCLUDE (entity_ip) FROM grid g
  LEFT JOIN app o ON o.entity_ip = g.entity_ip AND o.ts_us > (g.a-6)*{S} AND o.ts_us <= g.a*{S}""")
view("l2grid", "own_l2", f"""SELECT sender_ip AS entity_ip, CAST(unnest(generate_series(lo // {S} + 1, (hi + {S} - 1) // {S})) AS BIGINT) AS a
  FROM (SELECT sender_ip, min(ts_us) AS lo, max(ts_us) AS hi FROM own_l2 GROUP BY 1) WHERE lo // {S} + 1 <= (hi + {S} - 1) // {S}""")


def micros(name: str):
    """A mean duration as whole microseconds (an offset keeps .5 ties off the edge)."""
    return F.floor(F.col(name) * 1e6 + 0.2603).cast("long").alias(name)


def one(name: str):
    def run(s, d):
        x = FT.features(obs(s, d), table(s, d, "app"), None, S, [name])
        if name == "flow_duration_mean_30s":
            return x.select("entity_ip", "anchor", micros(name))
        return r6(x.select("entity_ip", "anchor", name), 9 if "rate" in name else 6)
    return run


def fsql(view_name: str, name: str, expr: str) -> str:
    digits = 9 if "rate" in name else 6
    return sql(view_name, f"SELECT entity_ip, a AS anchor, round(CAST({expr} AS DOUBLE), {digits}) AS {name} FROM {view_name} GROUP BY 1, 2")


def c(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond})"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE {a} / CAST({b} AS DOUBLE) END"


N1, HTTP, Q, TLS = c("here"), c("kind='http'"), c("kind='dns_query'"), c("kind='tls'")
TCP1, DATA1 = c("here AND protocol=6"), c("here AND protocol=6 AND tcp_payload_length>0")
SYN1 = c("here AND syn")
ATT3 = c("flow_attempt")
SIMPLE = {
    "F01": ("packet_rate_10s", "g3", f"{N1} / {SEC}.0"),
    "F02": ("byte_rate_10s", "g3", f"coalesce(sum(ip_length) FILTER (WHERE here), 0) / {SEC}.0"),
    "F03": ("mean_ip_len_10s", "g3", "coalesce(avg(ip_length) FILTER (WHERE here), 0)"),
    "F04": ("large_ip_ratio_10s", "g3", ratio(c("here AND ip_length BETWEEN 500 AND 1500"), N1)),
    "F05": ("unique_dst_ip_ratio_30s", "g3", ratio("count(DISTINCT peer_ip) FILTER (WHERE flow_attempt)", ATT3)),
    "F06": ("icmp_ratio_10s", "g3", ratio(c("here AND protocol=1"), N1)),
    "F07": ("flow_attempt_rate_10s", "g3", f"{c('here AND flow_attempt')} / {SEC}.0"),
    "F08": ("syn_rate_10s", "g3", f"{SYN1} / {SEC}.0"),
    "F09": ("syn_completion_ratio_10s", "g3", ratio(f"least({SYN1}, {c('here AND syn_ack')})", SYN1)),
    "F10": ("rst_ratio_10s", "g3", ratio(c("here AND rst"), TCP1)),
    "F11": ("unique_dst_port_ratio_30s", "g3", ratio("count(DISTINCT target_port) FILTER (WHERE flow_attempt AND target_port > 0)", c("flow_attempt AND target_port > 0"))),
    "F12": ("http_error_ratio_60s", "g6", ratio(c("kind='http' AND status>=400"), HTTP)),
    "F13": ("dns_nxdomain_ratio_60s", "g6", f"least(1, {ratio(c(chr(107) + 'ind=' + chr(39) + 'dns_nxdomain' + chr(39)), Q)})"),
    "F14": ("tls_session_rate_60s", "g6", f"count(DISTINCT event_key) FILTER (WHERE kind='tls') / {6 * SEC}.0"),
    "F15": ("ttl_mean_10s", "g3", "coalesce(avg(ttl) FILTER (WHERE here), 0)"),
    "F16": ("fragment_ratio_10s", "g3", ratio(c("here AND fragmented"), N1)),
    "F17": ("protocol_diversity_30s", "g3", ratio("count(DISTINCT protocol)", "count(protocol)")),
    "F18": ("tcp_retransmission_ratio_10s", "g3", ratio(c("here AND retransmission"), DATA1)),
    "F20": ("tx_rx_byte_ratio_30s", "g3", ratio("coalesce(sum(ip_length) FILTER (WHERE outbound), 0)", "coalesce(sum(ip_length), 0)")),
    "F21": ("http_request_rate_60s", "g6", f"{HTTP} / {6 * SEC}.0"),
    "F23": ("http_auth_failure_ratio_60s", "g6", ratio(c("kind='http' AND status IN (401,403)"), HTTP)),
    "F24": ("dns_query_rate_60s", "g6", f"{Q} / {6 * SEC}.0"),
    "F25": ("unique_dns_name_ratio_60s", "g6", f"least(1, {ratio('count(DISTINCT dns_name) FILTER (WHERE kind=' + chr(39) + 'dns_query' + chr(39) + ' AND length(dns_name) > 0)', Q)})"),
    "F26": ("tls_handshake_failure_ratio_60s", "g6", ratio(c("kind='tls' AND tls_version=''"), TLS)),
    "F27": ("tls_version_ratio_60s", "g6", ratio(c("kind='tls' AND contains(tls_version, '1.3')"), c("kind='tls' AND tls_version<>''"))),
    "F28": ("http_status_5xx_ratio_60s", "g6", ratio(c("kind='http' AND status BETWEEN 500 AND 599"), HTTP)),
}
SPECIAL = {
    "F19": ("flow_duration_mean_30s", sql("g3", """SELECT entity_ip, a AS anchor, CAST(floor(coalesce(avg(m), 0) + 0.2603) AS BIGINT) AS flow_duration_mean_30s
      FROM (SELECT entity_ip, a, peer_ip, target_port, protocol, max(flow_duration_us) AS m FROM g3 GROUP BY ALL) GROUP BY 1, 2""")),
    "F22": ("http_method_entropy_60s", sql("g6", """SELECT entity_ip, a AS anchor, round(abs(coalesce(-sum(p * log2(p)), 0)), 6) AS http_method_entropy_60s
      FROM (SELECT entity_ip, a, count(kind) / CAST(sum(count(kind)) OVER (PARTITION BY entity_ip, a) AS DOUBLE) AS p FROM (SELECT * FROM g6 WHERE kind='http') GROUP BY entity_ip, a, method)
      RIGHT JOIN grid USING (entity_ip, a) GROUP BY 1, 2""")),
}
for fid in [f"F{i:02d}" for i in range(1, 29)]:
    if fid in SIMPLE:
        name, v, e = SIMPLE[fid]
        add(f"{fid}_{name}", one(name), fsql(v, name, e))
    else:
        name, text = SPECIAL[fid]
        add(f"{fid}_{name}", one(name), text)


# --- layer 2 ------------------------------------------------------------------------------------

def l2rows(cols):
    def run(s, d):
        x = FT._l2_part(table(s, d, "l2"), S)
        e = FT._expressions(SEC)
        x = x.withColumn("native_vlan", F.lit(0))
        return r6(x.select("entity_ip", "anchor", *[e[k].alias(k) for k in cols]), 9)
    return run


add("F29_arp_request_rate_10s", l2rows(["arp_request_rate_10s"]), sql("l2grid own_l2", f"""
SELECT g.entity_ip, g.a AS anchor, round(count(*) FILTER (WHERE o.arp_request) / {SEC}.0, 9) AS arp_request_rate_10s FROM l2grid g LEFT JOIN own_l2 o
 ON o.sender_ip = g.entity_ip AND o.ts_us > (g.a-1)*{S} AND o.ts_us <= g.a*{S} GROUP BY 1, 2"""))
add("F30_unique_src_mac_30s", l2rows(["unique_src_mac_30s"]), sql("l2grid own_l2", f"""
SELECT g.entity_ip, g.a AS anchor, CAST(count(DISTINCT o.src_mac) AS DOUBLE) AS unique_src_mac_30s FROM l2grid g LEFT JOIN own_l2 o
 ON o.sender_ip = g.entity_ip AND o.ts_us > (g.a-3)*{S} AND o.ts_us <= g.a*{S} GROUP BY 1, 2"""))
MOVES = f"""SELECT entity_ip, a AS anchor, CAST(count(*) FILTER (WHERE pm <> src_mac) AS DOUBLE) AS mac_ip_binding_changes_60s FROM
 (SELECT g.entity_ip, g.a, o.src_mac, lag(o.src_mac) OVER (PARTITION BY g.entity_ip, g.a ORDER BY o.ts_us, o.arrival) AS pm FROM l2grid g LEFT JOIN own_l2 o
 ON o.sender_ip = g.entity_ip AND o.ts_us > (g.a-6)*{S} AND o.ts_us <= g.a*{S}) GROUP BY 1, 2"""
add("F31_mac_ip_binding_changes_60s", l2rows(["mac_ip_binding_changes_60s"]), sql("l2grid own_l2", MOVES))


def f32(s, d):
    x = FT.features(obs(s, d), table(s, d, "app"), None, S, ["history_coverage_s", "eligible_training"])
    return r6(x)


add("F32_history_coverage", f32, sql("grid", f"""WITH st AS (SELECT min(ts_us) AS t0 FROM stamps)
SELECT entity_ip, a AS anchor, round(greatest(0, least({6 * S}, a*{S} - t0)) / 1000000.0, 6) AS history_coverage_s, a*{S} - t0 >= {6 * S} AS eligible_training FROM grid, st"""))
add("F33_counts", lambda s, d: FT.features(obs(s, d), table(s, d, "app"), None, S, FT.COUNTS), sql("g3 g6", f"""
SELECT * FROM (SELECT entity_ip, a AS anchor, CAST({N1} AS BIGINT) AS packet_count_10s, CAST({ATT3} AS BIGINT) AS flow_attempt_count_30s, CAST({SYN1} AS BIGINT) AS syn_count_10s,
 CAST({DATA1} AS BIGINT) AS tcp_data_segment_count_10s FROM g3 GROUP BY 1, 2) JOIN (SELECT entity_ip, a AS anchor, CAST({HTTP} AS BIGINT) AS http_request_count_60s,
 CAST({Q} AS BIGINT) AS dns_query_count_60s, CAST({TLS} AS BIGINT) AS tls_observation_count_60s FROM g6 GROUP BY 1, 2) USING (entity_ip, anchor)"""))


def f34(s, d):
    o = obs(s, d)
    return FT.features(o, table(s, d, "app"), table(s, d, "l2"), S, FT.L2_COUNTS)


def f35(s, d):
    o = obs(s, d)
    x = FT.features(o, table(s, d, "app"), table(s, d, "l2"), S, ["packet_count_10s", "l2_frame_count_30s", "eligible_training", "history_coverage_s"])
    return r6(x)


view("gridb", "obs app", f"""SELECT entity_ip, CAST(unnest(generate_series(lo // {S} + 1, (hi + {S} - 1) // {S})) AS BIGINT) AS a FROM
 (SELECT entity_ip, min(ts_us) AS lo, max(ts_us) AS hi FROM (SELECT entity_ip, ts_us FROM obs UNION ALL SELECT entity_ip, ts_us FROM app) GROUP BY 1)
 WHERE lo // {S} + 1 <= (hi + {S} - 1) // {S}""")
view("allgrid", "gridb l2grid", "SELECT entity_ip, a FROM gridb UNION SELECT entity_ip, a FROM l2grid")
add("F34_l2_counts", f34, sql("allgrid l2grid own_l2 native", f"""
SELECT g.entity_ip, g.a AS anchor, coalesce(any_value(v.native_vlan), 0) AS native_vlan,
 CAST(count(o.arrival) FILTER (WHERE o.arp_request AND o.ts_us > (g.a-1)*{S}) AS BIGINT) AS arp_request_count_10s, CAST(count(o.arrival) AS BIGINT) AS l2_frame_count_30s
FROM allgrid g LEFT JOIN native v ON v.sender_ip = g.entity_ip LEFT JOIN (l2grid k JOIN own_l2 o ON k.entity_ip = o.sender_ip AND o.ts_us > (k.a-3)*{S} AND o.ts_us <= k.a*{S})
 ON k.entity_ip = g.entity_ip AND k.a = g.a GROUP BY 1, 2"""))
add("F35_l2_only_rows", f35, sql("allgrid l2grid own_l2 obs app", f"""
WITH st AS (SELECT least((SELECT min(ts_us) FROM obs), (SELECT min(ts_us) FROM app)) AS t0),
pk AS (SELECT g.entity_ip, g.a, count(*) AS n FROM gridb g JOIN obs o ON o.entity_ip = g.entity_ip AND o.ts_us > (g.a-1)*{S} AND o.ts_us <= g.a*{S} GROUP BY 1, 2),
fr AS (SELECT g.entity_ip, g.a, count(*) AS n FROM l2grid g JOIN own_l2 o ON o.sender_ip = g.entity_ip AND o.ts_us > (g.a-3)*{S} AND o.ts_us <= g.a*{S} GROUP BY 1, 2)
SELECT g.entity_ip, g.a AS anchor, CAST(coalesce(pk.n, 0) AS BIGINT) AS packet_count_10s, CAST(coalesce(fr.n, 0) AS BIGINT) AS l2_frame_count_30s,
 g.a*{S} - t0 >= {6 * S} AS eligible_training, round(greatest(0, least({6 * S}, g.a*{S} - t0)) / 1000000.0, 6) AS history_coverage_s
FROM allgrid g LEFT JOIN pk USING (entity_ip, a) LEFT JOIN fr USING (entity_ip, a) CROSS JOIN st"""))
add("F36_capture_start", lambda s, d: FT.capture_start(obs(s, d), table(s, d, "app")),
    sql("stamps", "SELECT min(ts_us) AS capture_us FROM stamps"))

LIVE = ["packet_count_10s", "flow_attempt_count_30s", "unique_dst_ip_ratio_30s", "flow_duration_mean_30s", "tcp_retransmission_ratio_10s", "http_request_count_60s"]
H = 8
add("F37_live_horizon_rows",
    lambda s, d: r6(FT.features_at_horizon(table(s, d, "packets"), table(s, d, "app"), SCOPE, S, H, LIVE)
                    .withColumn("flow_duration_mean_30s", micros("flow_duration_mean_30s"))),
    sql("flowed app", f"""
WITH hp AS (SELECT *, unnest(generate_series((ts_us + {S} - 1) // {S}, (ts_us + {S} - 1) // {S} + {H - 1})) AS a FROM flowed),
fw AS (SELECT *, row_number() OVER w AS rn, first_value(struct_pack(t := ts_us, s := src_ip, d := dst_ip, sp := src_port, dp := dst_port,
   swap := (protocol=6 AND (tcp_flags & 2)<>0 AND (tcp_flags & 16)<>0), echo := (protocol=1 AND icmp_type=0))) OVER w AS f FROM hp
   WINDOW w AS (PARTITION BY a, flow ORDER BY ts_us, arrival)),
ow AS (SELECT *, CASE WHEN f.swap OR f.echo THEN f.d ELSE f.s END AS entity_ip, CASE WHEN f.swap OR f.echo THEN f.s ELSE f.d END AS peer_ip,
   CASE WHEN f.swap THEN f.sp ELSE f.dp END AS target_port, ts_us - f.t AS dur FROM fw),
ob AS (SELECT *, protocol=6 AND tcp_payload_length>0 AS data, protocol=6 AND tcp_payload_length>0 AND row_number() OVER (PARTITION BY a, src_ip, src_port, dst_ip, dst_port, tcp_seq, (protocol=6 AND tcp_payload_length>0)
   ORDER BY ts_us, arrival) > 1 AS retr FROM ow WHERE entity_ip LIKE '10.10.%'),
w6 AS (SELECT * FROM ob WHERE ts_us > (a-6)*{S}), w3 AS (SELECT * FROM ob WHERE ts_us > (a-3)*{S}), w1 AS (SELECT * FROM ob WHERE ts_us > (a-1)*{S}),
ha AS (SELECT *, unnest(generate_series((ts_us + {S} - 1) // {S}, (ts_us + {S} - 1) // {S} + 5)) AS a FROM app),
keys AS (SELECT entity_ip, a FROM w6 UNION SELECT entity_ip, a FROM ha),
p1 AS (SELECT entity_ip, a, count(*) AS n, count(*) FILTER (WHERE retr) AS r, count(*) FILTER (WHERE data) AS dt FROM w1 GROUP BY 1, 2),
p3 AS (SELECT entity_ip, a, count(*) FILTER (WHERE rn=1) AS att, count(DISTINCT peer_ip) FILTER (WHERE rn=1) AS peers FROM w3 GROUP BY 1, 2),
du AS (SELECT entity_ip, a, avg(m) AS m FROM (SELECT entity_ip, a, max(dur) AS m FROM w3 GROUP BY entity_ip, a, peer_ip, target_port, protocol) GROUP BY 1, 2),
ht AS (SELECT entity_ip, a, count(*) AS n FROM ha WHERE kind='http' GROUP BY 1, 2)
SELECT entity_ip, CAST(a AS BIGINT) AS anchor, CAST(coalesce(p1.n,0) AS BIGINT) AS packet_count_10s, CAST(coalesce(att,0) AS BIGINT) AS flow_attempt_count_30s,
 CASE WHEN coalesce(att,0)=0 THEN 0.0 ELSE round(peers/CAST(att AS DOUBLE),6) END AS unique_dst_ip_ratio_30s, CAST(floor(coalesce(m,0) + 0.2603) AS BIGINT) AS flow_duration_mean_30s,
 CASE WHEN coalesce(dt,0)=0 THEN 0.0 ELSE round(r/CAST(dt AS DOUBLE),6) END AS tcp_retransmission_ratio_10s, CAST(coalesce(ht.n,0) AS BIGINT) AS http_request_count_60s
FROM keys LEFT JOIN p1 USING (entity_ip,a) LEFT JOIN p3 USING (entity_ip,a) LEFT JOIN du USING (entity_ip,a) LEFT JOIN ht USING (entity_ip,a)"""))


def all_features(s, d) -> DataFrame:
    return FT.features(obs(s, d), table(s, d, "app"), None, S)


def flagship(s, d) -> DataFrame:
    """Entities by how many of their windows look like name-service or scan abuse."""
    x = FT.features(obs(s, d), table(s, d, "app"), None, S, [
        "packet_rate_10s", "mean_ip_len_10s", "http_error_ratio_60s", "http_method_entropy_60s",
        "dns_query_count_60s", "dns_nxdomain_ratio_60s", "unique_dns_name_ratio_60s"])
    odd = (F.col("dns_query_count_60s") >= 2) & ((F.col("dns_nxdomain_ratio_60s") >= 0.5) | (F.col("unique_dns_name_ratio_60s") >= 0.8))
    top = x.groupBy("entity_ip").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(odd).alias("odd_windows"),
        F.round(F.max("packet_rate_10s"), 9).alias("max_packet_rate"), F.round(F.max("http_method_entropy_60s"), 6).alias("max_entropy"))
    return top.orderBy(F.col("odd_windows").desc(), "entity_ip").limit(20)


add("flagship_top_entities", flagship, sql("g3 g6", f"""
WITH p AS (SELECT entity_ip, a, {N1} / {SEC}.0 AS pr FROM g3 GROUP BY 1, 2),
q AS (SELECT entity_ip, a, {Q} AS q, least(1, {ratio(c("kind='dns_nxdomain'"), Q)}) AS nx, least(1, {ratio("count(DISTINCT dns_name) FILTER (WHERE kind='dns_query' AND length(dns_name) > 0)", Q)}) AS un FROM g6 GROUP BY 1, 2),
h AS (SELECT entity_ip, a, abs(-sum(m * log2(m))) AS e FROM (SELECT entity_ip, a, count(*) / CAST(sum(count(*)) OVER (PARTITION BY entity_ip, a) AS DOUBLE) AS m FROM g6 WHERE kind='http' GROUP BY entity_ip, a, method) GROUP BY 1, 2)
SELECT entity_ip, CAST(count(*) AS BIGINT) AS windows, CAST(count(*) FILTER (WHERE q >= 2 AND (nx >= 0.5 OR un >= 0.8)) AS BIGINT) AS odd_windows, round(max(pr), 9) AS max_packet_rate, round(max(coalesce(e, 0)), 6) AS max_entropy
FROM p JOIN q USING (entity_ip, a) LEFT JOIN h USING (entity_ip, a) GROUP BY 1 ORDER BY odd_windows DESC, entity_ip LIMIT 20"""))
