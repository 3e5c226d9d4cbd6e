"""Queries R01-R22."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.functions.columns import ceil_bucket
from netlens.operators import features as FT, rules as R, views as V
from netlens.operators.core import materialize
from netlens.plans.adapt import DAY_US, STEP_US as S, sql, table, view
from netlens.plans.q_prep import H, obs
from netlens.plans.registry import add, r6

RES = ["10.10.1.1", "10.10.1.2"]
RL = "('10.10.1.1','10.10.1.2')"
DELTA = 12 * H
TOL = 6 * H

view("qcls", "dns", f"""SELECT q.*, CASE WHEN src_ip NOT IN {RL} THEN 'client' WHEN dest_ip IN {RL} THEN 'inter_resolver'
   WHEN ts_us - cts <= {DELTA} THEN 'forward' ELSE 'own' END AS query_class, CASE WHEN src_ip IN {RL} AND dest_ip NOT IN {RL} AND ts_us - cts <= {DELTA} THEN cl END AS client
 FROM (SELECT q.*, (SELECT max(c.ts_us) FROM dns c WHERE c.dns_event='query' AND c.src_ip NOT IN {RL} AND c.dest_ip IN {RL} AND c.name=q.name AND c.rrtype=q.rrtype AND c.ts_us<=q.ts_us) AS cts,
   (SELECT arg_max(c.src_ip, c.ts_us) FROM dns c WHERE c.dns_event='query' AND c.src_ip NOT IN {RL} AND c.dest_ip IN {RL} AND c.name=q.name AND c.rrtype=q.rrtype AND c.ts_us<=q.ts_us) AS cl
   FROM dns q WHERE q.dns_event='query') q""")
view("qnx", "qcls", """SELECT q.*, n.nx_ts FROM qcls q LEFT JOIN (SELECT src_ip, src_port, dest_ip, dns_id, name, max(ts_us) AS nx_ts FROM dns WHERE dns_event='answer' AND rcode='NXDOMAIN' GROUP BY ALL) n
  USING (src_ip, src_port, dest_ip, dns_id, name)""")


def classified(s, d):
    return V.dns_attribution(table(s, d, "dns"), RES, DELTA, DAY_US)


add("R01_dns_forwards",
    lambda s, d: V.classify_queries(table(s, d, "dns").where("dns_event = 'query'"), RES, DELTA, DAY_US).select("arrival", "src_ip", "query_class"),
    sql("qcls", "SELECT arrival, src_ip, query_class FROM qcls"))
add("R02_dns_attribution", lambda s, d: V.attribution_counts(classified(s, d)), sql("qnx", """
SELECT 'resolver' AS section, src_ip||'|'||query_class||'|'||CASE WHEN nx_ts IS NULL THEN 'ok' ELSE 'NX' END AS key, CAST(count(*) AS BIGINT) AS n FROM qnx WHERE query_class<>'client' GROUP BY 2
UNION ALL SELECT 'client', client, CAST(count(*) AS BIGINT) FROM qnx WHERE query_class='forward' GROUP BY 2
UNION ALL SELECT 'own_domain', CASE WHEN len(string_split(name,'.'))>2 THEN substr(name, instr(name,'.')+1) ELSE name END, CAST(count(*) AS BIGINT) FROM qnx WHERE query_class='own' GROUP BY 2"""))


def dview(s, d, ev=None):
    return V.dns_view(table(s, d, "dns", ev), RES, S, DELTA, DAY_US)


view("dview", "qnx", f"""SELECT src_ip AS entity_ip, CAST(a AS BIGINT) AS anchor, CAST(count(*) FILTER (WHERE query_class<>'forward') AS BIGINT) AS dnsh_queries_60s,
  CASE WHEN count(*) FILTER (WHERE query_class<>'forward')=0 THEN 0.0 ELSE count(*) FILTER (WHERE query_class<>'forward' AND nx_ts <= a*{S}) / CAST(count(*) FILTER (WHERE query_class<>'forward') AS DOUBLE) END AS dnsh_nxdomain_ratio_60s,
  CASE WHEN count(*) FILTER (WHERE query_class<>'forward')=0 THEN 0.0 ELSE count(DISTINCT name) FILTER (WHERE query_class<>'forward') / CAST(count(*) FILTER (WHERE query_class<>'forward') AS DOUBLE) END AS dnsh_unique_names_ratio_60s,
  CAST(count(*) FILTER (WHERE query_class='forward') AS BIGINT) AS dnsh_forwards_excluded_60s
 FROM (SELECT *, unnest(generate_series((ts_us+{S}-1)//{S}, (ts_us+{S}-1)//{S}+5)) AS a FROM qnx) GROUP BY 1, 2""")
add("R03_dns_view", lambda s, d: r6(dview(s, d)), sql("dview", """SELECT entity_ip, anchor, dnsh_queries_60s, round(dnsh_nxdomain_ratio_60s,6) AS dnsh_nxdomain_ratio_60s,
 round(dnsh_unique_names_ratio_60s,6) AS dnsh_unique_names_ratio_60s, dnsh_forwards_excluded_60s FROM dview"""))


def web(s, d, ev=None):
    return table(s, d, "http", ev), table(s, d, "packets", ev)


view("wpair", "http", """SELECT *, least(src_ip||':'||src_port, dest_ip||':'||dest_port)||'|'||greatest(src_ip||':'||src_port, dest_ip||':'||dest_port) AS pair FROM http""")
view("fpair", "packets", """SELECT *, least(src_ip||':'||src_port, dst_ip||':'||dst_port)||'|'||greatest(src_ip||':'||src_port, dst_ip||':'||dst_port) AS pair FROM packets WHERE protocol=6""")
view("wev", "wpair fpair", f"""SELECT w.*, f.frame_ts FROM wpair w LEFT JOIN (SELECT w.arrival, min(f.ts_us) AS frame_ts FROM wpair w JOIN fpair f ON w.pair=f.pair AND f.ts_us BETWEEN w.ts_us-{TOL} AND w.ts_us+{TOL} GROUP BY 1) f USING (arrival)""")
add("R04_http_evidence", lambda s, d: V.http_evidence(*web(s, d), TOL, DAY_US).select("arrival", "frame_ts"), sql("wev", "SELECT arrival, frame_ts FROM wev"))


def hview(s, d, ev=None):
    return V.http_view(*web(s, d, ev), S, TOL, DAY_US)


view("hview", "wev", f"""SELECT src_ip AS entity_ip, CAST(a AS BIGINT) AS anchor, CAST(count(*) FILTER (WHERE frame_ts<=a*{S}) AS BIGINT) AS httph_requests_60s,
  CASE WHEN count(*) FILTER (WHERE frame_ts<=a*{S})=0 THEN 0.0 ELSE count(*) FILTER (WHERE frame_ts<=a*{S} AND status IN (401,403)) / CAST(count(*) FILTER (WHERE frame_ts<=a*{S}) AS DOUBLE) END AS httph_auth_failure_ratio_60s,
  CAST(count(*) FILTER (WHERE frame_ts IS NULL OR frame_ts>a*{S}) AS BIGINT) AS httph_late_excluded_60s
 FROM (SELECT *, unnest(generate_series((ts_us+{S}-1)//{S}, (ts_us+{S}-1)//{S}+5)) AS a FROM wev) GROUP BY 1, 2""")
add("R05_http_view", lambda s, d: r6(hview(s, d)),
    sql("hview", "SELECT entity_ip, anchor, httph_requests_60s, round(httph_auth_failure_ratio_60s,6) AS httph_auth_failure_ratio_60s, httph_late_excluded_60s FROM hview"))

# --- rules: thresholds fit the sparse events --------------------------------------------------------
TH = R.with_overrides({
    "brute_force": {"min_http_req_60s": 2, "min_auth_fail_ratio_60s": 0.6},
    "port_scan": {"min_flow_attempt_30s": 2, "min_flow_attempt_burst_30s": 4, "max_syn_completion_burst_10s": 0.5, "min_unique_dst_port_ratio_30s": 0.9},
    "http_abuse": {"min_http_req_60s": 3, "max_auth_fail_ratio_60s": 0.6},
    "dns_entropy": {"min_queries_60s": 3, "min_unique_names_ratio_60s": 0.9},
})


def with_views(s, d):
    keys = ["entity_ip", "anchor"]
    cols = ["flow_attempt_count_30s", "unique_dst_port_ratio_30s", "syn_completion_ratio_10s"]
    ev = materialize(table(s, d, "ev"))  # a dozen branches read the parsed events
    f = FT.features(obs(s, d, ev), table(s, d, "app", ev), None, S, cols)
    return f.join(hview(s, d, ev), keys, "full_outer").join(dview(s, d, ev), keys, "full_outer")


view("scanf", "g3", """SELECT entity_ip, a AS anchor, count(*) FILTER (WHERE flow_attempt) AS fa,
  CASE WHEN count(*) FILTER (WHERE flow_attempt AND target_port>0)=0 THEN 0 ELSE count(DISTINCT target_port) FILTER (WHERE flow_attempt AND target_port>0) / CAST(count(*) FILTER (WHERE flow_attempt AND target_port>0) AS DOUBLE) END AS up,
  CASE WHEN count(*) FILTER (WHERE here AND syn)=0 THEN 0 ELSE least(count(*) FILTER (WHERE here AND syn), count(*) FILTER (WHERE here AND syn_ack)) / CAST(count(*) FILTER (WHERE here AND syn) AS DOUBLE) END AS sc
  FROM g3 GROUP BY 1, 2""")
view("fire", "scanf hview dview", """SELECT entity_ip, anchor, coalesce(httph_requests_60s>=2 AND httph_auth_failure_ratio_60s>=0.6, false) AS brute_force,
  coalesce(fa,0)>=2 AND coalesce(up,0)>=0.9 AND coalesce(sc,0)<=0.3 AS scan_normal, coalesce(fa,0)>=4 AND coalesce(sc,0)<=0.5 AND coalesce(up,0)>=0.1 AS scan_burst,
  coalesce(httph_requests_60s>=3 AND httph_auth_failure_ratio_60s<0.6, false) AS http_abuse,
  coalesce(dnsh_queries_60s>=3 AND (dnsh_nxdomain_ratio_60s>=0.5 OR dnsh_unique_names_ratio_60s>=0.9), false) AS dns_entropy
  FROM scanf FULL JOIN hview USING (entity_ip, anchor) FULL JOIN dview USING (entity_ip, anchor)""")


def one_rule(name):
    def run(s, d):
        x = with_views(s, d)
        return x.where(R.fired(x.columns, TH)[name]).select("entity_ip", "anchor")
    return run


for rid, name, col in (("R06", "brute_force", "brute_force"), ("R07", "port_scan_normal", "scan_normal"), ("R08", "port_scan_burst", "scan_burst"),
                       ("R09", "http_abuse", "http_abuse"), ("R10", "dns_entropy", "dns_entropy")):
    add(f"{rid}_{name}", one_rule(name), sql("fire", f"SELECT entity_ip, anchor FROM fire WHERE {col}"))


def r11(s, d):
    x = R.top_rule(R.all_rules(with_views(s, d), TH))
    return x.where("top is not null").select("entity_ip", "anchor", "top.rule", "top.action")


add("R11_top_rule", r11, sql("fire", """SELECT entity_ip, anchor, CASE WHEN brute_force THEN 'brute_force' WHEN scan_normal OR scan_burst THEN 'port_scan' WHEN http_abuse THEN 'http_abuse' ELSE 'dns_entropy' END AS rule,
  CASE WHEN brute_force OR scan_normal OR scan_burst THEN 'BLOCK' ELSE 'LIMIT' END AS action FROM fire WHERE brute_force OR scan_normal OR scan_burst OR http_abuse OR dns_entropy"""))


def r12(s, d):
    x = R.all_rules(with_views(s, d), TH)
    return x.where(F.size("rules") > 0).select(
        "entity_ip", "anchor", F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["rule"], r["action"])), ",").alias("fired"))


add("R12_all_rules", r12, sql("fire", """SELECT entity_ip, anchor, array_to_string(list_filter([CASE WHEN brute_force THEN 'brute_force:BLOCK' END,
  CASE WHEN scan_normal OR scan_burst THEN 'port_scan:BLOCK' END, CASE WHEN http_abuse THEN 'http_abuse:LIMIT' END, CASE WHEN dns_entropy THEN 'dns_entropy:LIMIT' END], lambda x: x IS NOT NULL), ',') AS fired
  FROM fire WHERE brute_force OR scan_normal OR scan_burst OR http_abuse OR dns_entropy"""))


def r13(s, d):
    dims = R.threshold_table(s, {"deployed": TH, "strict": R.with_overrides({"dns_entropy": {"min_queries_60s": 4}, "brute_force": {"min_http_req_60s": 3}})})
    x = with_views(s, d).join(F.broadcast(dims))  # two threshold versions
    hits = R.fired(x.columns, None)
    return x.groupBy("version").agg(F.count_if(hits["dns_entropy"]).alias("dns_entropy"), F.count_if(hits["brute_force"]).alias("brute_force"))


add("R13_threshold_versions", r13, sql("hview dview", """SELECT 'deployed' AS version,
  CAST((SELECT count(*) FROM dview WHERE dnsh_queries_60s>=3 AND (dnsh_nxdomain_ratio_60s>=0.5 OR dnsh_unique_names_ratio_60s>=0.9)) AS BIGINT) AS dns_entropy,
  CAST((SELECT count(*) FROM hview WHERE httph_requests_60s>=2 AND httph_auth_failure_ratio_60s>=0.6) AS BIGINT) AS brute_force
 UNION ALL SELECT 'strict', CAST((SELECT count(*) FROM dview WHERE dnsh_queries_60s>=4 AND (dnsh_nxdomain_ratio_60s>=0.5 OR dnsh_unique_names_ratio_60s>=0.8)) AS BIGINT),
  CAST((SELECT count(*) FROM hview WHERE httph_requests_60s>=3 AND httph_auth_failure_ratio_60s>=0.8) AS BIGINT)"""))

# --- decisions ---------------------------------------------------------------------------------------
CNT = ["packet_count_10s", "http_request_count_60s", "dns_query_count_60s", "tls_observation_count_60s", "http_auth_failure_ratio_60s"]


def scored(s, d):
    x = FT.features(obs(s, d), table(s, d, "app"), None, S, CNT)
    return x.withColumn("score", -0.3 - (F.col("http_request_count_60s") + F.col("packet_count_10s")) / 20.0)


view("cnts", "g3 g6", """SELECT entity_ip, anchor, n, h, q, t, au, -0.3 - (h + n) / 20.0 AS score FROM
 (SELECT entity_ip, a AS anchor, count(*) FILTER (WHERE here) AS n FROM g3 GROUP BY 1, 2) JOIN (SELECT entity_ip, a AS anchor, count(*) FILTER (WHERE kind='http') AS h, count(*) FILTER (WHERE kind='dns_query') AS q,
   count(*) FILTER (WHERE kind='tls') AS t, CASE WHEN count(*) FILTER (WHERE kind='http')=0 THEN 0 ELSE count(*) FILTER (WHERE kind='http' AND status IN (401,403)) / CAST(count(*) FILTER (WHERE kind='http') AS DOUBLE) END AS au FROM g6 GROUP BY 1, 2) USING (entity_ip, anchor)""")
view("decided", "cnts", """SELECT *, CASE WHEN n=0 AND h=0 AND q=0 AND t=0 THEN 'empty_window_heuristic' WHEN n=0 THEN 'no_live_packets_heuristic' ELSE 'iforest' END AS detector_name,
  CASE WHEN n>0 AND score < -0.42 THEN 'ALERT' ELSE 'PERMIT' END AS decision, CASE WHEN n>0 THEN score END AS sc FROM cnts""")
add("R14_decide", lambda s, d: r6(R.decide(scored(s, d), -0.42).select("entity_ip", "anchor", "detector_name", "decision", "score")),
    sql("decided", "SELECT entity_ip, anchor, detector_name, decision, round(CAST(sc AS DOUBLE), 6) AS score FROM decided"))


def r15(s, d):
    x = R.decide(scored(s, d), -0.42).join(hview(s, d), ["entity_ip", "anchor"], "left")
    x = R.auth_failure(x, 2, 0.6)
    return x.select("entity_ip", "anchor", "decision", "detector_name", "decision_model", "auth_historic", "auth_authorises")


view("authd", "decided hview", """SELECT entity_ip, anchor, CASE WHEN decision='PERMIT' AND v THEN 'ALERT' ELSE decision END AS decision,
  CASE WHEN decision='PERMIT' AND v THEN 'auth_failure_heuristic' ELSE detector_name END AS detector_name, decision AS decision_model, h>=2 AND au>=0.6 AS auth_historic, decision='PERMIT' AND v AS auth_authorises, sc
  FROM (SELECT d.*, coalesce(httph_requests_60s>=2 AND httph_auth_failure_ratio_60s>=0.6, false) AS v FROM decided d LEFT JOIN hview USING (entity_ip, anchor))""")
add("R15_auth_failure", r15, sql("authd", "SELECT * EXCLUDE (sc) FROM authd"))


def r16(s, d):
    w = table(s, d, "app").select("entity_ip", ceil_bucket(F.col("ts_us"), S).alias("anchor")).distinct()
    return R.complete_windows(w, table(s, d, "packets"), S).select("entity_ip", "anchor", "complete")


add("R16_window_completeness", r16, sql("app packets", f"""SELECT DISTINCT entity_ip, CAST((ts_us+{S}-1)//{S} AS BIGINT) AS anchor,
  (SELECT max(ts_us) FROM packets) >= ((ts_us+{S}-1)//{S})*{S} + 5000 AS complete FROM app"""))


def r17(s, d):
    app, o = table(s, d, "app"), obs(s, d)
    b = ceil_bucket(F.col("ts_us"), S).alias("anchor")
    pending = app.where("arrival % 2 = 0").select("entity_ip", b).distinct()
    rows = app.where("arrival % 3 > 0").groupBy("entity_ip", b).agg((F.max("arrival") % 7 > 0).alias("eligible"))
    content = o.select("entity_ip", b)
    t1 = table(s, d, "ev").agg(F.max("ts_us")).first()[0]
    return R.window_status(pending, rows, content, S, t1 - 3 * DAY_US, t1, 2 * DAY_US)


add("R17_window_status", r17, sql("app obs", f"""
WITH t AS (SELECT max(ts_us) AS t1 FROM ev), p AS (SELECT DISTINCT entity_ip, (ts_us+{S}-1)//{S} AS a, true AS p FROM app WHERE arrival%2=0),
r AS (SELECT entity_ip, (ts_us+{S}-1)//{S} AS a, max(arrival)%7>0 AS el FROM app WHERE arrival%3>0 GROUP BY 1, 2), c AS (SELECT DISTINCT entity_ip, (ts_us+{S}-1)//{S} AS a, true AS hc FROM obs),
x AS (SELECT entity_ip, a, el, hc, a*{S} > t1-{3 * DAY_US} AS late, t1-a*{S} > {2 * DAY_US} AS old FROM p FULL JOIN r USING (entity_ip, a) LEFT JOIN c USING (entity_ip, a), t)
SELECT entity_ip, CAST(a AS BIGINT) AS anchor, CASE WHEN late AND NOT old THEN 'pending' WHEN late THEN 'not_evaluated' WHEN el THEN 'decided' WHEN el IS NOT NULL THEN 'not_evaluated' WHEN hc THEN 'not_evaluated' ELSE 'cancelled' END AS status,
 CASE WHEN late AND NOT old THEN '' WHEN late THEN 'pcap_incompleto' WHEN el THEN '' WHEN el IS NOT NULL THEN 'no_elegible' WHEN hc THEN (CASE WHEN old THEN 'ventana_no_regenerada' ELSE 'fila_no_generada' END) ELSE 'sin_contenido_en_su_horizonte' END AS reason FROM x"""))


def r18(s, d):
    app, pk = table(s, d, "app"), table(s, d, "packets")
    t = app.agg(F.min("ts_us")).first()[0], pk.agg(F.min("ts_us")).first()[0]
    w = app.select("entity_ip", ceil_bucket(F.col("ts_us"), S).alias("anchor")).distinct()
    return R.full_history(w, t[1], t[0], S, 11 * S)


add("R18_full_history", r18, sql("app", f"""SELECT DISTINCT entity_ip, CAST((ts_us+{S}-1)//{S} AS BIGINT) AS anchor, ((ts_us+{S}-1)//{S}-11)*{S} >= (SELECT min(ts_us) FROM app) AS full_history FROM app"""))


def r19(s, d):
    x = table(s, d, "dec")
    now = x.agg(F.max("logged_us")).first()[0]
    return R.sustained(x, now, 20 * DAY_US, 3, "iforest", ["10.10.1.64/26"], ["10.10.1.20", "10.10.1.21"])


add("R19_sustained", r19, sql("dec", f"""SELECT entity_ip, CAST(count(*) AS BIGINT) AS alerts, max(logged_us) AS last_us FROM dec WHERE decision='ALERT' AND detector_name='iforest'
 AND logged_us >= (SELECT max(logged_us) FROM dec) - {20 * DAY_US} AND split_part(entity_ip,'.',4) NOT IN ('1','2','254') AND entity_ip NOT IN ('10.10.1.20','10.10.1.21')
 AND NOT (entity_ip LIKE '10.10.1.%' AND CAST(split_part(entity_ip,'.',4) AS INT) BETWEEN 64 AND 127) GROUP BY 1 HAVING count(*) >= 3"""))


def episodes_of(s, d):
    """Every signup opens an episode of twelve hours for its user."""
    return table(s, d, "app").where("kind = 'tls'").select(
        "entity_ip", F.col("arrival").alias("episode_id"), F.col("ts_us").alias("t0_us"), (F.col("ts_us") + F.lit(12 * H)).alias("t1_us"))


view("eps", "app", f"SELECT entity_ip, arrival AS episode_id, ts_us AS t0_us, ts_us + {12 * H} AS t1_us FROM app WHERE kind='tls'")


def r20(s, d):
    grid = s.createDataFrame([(n, u) for n in (1, 2, 3) for u in (0.5, 0.8, 0.9)], "min_queries int, min_unique double")
    return R.grid_summary(R.dns_rule_grid(dview(s, d), grid, 0.5), episodes_of(s, d), S, 6 * H, DAY_US)


add("R20_dns_rule_grid", r20, sql("dview eps", f"""
WITH g AS (SELECT CAST(n AS INT) AS min_queries, u AS min_unique FROM (VALUES (1),(2),(3)) a(n), (VALUES (CAST(0.5 AS DOUBLE)),(0.8),(0.9)) b(u)),
h AS (SELECT d.*, d.anchor*{S} AS e, g.* FROM dview d JOIN g ON dnsh_queries_60s >= min_queries AND (dnsh_nxdomain_ratio_60s >= 0.5 OR dnsh_unique_names_ratio_60s >= min_unique)),
i AS (SELECT min_queries, min_unique, episode_id, min(e) AS f, any_value(t1_us) AS t1 FROM h JOIN eps USING (entity_ip) WHERE e > t0_us AND e <= t1_us + {6 * H} GROUP BY 1, 2, 3),
o AS (SELECT min_queries, min_unique, count(*) AS n, count(DISTINCT entity_ip) AS m FROM h WHERE NOT EXISTS (SELECT 1 FROM eps x WHERE x.entity_ip=h.entity_ip AND e > t0_us AND e <= t1_us + {6 * H}) GROUP BY 1, 2)
SELECT min_queries, min_unique, CAST(coalesce(r,0) AS BIGINT) AS reached, CAST(coalesce(b,0) AS BIGINT) AS before_end, CAST(coalesce(n,0) AS BIGINT) AS outside, CAST(coalesce(m,0) AS BIGINT) AS outside_entities
FROM (SELECT min_queries, min_unique, count(*) AS r, count(*) FILTER (WHERE f<=t1) AS b FROM i GROUP BY 1, 2) FULL JOIN o USING (min_queries, min_unique)"""))
add("R21_worst_cases", lambda s, d: R.worst_cases(dview(s, d), ["10.10.1.7"]), sql("dview", """SELECT entity_ip, max(dnsh_queries_60s) AS max_own, arg_max(anchor, (dnsh_queries_60s, anchor)) AS anchor,
 max(dnsh_forwards_excluded_60s) AS max_forwards FROM dview WHERE entity_ip<>'10.10.1.7' GROUP BY 1"""))


def r22(s, d):
    a = R.decide(scored(s, d), -0.42)
    b = R.auth_failure(a.join(hview(s, d), ["entity_ip", "anchor"], "left"), 2, 0.6)
    return r6(R.decision_diff(a, b.where("anchor % 7 > 0"), -0.42))


add("R22_decision_diff", r22, sql("decided authd", """SELECT entity_ip, anchor, d.decision AS decision_a, d.detector_name AS detector_name_a, round(CAST(d.sc AS DOUBLE),6) AS score_a, a.decision AS decision_b, a.detector_name AS detector_name_b,
 round(CAST(a.sc AS DOUBLE),6) AS score_b, CASE WHEN a.decision IS NULL THEN 'only_a' ELSE 'both' END AS side, CASE WHEN d.sc IS NOT NULL THEN (CASE WHEN d.sc < -0.42 THEN 'ALERT' ELSE 'PERMIT' END) END AS model_only,
 d.sc IS DISTINCT FROM a.sc AS score_changed FROM decided d LEFT JOIN (SELECT * FROM authd WHERE anchor%7>0) a USING (entity_ip, anchor)
 WHERE a.decision IS NULL OR a.decision<>d.decision OR a.detector_name<>d.detector_name"""))
