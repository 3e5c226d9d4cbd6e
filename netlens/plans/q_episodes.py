"""Queries E01-E24."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.functions.columns import ceil_bucket
from netlens.operators import episodes as E, prep
from netlens.operators.core import idiv
from netlens.plans.adapt import DAY_US as D, STEP_US as S, sql, table, view
from netlens.plans.q_prep import H
from netlens.plans.q_rules import episodes_of
from netlens.plans.registry import add, r6

U = 1_000_000
CONDITIONS = ["suricata", "modelo", "reglas", "combinado"]


def detections(s, d):
    x = table(s, d, "ev").select(
        F.floor(F.col("event_id") / 4).cast("long").alias("episode_id"), F.element_at(F.array(*map(F.lit, CONDITIONS)), (F.col("event_id") % 4 + 1).cast("int")).alias("condition"), "k", "event_type")
    ep = F.col("episode_id")
    return x.select(
        "episode_id", "condition", F.concat(F.lit("f"), (ep % 7).cast("string")).alias("family"), (ep % 7 < 3).alias("with_signature"),
        (F.col("k") % 9 > 0).alias("measured"), F.when(F.col("event_type") != "view", F.col("k") / 4.0 + 0.13).alias("latency_s"))


view("det", "ev", """SELECT event_id//4 AS episode_id, list_value('suricata','modelo','reglas','combinado')[event_id%4+1] AS condition, 'f'||((event_id//4)%7) AS family, (event_id//4)%7<3 AS with_signature,
  k%9>0 AS measured, CASE WHEN event_type<>'view' THEN k/CAST(4 AS DOUBLE)+0.13 END AS latency_s FROM ev""")
add("E01_compare_conditions", lambda s, d: E.compare_conditions(detections(s, d)), sql("det", """
WITH g AS (SELECT 'family:'||family AS "group", * FROM det UNION ALL SELECT CASE WHEN with_signature THEN 'with_signature' ELSE 'without_signature' END, * FROM det)
SELECT "group", condition, CAST(count(*) FILTER (WHERE measured) AS BIGINT) AS n, CAST(count(latency_s) FILTER (WHERE measured) AS BIGINT) AS detected, CAST(count(*) FILTER (WHERE NOT measured) AS BIGINT) AS not_measured,
 round(min(latency_s) FILTER (WHERE measured),1) AS latency_min_s, round(max(latency_s) FILTER (WHERE measured),1) AS latency_max_s, round(quantile_cont(latency_s,0.5) FILTER (WHERE measured),1) AS latency_median_s FROM g GROUP BY 1, 2"""))
add("E02_validate_eval",
    lambda s, d: E.validate_eval(detections(s, d).withColumn("latency_s", F.when(F.col("latency_s") < 2, -1.0).otherwise(F.col("latency_s")))
        .withColumn("condition", F.when(F.col("episode_id") % 50 == 0, "reglas").otherwise(F.col("condition"))), CONDITIONS[:3]).groupBy("problem").agg(F.count(F.lit(1)).alias("n")),
    sql("det", """WITH x AS (SELECT episode_id, CASE WHEN episode_id%50=0 THEN 'reglas' ELSE condition END AS c, measured, latency_s<2 AS neg FROM det)
SELECT 'repeated episode' AS problem, CAST(count(DISTINCT episode_id) AS BIGINT) AS n FROM (SELECT episode_id FROM x GROUP BY episode_id, c HAVING count(*)>1)
UNION ALL SELECT 'unknown condition', CAST(count(DISTINCT episode_id) AS BIGINT) FROM x WHERE c='combinado' UNION ALL SELECT 'latency must be seconds >= 0', CAST(count(DISTINCT episode_id) AS BIGINT) FROM x WHERE measured AND neg"""))

# --- runs -------------------------------------------------------------------------------------------
NAMES = ["requests", "queries"]


def run_of(s, d, keep):
    a = table(s, d, "app").where(keep)
    x = a.groupBy("entity_ip", ceil_bucket(F.col("ts_us"), S).alias("anchor")).agg(
        F.count_if(F.col("kind") == "http").alias("requests"), F.count_if(F.col("kind") == "dns_query").alias("queries"))
    x = x.withColumn("score", F.when((F.col("requests") + F.col("queries")) > 0, -0.5 - F.col("requests") / 20.0 - F.col("queries") / 30.0))
    rules = F.concat_ws(",", F.when(F.col("requests") >= 2, F.lit("http_abuse")), F.when(F.col("queries") >= 2, F.lit("dns_entropy")))
    return x.withColumns({"decision": F.when(F.col("score") < -0.57, "ALERT").otherwise("PERMIT"), "rules": rules})


for n, cond in (("runa", "true"), ("runb", "arrival%50<>0")):
    view(n, "app", f"""SELECT *, CASE WHEN score < -0.57 THEN 'ALERT' ELSE 'PERMIT' END AS decision, concat_ws(',', CASE WHEN requests>=2 THEN 'http_abuse' END, CASE WHEN queries>=2 THEN 'dns_entropy' END) AS rules,
     CASE WHEN score IS NULL THEN 'sin_score' WHEN score < {E.ALPHAS['0.01']} THEN '0.01' WHEN score < {E.ALPHAS['0.03']} THEN '0.03' WHEN score < {E.ALPHAS['0.05']} THEN '0.05' ELSE 'normal' END AS cls FROM
     (SELECT *, CASE WHEN requests+queries>0 THEN -0.5-requests/CAST(20 AS DOUBLE)-queries/CAST(30 AS DOUBLE) END AS score FROM
      (SELECT entity_ip, (ts_us+{S}-1)//{S} AS anchor, count(*) FILTER (WHERE kind='http') AS requests, count(*) FILTER (WHERE kind='dns_query') AS queries FROM app WHERE {cond} GROUP BY 1, 2))""")
MET = {
    "only_ref": "count(*) FILTER (WHERE b.anchor IS NULL)", "only_other": "count(*) FILTER (WHERE a.anchor IS NULL)", "common": "count(*) FILTER (WHERE ab)",
    "equal_vectors": "count(*) FILTER (WHERE ab AND a.requests=b.requests AND a.queries=b.queries)", "different_vectors": "count(*) FILTER (WHERE ab AND NOT (a.requests=b.requests AND a.queries=b.queries))",
    "equal_scores": "count(*) FILTER (WHERE ab AND a.score IS NOT DISTINCT FROM b.score)", "equal_decisions": "count(*) FILTER (WHERE ab AND a.decision=b.decision)",
    "equal_alpha_class": "count(*) FILTER (WHERE ab AND a.cls=b.cls)", "equal_rules": "count(*) FILTER (WHERE ab AND a.rules=b.rules)",
}
for al, u in E.ALPHAS.items():
    MET[f"alerts_{al}_ref"] = f"count(*) FILTER (WHERE a.score < {u})"
    MET[f"alerts_{al}_other"] = f"count(*) FILTER (WHERE b.score < {u})"
for nme in NAMES:
    MET[f"differs_{nme}"] = f"count(*) FILTER (WHERE ab AND a.{nme}<>b.{nme})"
    MET[f"max_abs_{nme}"] = f"max(CASE WHEN ab AND a.{nme}<>b.{nme} THEN abs(a.{nme}-b.{nme}) END)"
add("E03_run_diff", lambda s, d: E.run_diff(run_of(s, d, "true"), run_of(s, d, "arrival % 50 <> 0"), NAMES), sql("runa runb", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST({e.replace('a.', 'x.a_').replace('b.', 'x.b_')} AS DOUBLE) AS value FROM x" for m, e in MET.items())).replace("\nSELECT 'only_ref'", """,
x AS (SELECT a.anchor AS a_anchor, b.anchor AS b_anchor, a.anchor IS NOT NULL AND b.anchor IS NOT NULL AS ab, a.requests AS a_requests, b.requests AS b_requests, a.queries AS a_queries, b.queries AS b_queries, a.score AS a_score, b.score AS b_score,
 a.decision AS a_decision, b.decision AS b_decision, a.cls AS a_cls, b.cls AS b_cls, a.rules AS a_rules, b.rules AS b_rules FROM runa a FULL JOIN runb b ON a.entity_ip=b.entity_ip AND a.anchor=b.anchor)
SELECT 'only_ref'""", 1))


def e04(s, d):
    x = table(s, d, "dec").withColumn("latency_s", F.col("k") / 8.0)
    c = table(s, d, "ev").select((F.col("k") % 7).alias("pending"), (F.col("k") / 16.0).alias("wait_s"), (F.col("event_id") % 1000 / 32.0).alias("duration_s"), (F.col("event_type") == "signup").alias("starting"))
    return r6(E.availability(x, c))


add("E04_availability", e04, sql("dec ev", """
WITH v AS (SELECT 'decision' AS series, k/CAST(8 AS DOUBLE) AS v FROM dec UNION ALL SELECT CASE WHEN score IS NULL THEN 'decision_unscored' ELSE 'decision_scored' END, k/CAST(8 AS DOUBLE) FROM dec
 UNION ALL SELECT 'packet_wait', k/CAST(16 AS DOUBLE) FROM ev UNION ALL SELECT 'cycle', (event_id%1000)/CAST(32 AS DOUBLE) FROM ev WHERE event_type<>'signup' UNION ALL SELECT 'pending', CAST(k%7 AS DOUBLE) FROM ev),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY v)-1 AS i, count(*) OVER (PARTITION BY series) AS n FROM v)
SELECT series, CAST(any_value(n) AS BIGINT) AS n, max(v) AS max, round(avg(v),6) AS mean, max(v) FILTER (WHERE i=round_even(0.5*(n-1),0)) AS p50, max(v) FILTER (WHERE i=round_even(0.9*(n-1),0)) AS p90, max(v) FILTER (WHERE i=round_even(0.99*(n-1),0)) AS p99 FROM r GROUP BY 1"""))


def decs(s, d):
    x = table(s, d, "dec")
    rules = F.filter(F.array("rule1", "rule2"), lambda r: r != "")
    return x.select("decision_id", "entity_ip", "window_us", (F.col("window_us") + F.col("k").cast("long") * U).alias("logged_us"), "score", "decision", "detector_name", rules.alias("rules"), "k")


view("decs", "dec", f"SELECT decision_id, entity_ip, window_us, window_us+CAST(k AS BIGINT)*{U} AS logged_us, score, decision, detector_name, rule1, rule2, k FROM dec")


def eps(s, d):
    x = episodes_of(s, d)
    rule = F.element_at(F.array(F.lit("dns_entropy"), F.lit("port_scan"), F.lit("brute_force")), (F.col("episode_id") % 3 + 1).cast("int"))
    return x.withColumns({"expected_rule": rule, "scenario": F.concat(F.lit("s"), (F.col("episode_id") % 4).cast("string"))})


view("epx", "eps", "SELECT *, list_value('dns_entropy','port_scan','brute_force')[episode_id%3+1] AS expected_rule, 's'||(episode_id%4) AS scenario FROM eps")
LEAD, TAIL = 6 * H, 18 * H
AL = [(a.replace(".", "_"), u) for a, u in E.ALPHAS.items()]
add("E05_episode_hits", lambda s, d: E.episode_hits(decs(s, d), eps(s, d), LEAD, TAIL, D), sql("decs epx", f"""
SELECT e.episode_id, any_value(expected_rule) AS expected_rule, min(logged_us) FILTER (WHERE rule1=expected_rule OR rule2=expected_rule) - any_value(t0_us) AS rule_delay_us,
 min(logged_us) FILTER (WHERE rule1=expected_rule OR rule2=expected_rule) <= any_value(t1_us) AS before_end, {', '.join(f"min(logged_us) FILTER (WHERE score < {u}) - any_value(t0_us) AS if_{a}_delay_us" for a, u in AL)}
FROM epx e LEFT JOIN decs d ON d.entity_ip=e.entity_ip AND window_us > t0_us-{LEAD} AND window_us <= t1_us+{TAIL} GROUP BY 1"""))
ORIGIN = "10.10.1.12"


CFG = {"HEUR": "{h}", **{f"IF_{a}": f"coalesce(score < {u}, false)" for a, u in E.ALPHAS.items()}, **{f"HIB_{a}": f"(coalesce(score < {u}, false) OR {{h}})" for a, u in E.ALPHAS.items()}}
add("E06_seven_configs", lambda s, d: E.seven_configs(decs(s, d), eps(s, d), ORIGIN, LEAD, TAIL, D), sql("decs epx", " UNION ALL ".join(f"""
SELECT '{c}' AS config, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT episode_id FROM decs d JOIN epx e ON d.entity_ip=e.entity_ip AND d.entity_ip='{ORIGIN}' AND window_us > t0_us-{LEAD} AND window_us <= t1_us+{TAIL} WHERE {x.format(h='(rule1=expected_rule OR rule2=expected_rule)')} GROUP BY 1)) AS detected,
 (SELECT CAST(coalesce(sum(m),0) AS BIGINT) FROM (SELECT min(logged_us)-any_value(t0_us) AS m FROM decs d JOIN epx e ON d.entity_ip=e.entity_ip AND d.entity_ip='{ORIGIN}' AND window_us > t0_us-{LEAD} AND window_us <= t1_us+{TAIL} WHERE {x.format(h='(rule1=expected_rule OR rule2=expected_rule)')} GROUP BY episode_id)) AS total_delay_us,
 CAST(count(*) FILTER (WHERE NOT ins) AS BIGINT) AS outside, CAST(count(DISTINCT entity_ip) FILTER (WHERE NOT ins) AS BIGINT) AS outside_entities,
 CAST(count(*) FILTER (WHERE ins AND entity_ip<>'{ORIGIN}') AS BIGINT) AS others_inside, CAST(count(DISTINCT entity_ip) FILTER (WHERE ins AND entity_ip<>'{ORIGIN}') AS BIGINT) AS others_inside_entities
FROM (SELECT d.*, EXISTS (SELECT 1 FROM epx f WHERE f.entity_ip='{ORIGIN}' AND d.window_us > f.t0_us-{LEAD} AND d.window_us <= f.t1_us+{TAIL}) AS ins FROM decs d) d WHERE {x.format(h="(rule1<>'' OR rule2<>'')")}""" for c, x in CFG.items())))
add("E07_rule_matrix", lambda s, d: E.rule_matrix(decs(s, d), eps(s, d), ORIGIN, TAIL, D), sql("decs epx", f"""
WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_ip, window_us ORDER BY logged_us, decision_id) AS rn FROM decs) WHERE rn=1),
h AS (SELECT entity_ip, window_us, rule1 AS rule FROM o WHERE rule1<>'' UNION ALL SELECT entity_ip, window_us, rule2 FROM o WHERE rule2<>'' UNION ALL SELECT entity_ip, window_us, 'IF_ALERT' FROM o WHERE decision='ALERT' AND entity_ip='{ORIGIN}'),
x AS (SELECT h.*, (SELECT arg_min(scenario, (t0_us, episode_id)) FROM epx f WHERE f.entity_ip='{ORIGIN}' AND window_us > t0_us AND window_us <= t1_us+{TAIL}) AS sc FROM h)
SELECT CASE WHEN entity_ip='{ORIGIN}' THEN 'attacker' ELSE 'legitimate' END AS side, coalesce(sc,'outside') AS scenario, rule, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT entity_ip) AS BIGINT) AS entities FROM x GROUP BY 1, 2, 3"""))


def runs(s, d):
    x = decs(s, d).withColumns({"run_id": F.col("entity_ip"), "applied": F.col("k") % 3 == 0, "logged_us": F.col("window_us") + F.col("k").cast("long") * U})
    starts = x.groupBy("run_id").agg(F.min("window_us").alias("start_us"))
    return E.analyze_run(x, starts)


view("runs", "decs", """SELECT entity_ip AS run_id, CAST(count(*) AS BIGINT) AS windows_total, CAST(count(*) FILTER (WHERE decision='ALERT') AS BIGINT) AS windows_alert, CAST(count(*) FILTER (WHERE decision='PERMIT') AS BIGINT) AS windows_permit,
  CAST(count(DISTINCT detector_name) AS BIGINT) AS detectors, count(*) FILTER (WHERE decision='ALERT')>0 AS detected, count(*) FILTER (WHERE decision='ALERT' AND k%3=0)>0 AS blocked,
  min(logged_us) FILTER (WHERE decision='ALERT')-min(window_us) AS lead_us, min(logged_us) FILTER (WHERE decision='ALERT' AND k%3=0)-min(window_us) AS block_us,
  arg_min(detector_name, (logged_us, decision_id)) FILTER (WHERE decision='ALERT' AND k%3=0) AS block_detector, list_sort(list(logged_us-window_us))[count(*)//2+1] AS latency_p50_us, max(logged_us-window_us) AS latency_max_us FROM decs GROUP BY 1""")
add("E08_analyze_run", runs, sql("runs", "SELECT * FROM runs"))


def e09(s, d):
    x = runs(s, d)
    o = F.split("run_id", r"\.")[3].cast("int")
    x = x.withColumns({"kind": F.when(o % 3 == 0, "benign").when(o % 3 == 1, "attack").otherwise("boundary"), "family": F.concat(F.lit("f"), (o % 5).cast("string")), "stable": o % 11 > 0})
    return r6(E.campaign_summary(x))


add("E09_campaign_summary", e09, sql("runs", """WITH x AS (SELECT *, CAST(split_part(run_id,'.',4) AS INT) AS o FROM runs), y AS (SELECT *, CASE o%3 WHEN 0 THEN 'benign' WHEN 1 THEN 'attack' ELSE 'boundary' END AS kind, 'f'||(o%5) AS family FROM x)
SELECT kind, family, CAST(count(*) AS BIGINT) AS runs, CAST(sum(windows_total) AS BIGINT) AS windows, CAST(sum(windows_alert) AS BIGINT) AS alerts, CAST(count(*) FILTER (WHERE windows_alert>0) AS BIGINT) AS runs_with_alert, CAST(count(*) FILTER (WHERE detected) AS BIGINT) AS detected,
 CAST(count(*) FILTER (WHERE blocked) AS BIGINT) AS blocked, min(lead_us) AS lead_min_us, max(lead_us) AS lead_max_us, CAST(count(*) FILTER (WHERE o%11>0) AS BIGINT) AS stable, round(sum(windows_alert)/CAST(sum(windows_total) AS DOUBLE),6) AS alert_rate,
 CAST(quantile_cont(lead_us, 0.5) AS DOUBLE) AS lead_median_us, CAST(list_sort(list(lead_us) FILTER (WHERE lead_us IS NOT NULL))[greatest(CAST(floor(0.95*count(lead_us)) AS BIGINT), 1)] AS DOUBLE) AS lead_p95_us FROM y GROUP BY 1, 2"""))


# --- traffic ----------------------------------------------------------------------------------------------

def e10(s, d):
    e = table(s, d, "packets").where("tcp_flags = 2").select(
        "src_ip", F.col("arrival").alias("episode_id"), F.concat(F.lit("s"), (F.col("arrival") % 3).cast("string")).alias("scenario"), "dst_ip",
        F.col("ts_us").alias("t0_us"), (F.col("ts_us") + F.lit(D)).alias("t1_us"))
    f = s.createDataFrame([("s0", 6, None, True), ("s1", 6, 80, False)], "scenario string, f_protocol int, f_port int, f_syn boolean")
    return E.observed_traffic(table(s, d, "packets"), e, f, 2 * H, D, D)


add("E10_observed_traffic", e10, sql("packets", f"""
WITH e0 AS (SELECT src_ip, arrival AS episode_id, 's'||(arrival%3) AS scenario, dst_ip, ts_us AS t0, ts_us+{D} AS t1 FROM packets WHERE tcp_flags=2),
e AS (SELECT *, t0-{2 * H} AS a, least(t1+{D}, lead(t0-{2 * H}) OVER w) AS b, lag(t1+{D}) OVER w AS pb FROM e0 WINDOW w AS (PARTITION BY src_ip ORDER BY t0, episode_id)),
x AS (SELECT e.episode_id, p.ts_us, p.dst_port, coalesce(CASE e.scenario WHEN 's0' THEN p.dst_ip=e.dst_ip AND protocol=6 AND (tcp_flags&18)=2 WHEN 's1' THEN p.dst_ip=e.dst_ip AND protocol=6 AND dst_port=80 END, false) AS m, e.scenario='s0' AS so
  FROM e JOIN packets p ON p.src_ip=e.src_ip AND p.ts_us <= b AND (p.ts_us > a OR (p.ts_us = a AND (pb IS NULL OR pb < a)))),
g AS (SELECT episode_id, count(*) FILTER (WHERE m) AS n, count(*) FILTER (WHERE NOT m) AS o, min(ts_us) FILTER (WHERE m) AS f, max(ts_us) FILTER (WHERE m) AS l, count(DISTINCT dst_port) FILTER (WHERE m AND so) AS sp FROM x GROUP BY 1)
SELECT e.episode_id, scenario, CAST(coalesce(n,0) AS BIGINT) AS attack_packets, CAST(coalesce(o,0) AS BIGINT) AS other_packets, CAST(coalesce(sp,0) AS BIGINT) AS syn_ports,
 (SELECT min(ts_us) FROM packets) <= a AND (SELECT max(ts_us) FROM packets) >= b AS covered, l-f AS duration_us, f-t0 AS delay_us, l-t1 AS tail_us FROM e LEFT JOIN g USING (episode_id)"""))
GAP = 12 * H


def web(s, d):
    return prep.dedup_http(table(s, d, "http"))


view("web", "http", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, tx_id, url ORDER BY ts_us, arrival) AS rn FROM http) WHERE rn=1")
view("bur", "web", f"""SELECT *, sum(nw) OVER (PARTITION BY src_ip ORDER BY ts_us, arrival) AS burst FROM (SELECT *, CASE WHEN ts_us-lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, arrival) <= {GAP} THEN 0 ELSE 1 END AS nw FROM web)""")
view("spans", "bur", "SELECT src_ip, CAST(burst AS BIGINT) AS burst, min(ts_us) AS from_us, max(ts_us) AS to_us, count(*) AS requests FROM bur GROUP BY 1, 2")


def e11(s, d):
    spans, top = E.http_bursts(web(s, d), GAP, ["dest_ip", "status", "url"], D)
    over = E.overlapping(spans, eps(s, d), D)
    return top.groupBy("src_ip", "burst").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attribute", "rank", "value", "n"))), lambda x: F.concat_ws("=", x["attribute"], x["value"], x["n"].cast("string"))), ";").alias("top3")).join(over, ["src_ip", "burst"])


add("E11_http_bursts", e11, sql("bur spans epx", """
WITH l AS (SELECT src_ip, burst, 'dest_ip' AS attribute, dest_ip AS value FROM bur UNION ALL SELECT src_ip, burst, 'status', CAST(status AS STRING) FROM bur UNION ALL SELECT src_ip, burst, 'url', url FROM bur),
c AS (SELECT src_ip, burst, attribute, value, count(*) AS n FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY src_ip, burst, attribute ORDER BY n DESC, value) AS rank FROM c),
t AS (SELECT src_ip, burst, string_agg(attribute||'='||value||'='||n, ';' ORDER BY attribute, rank) AS top3 FROM r WHERE rank<=3 GROUP BY 1, 2)
SELECT s.src_ip, s.burst, from_us, to_us, CAST(requests AS BIGINT) AS requests, top3, (SELECT CAST(count(*) AS BIGINT) FROM epx f WHERE f.t0_us <= to_us AND from_us <= f.t1_us) AS episodes FROM spans s JOIN t ON t.src_ip=s.src_ip AND t.burst=s.burst"""))


def e12(s, d):
    spans, top = E.http_bursts(web(s, d), GAP, ["dest_port"], D)
    ports = top.where("rank = 1").select("src_ip", "burst", F.col("value").cast("int").alias("dst_port"))
    return E.bursts_on_wire(spans, ports, table(s, d, "packets"), D)


add("E12_bursts_on_wire", e12, sql("bur spans packets", """
WITH c AS (SELECT src_ip, burst, dest_port, row_number() OVER (PARTITION BY src_ip, burst ORDER BY count(*) DESC, CAST(dest_port AS STRING)) AS rn FROM bur GROUP BY 1, 2, 3)
SELECT s.src_ip, s.burst, CAST(count(p.arrival) AS BIGINT) AS packets, CAST(count(p.arrival) FILTER (WHERE (tcp_flags&18)=2) AS BIGINT) AS syns, CAST(count(p.arrival) FILTER (WHERE tcp_payload_length>0) AS BIGINT) AS data_segments
FROM spans s JOIN c ON c.src_ip=s.src_ip AND c.burst=s.burst AND rn=1 LEFT JOIN packets p ON p.protocol=6 AND p.src_ip=s.src_ip AND p.dst_port=c.dest_port AND p.ts_us BETWEEN from_us AND to_us GROUP BY 1, 2"""))
XC = ["10.20.0.3", "10.20.0.7"]


def e13(s, d):
    cases = table(s, d, "app").where("kind = 'tls'").select("entity_ip", ceil_bucket(F.col("ts_us"), S).alias("anchor")).distinct()
    return E.excluded_flows(table(s, d, "packets"), cases, XC, S, 12 * S)


add("E13_excluded_flows", e13, sql("packets app", f"""
WITH p AS (SELECT ts_us, protocol, CASE WHEN dst_ip IN ('10.20.0.3','10.20.0.7') THEN src_ip ELSE dst_ip END AS entity_ip, CASE WHEN dst_ip IN ('10.20.0.3','10.20.0.7') THEN dst_ip ELSE src_ip END AS other_ip,
  CASE WHEN dst_ip IN ('10.20.0.3','10.20.0.7') THEN src_port ELSE dst_port END AS own_port, CASE WHEN dst_ip IN ('10.20.0.3','10.20.0.7') THEN dst_port ELSE src_port END AS other_port, dst_ip IN ('10.20.0.3','10.20.0.7') AS sent
  FROM packets WHERE (src_ip IN ('10.20.0.3','10.20.0.7')) <> (dst_ip IN ('10.20.0.3','10.20.0.7'))),
c AS (SELECT DISTINCT entity_ip, (ts_us+{S}-1)//{S} AS anchor FROM app WHERE kind='tls'), q AS (SELECT *, min(ts_us) OVER (PARTITION BY entity_ip, other_ip, protocol, own_port, other_port) AS f FROM p)
SELECT q.entity_ip, other_ip, protocol, own_port, other_port, c.anchor, CAST(count(*) FILTER (WHERE sent) AS BIGINT) AS sent, CAST(count(*) FILTER (WHERE NOT sent) AS BIGINT) AS received, c.anchor*{S}-f AS age_us, c.anchor*{S}-f > {12 * S} AS before_horizon
FROM q JOIN c ON c.entity_ip=q.entity_ip AND ts_us > (c.anchor-6)*{S} AND ts_us <= c.anchor*{S} GROUP BY ALL"""))

# --- rates ------------------------------------------------------------------------------------------------
HS = 2 * H


def secs(s, d):
    x = table(s, d, "dns").where("dns_event = 'query'")
    return x.select("src_ip", "src_port", "dns_id", "name", idiv(F.col("ts_us"), HS).alias("second")).distinct()


view("secc", "dns", f"SELECT src_ip, second, count(*) AS n FROM (SELECT DISTINCT src_ip, src_port, dns_id, name, ts_us//{HS} AS second FROM dns WHERE dns_event='query') GROUP BY 1, 2")


def shorts(s, d):
    """Every episode, cut to its first two minutes, so that some of the traffic is outside all of them."""
    return eps(s, d).withColumn("t1_us", F.col("t0_us") + F.lit(120 * U))


view("shorts", "epx", f"SELECT episode_id, t0_us, t0_us + {120 * U} AS t1_us FROM epx")


def e14(s, d):
    r = E.dns_rates(secs(s, d), shorts(s, d), HS, D)
    tests = shorts(s, d).select((F.col("episode_id") % 5 + 0.5).cast("double").alias("mean_rate"))
    sep = E.separating_rate(r, tests, ORIGIN)
    return r6(r.join(F.broadcast(sep)))


view("rates", "secc shorts", f"""SELECT o.src_ip, CAST(count(*) AS BIGINT) AS seconds, max(n) AS max_1s, CAST(sum(n) AS BIGINT) AS total, min(second) AS s0, max(second) AS s1, CAST(list_sort(list(n))[CAST(floor(0.99*(count(*)-1)) AS BIGINT)+1] AS DOUBLE) AS p99_1s
  FROM (SELECT * FROM secc c WHERE NOT EXISTS (SELECT 1 FROM shorts f WHERE second*{HS} BETWEEN t0_us AND t1_us)) o GROUP BY 1""")
view("rates2", "rates secc", """SELECT r.*, m.m AS max_mean_10s FROM rates r JOIN (SELECT src_ip, max(b)/CAST(10 AS DOUBLE) AS m FROM (SELECT r.src_ip, (second-s0)//10 AS blk, sum(n) AS b FROM secc c JOIN rates r ON r.src_ip=c.src_ip AND second>=s0 AND s0+((second-s0)//10)*10 <= s1 GROUP BY 1, 2) GROUP BY 1) m USING (src_ip)""")
add("E14_dns_rates", e14, sql("rates2 shorts", f"""WITH t AS (SELECT min(episode_id%5+CAST(0.5 AS DOUBLE)) AS t FROM shorts), l AS (SELECT max(max_1s) AS a, max(max_mean_10s) AS b FROM rates2 WHERE src_ip<>'{ORIGIN}')
SELECT src_ip, seconds, CAST(max_1s AS BIGINT) AS max_1s, total, round(max_mean_10s,6) AS max_mean_10s, p99_1s, CAST(l.a AS BIGINT) AS legit_max_1s, round(l.b,6) AS legit_max_10s, round(t.t,6) AS test_min_rate, t.t > l.b AS separates FROM rates2, t, l"""))
add("E15_http_peaks", lambda s, d: E.http_peaks(web(s, d), S), sql("web", f"""
WITH h AS (SELECT *, unnest(generate_series((ts_us+{S}-1)//{S}, (ts_us+{S}-1)//{S}+5)) AS a FROM web), g AS (SELECT src_ip, a, count(*) AS n, count(*) FILTER (WHERE status IN (401,403)) AS b FROM h GROUP BY 1, 2)
SELECT src_ip, CAST(n AS BIGINT) AS max_requests, CAST(b AS BIGINT) AS auth_failures, CAST(a AS BIGINT) AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY n DESC, a) AS rn FROM g) WHERE rn=1"""))


def web_episodes(s, d):
    """All episodes as those of a source, some without an end."""
    x = eps(s, d)
    return x.select(F.col("entity_ip").alias("src_ip"), "episode_id", "t0_us", F.when(F.col("episode_id") % 6 > 0, F.col("t1_us")).alias("t1_us"))


add("E15_http_peaks_by_episode", lambda s, d: E.episode_http_peaks(web(s, d), web_episodes(s, d), S), sql("web epx", f"""
WITH g AS (SELECT src_ip, a*{S} AS w, count(*) AS n, count(*) FILTER (WHERE status IN (401,403)) AS b FROM (SELECT *, unnest(generate_series((ts_us+{S}-1)//{S}, (ts_us+{S}-1)//{S}+5)) AS a FROM web) GROUP BY 1, 2),
e AS (SELECT entity_ip AS src_ip, episode_id, t0_us, CASE WHEN episode_id%6>0 THEN t1_us ELSE t0_us END AS t1 FROM epx)
SELECT e.episode_id, e.src_ip, CAST(coalesce(max(n),0) AS BIGINT) AS max_requests, CAST(coalesce(max(b),0) AS BIGINT) AS max_auth_failures, min(w)-any_value(t0_us) AS first_after_us FROM e LEFT JOIN g ON g.src_ip=e.src_ip AND w > t0_us AND w <= t1+6*{S} GROUP BY 1, 2"""))
RATES = [0.25, 1.0, 2.0]


def asks(s, d):
    return table(s, d, "dns").where("dns_event = 'query'").withColumn("proto", F.when(F.col("arrival") % 9 == 0, "TCP").otherwise("UDP"))


add("E16_token_envelope", lambda s, d: r6(E.token_envelope(asks(s, d), RATES, D, 2 * D), 4), sql("dns", f"""
WITH q AS (SELECT src_ip, (ts_us-(SELECT min(ts_us) FROM dns WHERE dns_event='query'))/CAST({D} AS DOUBLE) AS t, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, arrival)-1 AS j, count(*) OVER (PARTITION BY src_ip) AS n FROM dns WHERE dns_event='query'),
x AS (SELECT src_ip, n, r, j-r*t AS g, min(j-r*t) OVER (PARTITION BY src_ip, r ORDER BY j) AS m FROM q, (VALUES (CAST(0.25 AS DOUBLE)),(1.0),(2.0)) v(r))
SELECT src_ip, CAST(any_value(n) AS BIGINT) AS events, r AS rate, round(max(g+1-m),4) AS depth FROM x GROUP BY src_ip, r"""))
add("E17_token_simulate", lambda s, d: E.token_simulate(asks(s, d), [(0.5, 2.0), (1.0, 3.0)], D, 2 * D), sql("dns", f"""
WITH RECURSIVE q AS (SELECT src_ip, ts_us, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, arrival) AS rn FROM dns WHERE dns_event='query'),
v AS (SELECT * FROM (VALUES (CAST(0.5 AS DOUBLE), CAST(2.0 AS DOUBLE)),(1.0,3.0)) v(r,b)),
w AS (SELECT src_ip, r, b, rn, ts_us, b-1 AS tok, 0 AS dropped FROM q, v WHERE rn=1
 UNION ALL SELECT src_ip, r, b, rn, ts_us, CASE WHEN tk>=1 THEN tk-1 ELSE tk END, CASE WHEN tk>=1 THEN 0 ELSE 1 END FROM (SELECT q.src_ip, w.r, w.b, q.rn, q.ts_us, least(w.b, w.tok+w.r*(q.ts_us-w.ts_us)/CAST({D} AS DOUBLE)) AS tk FROM w JOIN q ON q.src_ip=w.src_ip AND q.rn=w.rn+1))
SELECT src_ip, r AS rate, b AS depth, CAST(sum(dropped) AS BIGINT) AS dropped, CAST(count(*) AS BIGINT) AS total FROM w GROUP BY 1, 2, 3"""))
SP = {"max_1s": H, "max_10s": 10 * H, "max_60s": 60 * H}
add("E18_sliding_peaks", lambda s, d: E.sliding_peaks(asks(s, d), ["src_ip"], SP, 5 * D), sql("dns", "WITH q AS (SELECT * FROM dns WHERE dns_event='query')\nSELECT src_ip, " + ", ".join(
    f"CAST(max(c{i}) AS BIGINT) AS {n}" for i, n in enumerate(SP)) + " FROM (SELECT src_ip, " + ", ".join(
    f"count(*) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN {us - 1} PRECEDING AND CURRENT ROW) AS c{i}" for i, us in enumerate(SP.values())) + " FROM q) GROUP BY 1"))


def e19(s, d):
    ans = table(s, d, "dns").where("dns_event = 'answer'")
    return r6(E.dns_daily(asks(s, d), ans, 2 * H, 2.0, 1.2, D, D, D), 4)


add("E19_dns_daily", e19, sql("dns", f"""
WITH x AS (SELECT *, (ts_us+{2 * H})//{D} AS day, arrival%9<>0 AS udp FROM dns), k AS (SELECT DISTINCT src_ip, day FROM x),
u AS (SELECT *, (ts_us-(SELECT min(ts_us) FROM x WHERE dns_event='query' AND udp))/CAST({D} AS DOUBLE) AS t, row_number() OVER (PARTITION BY src_ip, day ORDER BY ts_us, arrival)-1 AS j FROM x WHERE dns_event='query' AND udp),
b AS (SELECT src_ip, day, max(g+1-m) AS b FROM (SELECT src_ip, day, j-2*t AS g, min(j-2*t) OVER (PARTITION BY src_ip, day ORDER BY j) AS m FROM u) GROUP BY 1, 2),
n AS (SELECT src_ip, day, count(*) FILTER (WHERE dns_event='query' AND udp) AS udp, count(*) FILTER (WHERE dns_event='query' AND NOT udp) AS tcp, count(*) FILTER (WHERE dns_event='answer' AND rcode='NXDOMAIN') AS nx, count(*) FILTER (WHERE dns_event='answer' AND rcode='SERVFAIL') AS sf FROM x GROUP BY 1, 2)
SELECT src_ip, CAST(day AS BIGINT) AS day, CAST(udp AS BIGINT) AS udp, CAST(tcp AS BIGINT) AS tcp, CAST(nx AS BIGINT) AS nxdomain, CAST(sf AS BIGINT) AS servfail, round(coalesce(b,0),4) AS b_min, CAST(udp AS BIGINT) AS max_1s, CAST(udp AS BIGINT) AS max_10s, CAST(udp AS BIGINT) AS max_60s,
 coalesce(b,0) <= 1.2 AS p1_holds, coalesce(b,0) > CAST(0.8 AS DOUBLE) AS p2_warns FROM n LEFT JOIN b USING (src_ip, day)"""))

# --- restrictions in time --------------------------------------------------------------------------------------

AGENT = "concat(split_part(entity_ip, '.', 3), '/', cast(cast(split_part(entity_ip, '.', 4) AS int) {div} 2 AS {text}))"  # two clients share an agent
SPARK_AGENT, SQL_AGENT = AGENT.format(div="div", text="string"), AGENT.format(div="//", text="varchar")


def judged_eps(s, d):
    n = F.col("episode_id")
    seen = F.when(n % 3 == 0, F.col("t1_us") - n % 5 * H)
    return episodes_of(s, d).withColumns({"agent": F.expr(SPARK_AGENT), "u_us": F.lit(H), "expected": F.when(n % 7 > 0, F.when(n % 2 == 0, "BLOCK").otherwise("LIMIT")), "seen_us": seen})


def trace_of(s, d):
    """Alerts are applications, permits and errors are other events of the agent."""
    x = table(s, d, "dec")
    alert = F.col("decision") == "ALERT"
    return x.select("entity_ip", F.expr(SPARK_AGENT).alias("agent"), F.col("logged_us").alias("applied_us"), (F.col("logged_us") - F.col("k").cast("long") * 60 * U).alias("received_us"),
                    F.when(alert, F.when(F.col("user_id") % 2 == 0, "BLOCK").otherwise("LIMIT")).alias("action"), F.when(F.col("k") % 8 > 0, F.col("k") % 8 < 7).alias("confirmed"),
                    F.col("decision_id").alias("rule_id"), (F.col("logged_us") + D).alias("until_us"))


view("je", "eps", f"SELECT *, {SQL_AGENT} AS agent, CAST({H} AS BIGINT) AS u, CASE WHEN episode_id%7>0 THEN (CASE WHEN episode_id%2=0 THEN 'BLOCK' ELSE 'LIMIT' END) END AS expected, CASE WHEN episode_id%3=0 THEN t1_us-episode_id%5*{H} ELSE t1_us END AS fin FROM eps")
view("tr", "dec", f"SELECT entity_ip, {SQL_AGENT} AS agent, logged_us AS ap, logged_us-CAST(k AS BIGINT)*60*{U} AS rc, CASE WHEN decision='ALERT' THEN (CASE WHEN user_id%2=0 THEN 'BLOCK' ELSE 'LIMIT' END) END AS action, CASE WHEN k%8>0 THEN k%8<7 END AS conf, decision_id AS rule_id, event_type, k FROM dec")
view("e2", "je tr", f"""SELECT e.*, CASE WHEN expected IS NOT NULL AND viol=0 THEN x.sup END AS applied_us, x.inf, x.rule_id, CASE WHEN expected IS NULL THEN 'no_aplica' WHEN viol>0 THEN 'fallo' WHEN coalesce(n,0)=0 THEN 'fallo_experimento' WHEN sup IS NULL THEN 'fallo' WHEN conf=false THEN 'fallo'
  WHEN conf IS NULL AND sup+u < fin THEN 'indeterminado' WHEN sup+u < fin THEN 'cumple' WHEN inf-u >= fin THEN 'fallo' ELSE 'indeterminado' END AS e2 FROM je e LEFT JOIN
  (SELECT episode_id, count(*) AS n, count(*) FILTER (WHERE action IS NOT NULL AND (action IS DISTINCT FROM expected OR rule_ip<>entity_ip)) AS viol, min(ap) FILTER (WHERE good) AS sup, arg_min(rc, ap) FILTER (WHERE good) AS inf, arg_min_null(conf, ap) FILTER (WHERE good) AS conf, arg_min(rule_id, ap) FILTER (WHERE good) AS rule_id
   FROM (SELECT e.episode_id, e.entity_ip, e.expected, tr.entity_ip AS rule_ip, tr.* EXCLUDE (entity_ip, agent), action=expected AND tr.entity_ip=e.entity_ip AS good FROM je e JOIN tr ON tr.agent=e.agent AND ap BETWEEN t0_us-{2 * H} AND t1_us+{6 * H}) x GROUP BY 1) x USING (episode_id)""")


def judged(s, d):
    return E.applied_in_time(judged_eps(s, d), trace_of(s, d), 2 * H, 6 * H, D)


add("E20_applied_in_time", lambda s, d: judged(s, d).select("episode_id", "expected", "e2", "applied_us"), sql("e2", "SELECT episode_id, expected, e2, applied_us FROM e2"))


def e21(s, d):
    """Twelve blocks an episode, some missing and some unknown; the rule's own drops follow its application."""
    t = trace_of(s, d).where("action is not null")
    drops = t.where(F.substring("rule_id", -1, 1) != "5").select("rule_id", "entity_ip", (F.col("applied_us") + H).alias("t_us"))
    j = E.first_host_drop(judged(s, d), drops, 6 * H)
    cells = judged_eps(s, d).where("expected is not null").select("episode_id", "t0_us", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    mix = F.col("episode_id") + F.col("i")
    b = cells.where(mix % 11 > 0).select(
        "episode_id", (F.col("t0_us") + F.col("i") * H).alias("t_us"), (F.lit(3) + F.col("episode_id") % 4 * F.col("i") % 5).alias("syn"),
        F.when(mix % 17 > 0, F.when(mix % 4 > 1, F.lit(0)).otherwise(F.lit(4))).alias("accepted"), F.when(mix % 19 > 0, F.when(mix % 5 > 0, F.lit(0)).otherwise(F.lit(2))).alias("answers"))
    return r6(E.sustained_effect(b, j, 3, 2, 2, H, 0.5, 0.5, 1.0, 0.1))


LIM = "expected='LIMIT'"
view("e3", "e2 tr", f"""WITH je_ AS (SELECT * FROM e2 WHERE expected IS NOT NULL),
b AS (SELECT episode_id, t0_us+i*{H} AS t, 3+episode_id%4*i%5 AS syn, CASE WHEN (episode_id+i)%17>0 THEN (CASE WHEN (episode_id+i)%4>1 THEN 0 ELSE 4 END) END AS acc, CASE WHEN (episode_id+i)%19>0 THEN (CASE WHEN (episode_id+i)%5>0 THEN 0 ELSE 2 END) END AS ans FROM je_, (SELECT unnest(generate_series(0,11)) AS i) WHERE (episode_id+i)%11>0),
hd AS (SELECT episode_id, min(ap+{H}) AS hd FROM e2 JOIN tr USING (rule_id) WHERE applied_us IS NOT NULL AND tr.entity_ip=e2.entity_ip AND action IS NOT NULL AND right(rule_id,1)<>'5' AND ap+{H} BETWEEN inf AND t1_us+{6 * H} GROUP BY 1),
x AS (SELECT b.*, expected, applied_us, t0_us, fin FROM b JOIN je_ USING (episode_id) WHERE e2 IN ('cumple','indeterminado')),
pr AS (SELECT episode_id, count(DISTINCT t) AS present FROM x WHERE t < fin GROUP BY 1),
base AS (SELECT episode_id, count(*) AS nb, sum(acc)/CAST(2 AS DOUBLE) AS b0 FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY t DESC) AS rn FROM x WHERE t+{H} <= applied_us AND acc IS NOT NULL) WHERE rn<=2 GROUP BY 1),
a AS (SELECT x.*, coalesce(CASE WHEN {LIM} THEN syn >= 0.5*b0 ELSE syn>=1 END, false) AS tr, coalesce(CASE WHEN {LIM} THEN syn >= 0.5*b0 AND acc <= 0.5*b0 ELSE syn>=1 AND ans<=0 END, false) AS ok FROM x LEFT JOIN base USING (episode_id) WHERE t >= ((applied_us+{H}-1)//{H})*{H} AND t+{H} <= fin),
r AS (SELECT *, tr AND lead(tr,1,false) OVER w AND ({LIM} IS FALSE OR lead(tr,2,false) OVER w) AS tried, ok AND lead(ok,1,false) OVER w AND ({LIM} IS FALSE OR lead(ok,2,false) OVER w) AS hit FROM a WINDOW w AS (PARTITION BY episode_id ORDER BY t)),
g AS (SELECT episode_id, count(*) AS na, bool_or(tried) AS tried, min(t) FILTER (WHERE hit) AS eff FROM r GROUP BY 1),
y AS (SELECT e.*, nb, b0, eff, hd, CASE WHEN e2 IN ('no_aplica','fallo','fallo_experimento') THEN e2 WHEN 1-coalesce(present,0)/CAST(greatest(1,(fin-t0_us)//{H}) AS DOUBLE) > CAST(0.1 AS DOUBLE) THEN 'I3' WHEN {LIM} AND (coalesce(nb,0)<2 OR b0<1) THEN 'I5'
  WHEN coalesce(na,0) < (CASE WHEN {LIM} THEN 3 ELSE 2 END) THEN 'I1' WHEN eff IS NULL AND NOT tried THEN 'I2' WHEN eff IS NULL THEN 'fallo' END AS why FROM e2 e LEFT JOIN pr USING (episode_id) LEFT JOIN base USING (episode_id) LEFT JOIN g USING (episode_id) LEFT JOIN hd USING (episode_id))
SELECT episode_id, e2, CASE WHEN why LIKE 'I%' THEN 'indeterminado' WHEN why IS NOT NULL THEN why WHEN eff+{H}+u < fin THEN (CASE WHEN hd IS NULL OR e2='indeterminado' THEN 'indeterminado' ELSE 'cumple' END) WHEN eff-u >= fin THEN 'fallo' ELSE 'indeterminado' END AS e3,
 CASE WHEN why LIKE 'I%' THEN why END AS why, CASE WHEN why IS NULL THEN eff END AS effect_us, CASE WHEN {LIM} AND nb>=2 THEN round(b0,6) END AS b0 FROM y""")
add("E21_sustained_effect", e21, sql("e3", "SELECT * FROM e3"))


def e22(s, d):
    c = table(s, d, "ev").select(F.col("ts_us").alias("t_us"), (F.col("k") % 6 > 0).alias("ok"), (F.col("event_type") == "error").alias("attributable"))
    return E.control_failures(eps(s, d), c, 2 * H, 3 * H, D)


add("E22_control_failures", e22, sql("epx ev", f"""SELECT episode_id, CAST(count(v.ts_us) AS BIGINT) AS transactions, CAST(count(v.ts_us) FILTER (WHERE k%6=0 AND event_type='error') AS BIGINT) AS bad,
 CASE WHEN count(v.ts_us)=0 THEN 'fallo_experimento' WHEN count(v.ts_us) FILTER (WHERE k%6=0 AND event_type='error')>0 THEN 'fallo' ELSE 'cumple' END AS e4 FROM epx f LEFT JOIN ev v ON v.ts_us BETWEEN t0_us-{2 * H} AND t1_us+{3 * H} GROUP BY 1"""))


def e23(s, d):
    """Each event is a reading of both sets of its agent: the client itself is blocked, its even partner limited."""
    n = F.col("episode_id")
    j = judged(s, d).withColumns({"next_us": F.when(n % 3 > 0, F.col("t1_us") + n % 9 * D), "retired_us": F.when(n % 2 == 0, F.col("t1_us") - F.lit(H))})
    x = table(s, d, "app").withColumn("agent", F.expr(SPARK_AGENT))
    r = x.select("agent", F.lit("BLOCK").alias("action"), F.col("ts_us").alias("t_us"), F.array("entity_ip", F.lit("10.10.1.9")).alias("members")).unionByName(
        x.select("agent", F.lit("LIMIT").alias("action"), F.col("ts_us").alias("t_us"), F.when(F.col("arrival") % 4 > 0, F.array("entity_ip")).otherwise(F.array().cast("array<string>")).alias("members")))
    return E.retired(j, r, D)


add("E23_retired", e23, sql("e2 app", f"""
WITH j AS (SELECT *, CASE WHEN episode_id%3>0 THEN t1_us+episode_id%9*{D} END AS nx, CASE WHEN episode_id%2=0 THEN t1_us-{H} END AS d5 FROM e2),
ra AS (SELECT {SQL_AGENT} AS agent, ts_us, entity_ip AS ip, arrival FROM app),
rd AS (SELECT agent, 'BLOCK' AS action, ts_us, [ip, '10.10.1.9'] AS m FROM ra UNION ALL SELECT agent, 'LIMIT', ts_us, CASE WHEN arrival%4>0 THEN [ip] ELSE [] END FROM ra),
l AS (SELECT j.episode_id, max(ts_us) AS read_at, arg_max(list_contains(m, j.entity_ip), ts_us) AS still FROM j JOIN rd ON rd.agent=j.agent AND action=expected AND ts_us >= fin AND (nx IS NULL OR ts_us <= nx) GROUP BY 1),
o AS (SELECT *, CASE WHEN expected IS NULL THEN 'no_aplica' WHEN e2='fallo_experimento' THEN e2 WHEN e2='fallo' AND applied_us IS NULL THEN 'no_aplica' WHEN still IS NULL THEN 'indeterminado' WHEN still THEN 'fallo' ELSE 'cumple' END AS e5 FROM j LEFT JOIN l USING (episode_id))
SELECT episode_id, e5, CASE WHEN e5 IN ('cumple','fallo') THEN (CASE WHEN d5 < applied_us+{D} THEN 'retirada_explicita' ELSE 'caducidad_natural' END) END AS way, CASE WHEN e5 IN ('cumple','fallo') THEN read_at END AS read_us FROM o"""))


def scenarios(s, d):
    x = e21(s, d).withColumn("scenario", F.concat(F.lit("s"), (F.col("episode_id") % 4).cast("string")))
    return E.outcomes(x, "scenario", ["e2", "e3"])


add("E24_outcomes", scenarios, sql("e3", """WITH l AS (SELECT 's'||(episode_id%4) AS scenario, 'e2' AS criterion, e2 AS r FROM e3 UNION ALL SELECT 's'||(episode_id%4), 'e3', e3 FROM e3)
SELECT scenario, criterion, CAST(count(*) FILTER (WHERE r='cumple') AS BIGINT) AS k, CAST(count(*) FILTER (WHERE r<>'no_aplica') AS BIGINT) AS n, CAST(count(*) FILTER (WHERE r='cumple') AS BIGINT) AS cumple, CAST(count(*) FILTER (WHERE r='fallo') AS BIGINT) AS fallo,
 CAST(count(*) FILTER (WHERE r='indeterminado') AS BIGINT) AS indeterminado, CAST(count(*) FILTER (WHERE r='fallo_experimento') AS BIGINT) AS fallo_experimento, CAST(count(*) FILTER (WHERE r='no_aplica') AS BIGINT) AS no_aplica FROM l GROUP BY 1, 2"""))
