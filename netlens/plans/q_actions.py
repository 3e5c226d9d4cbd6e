"""Queries A01-A19."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.operators import actions as A
from netlens.plans import q_scan
from netlens.plans.adapt import DAY_US as D, sql, table, view
from netlens.plans.q_prep import H
from netlens.plans.registry import add

ACT = "CASE {r} WHEN 'brute_force' THEN 'BLOCK' WHEN 'port_scan' THEN 'BLOCK' WHEN '' THEN '' ELSE 'LIMIT' END"
NEVER = ["10.10.1.5", "10.10.1.6"]
NV = "('10.10.1.5','10.10.1.6')"
UNIT = 3600 * 1_000_000 // 60  # one policy second lasts a minute of event time


def dec(s, d):
    x = table(s, d, "dec")
    for i in (1, 2):
        r = F.col(f"rule{i}")
        x = x.withColumn(f"action{i}", F.when(r == "", "").when(r.isin("brute_force", "port_scan"), "BLOCK").otherwise("LIMIT"))
    auth = F.when(F.col("authorised") == "yes", True).when(F.col("authorised") == "no", False)
    x = x.withColumn("rejection", A.rejection(auth, F.col("k") % 5 > 0, F.col("view_requests"), F.col("view_ratio")))
    rules = F.filter(F.array(*[F.struct(F.col(f"rule{i}").alias("rule"), F.col(f"action{i}").alias("action")) for i in (1, 2)]), lambda r: r["rule"] != "")
    return x.withColumn("rules", rules).withColumn("host", F.lit(None).cast("string"))


view("dec2", "dec", f"SELECT *, {ACT.format(r='rule1')} AS action1, {ACT.format(r='rule2')} AS action2, CASE WHEN authorised='yes' THEN NULL WHEN authorised='no' THEN 'no authorisation from the HTTP view' "
     "WHEN k%5=0 THEN 'no HTTP view' WHEN view_requests>=5 AND view_ratio>=0.8 THEN NULL ELSE 'HTTP view without valid evidence' END AS rejection FROM dec")
view("v1", "dec2", """SELECT *, CASE WHEN msev >= rsev AND msev>0 THEN (CASE msev WHEN 2 THEN 'BLOCK' ELSE 'LIMIT' END) ELSE action1 END AS action,
   CASE WHEN msev >= rsev AND msev>0 THEN (CASE msev WHEN 2 THEN detector_name ELSE 'model:'||detector_name END) ELSE rule1 END AS motive FROM
  (SELECT *, CASE WHEN decision='ALERT' THEN (CASE WHEN detector_name LIKE '%_heuristic' THEN 2 ELSE 1 END) ELSE 0 END AS msev, CASE action1 WHEN 'BLOCK' THEN 2 WHEN 'LIMIT' THEN 1 ELSE 0 END AS rsev FROM dec2) WHERE greatest(msev, rsev)>0""")
add("A01_verdict_v1", lambda s, d: A.verdict_v1(dec(s, d)).select("decision_id", "action", "motive"), sql("v1", "SELECT decision_id, action, motive FROM v1"))
add("A02_actions_v1", lambda s, d: A.actions_v1(dec(s, d), NEVER), sql("v1", f"""SELECT entity_ip, action, motive, logged_us FROM (SELECT *, row_number() OVER (PARTITION BY entity_ip
   ORDER BY CASE action WHEN 'BLOCK' THEN 2 ELSE 1 END DESC, logged_us DESC) AS rn FROM v1 WHERE entity_ip NOT IN {NV}) WHERE rn=1"""))
for i, p in enumerate(("if_senal", "actual")):
    view(f"acts{i}", "dec2", "SELECT decision_id, entity_ip, logged_us, window_us, detector_name AS rule, 'BLOCK' AS action, rejection, 0 AS ord FROM dec2 WHERE decision='ALERT' AND detector_name LIKE '%_heuristic' "
         + ("UNION ALL SELECT decision_id, entity_ip, logged_us, window_us, 'model:'||detector_name, 'LIMIT', NULL, 0 FROM dec2 WHERE decision='ALERT' AND detector_name NOT LIKE '%_heuristic' " if p == "actual" else "")
         + "UNION ALL SELECT decision_id, entity_ip, logged_us, window_us, rule1, action1, NULL, 1 FROM dec2 WHERE rule1<>'' UNION ALL SELECT decision_id, entity_ip, logged_us, window_us, rule2, action2, NULL, 2 FROM dec2 WHERE rule2<>''")
TG = "CASE WHEN rejection IS NOT NULL THEN NULL WHEN rule='dns_entropy' THEN 'dc1' ELSE 'srv-dmz' END AS target, CASE WHEN rejection IS NOT NULL THEN NULL WHEN rule='dns_entropy' THEN 'dns' ELSE 'todo' END AS scope"
add("A03_actions_v2", lambda s, d: A.actions_v2(dec(s, d), "actual").select("decision_id", "rule", "action", "target", "scope"),
    sql("acts1", f"SELECT decision_id, rule, action, {TG} FROM acts1"))
add("A04_rejections", lambda s, d: A.actions_v2(dec(s, d)).where("rejection is not null").select("decision_id", "rule", "rejection"),
    sql("acts0", "SELECT decision_id, rule, rejection FROM acts0 WHERE rejection IS NOT NULL"))
add("A05_alpha_signal", lambda s, d: A.alpha_signal(dec(s, d)).select("decision_id", F.array_join("alphas_passed", ",").alias("alphas")),
    sql("dec", f"""SELECT decision_id, concat_ws(',', CASE WHEN score < {A.ALPHA_THRESHOLDS['0.05']} THEN '0.05' END, CASE WHEN score < {A.ALPHA_THRESHOLDS['0.03']} THEN '0.03' END,
     CASE WHEN score < {A.ALPHA_THRESHOLDS['0.01']} THEN '0.01' END) AS alphas FROM dec WHERE score IS NOT NULL"""))


def proposed(s, d):
    x = A.actions_v2(dec(s, d)).where(~F.col("entity_ip").isin(NEVER))
    none = F.lit(None).cast("long")
    ev = A.evidence(F.col("rule"), F.when(F.col("rule") != "brute_force", F.col("window_us")), F.col("logged_us"), none, none, UNIT)
    return x.withColumn("_e", ev).select("*", "_e.from_us", "_e.to_us", F.concat_ws("|", "decision_id", "rule").alias("event_id"), F.col("logged_us").alias("t_us")).drop("_e")


view("prop", "acts0", f"""SELECT *, {TG}, decision_id||'|'||rule AS event_id, CASE WHEN rule='brute_force' THEN logged_us ELSE window_us - (CASE rule WHEN 'port_scan' THEN 30 ELSE 60 END)*CAST({UNIT} AS BIGINT) END AS from_us,
   CASE WHEN rule='brute_force' THEN logged_us ELSE window_us END AS to_us FROM acts0 WHERE entity_ip NOT IN {NV}""")
add("A06_evidence", lambda s, d: proposed(s, d).select("event_id", "from_us", "to_us"), sql("prop", "SELECT event_id, from_us, to_us FROM prop"))
add("A07_signals_as_decisions",
    lambda s, d: A.signals_as_decisions(q_scan.signals(s, d).withColumn("dst_ip", F.when(F.col("dst_ip") == "10.20.0.2", "10.10.30.10").otherwise(F.col("dst_ip"))))
    .select("entity_ip", "logged_us", "evidence_from_us", "host", "target", "state"),
    sql("fcnt att", f"""WITH RECURSIVE {q_scan.TRIG} SELECT src_ip AS entity_ip, trigger_us AS logged_us, (SELECT min(syn_us) FROM att a WHERE a.src_ip=t.src_ip AND a.dst_ip=t.dst_ip AND a.syn_us > trigger_us-{q_scan.W} AND a.syn_us <= trigger_us) AS evidence_from_us,
     CASE dst_ip WHEN '10.20.0.2' THEN '10.10.30.10' ELSE dst_ip END AS host, CASE dst_ip WHEN '10.20.0.2' THEN 'srv-dmz' END AS target, CASE WHEN dst_ip<>'10.20.0.2' THEN 'sin_punto_de_aplicacion' END AS state FROM trig t"""))
# The ladder state: s = blocks, seen, last block; the entry in force: until, action, evidence end.
add("A08_apply_actions", lambda s, d: A.apply_actions(proposed(s, d), UNIT).select("event_id", "state", "in_force", "until_us", "level", "review"), sql("prop", f"""
WITH RECURSIVE p AS (SELECT entity_ip, target, scope, rule, action, event_id, logged_us AS t, from_us, to_us, CASE action WHEN 'BLOCK' THEN 2 ELSE 1 END AS sev,
   row_number() OVER (PARTITION BY entity_ip, target ORDER BY logged_us, event_id) AS rn FROM prop WHERE target IS NOT NULL),
a AS (SELECT entity_ip, target, rn, event_id, 'nueva' AS state, action AS act, sev, t + (CASE WHEN sev=2 THEN 300 ELSE 300 END)*CAST({UNIT} AS BIGINT) AS until_us, to_us AS ev_to, CASE WHEN sev=2 THEN 1 ELSE 0 END AS blocks, t AS seen, CASE WHEN sev=2 THEN t END AS lastb,
     CASE WHEN sev=2 THEN 1 ELSE 0 END AS level, false AS review FROM p WHERE rn=1
  UNION ALL SELECT entity_ip, target, rn, event_id, st, CASE WHEN st='mantenida' THEN act0 ELSE action END, CASE WHEN st='mantenida' THEN sev0 ELSE sev END,
     CASE WHEN st='mantenida' THEN until0 WHEN st='renovada' THEN greatest(until0, t+tmo*CAST({UNIT} AS BIGINT)) ELSE t+tmo*CAST({UNIT} AS BIGINT) END, CASE WHEN st='mantenida' THEN ev0 ELSE to_us END,
     CASE WHEN st='mantenida' THEN b0 ELSE nb END, CASE WHEN st='mantenida' THEN seen0 ELSE t END, CASE WHEN st='mantenida' THEN lastb0 WHEN sev=2 THEN greatest(coalesce(lb,t),t) ELSE lb END,
     CASE WHEN st='mantenida' THEN lv0 ELSE nb END, CASE WHEN st='mantenida' THEN rv0 ELSE sev=2 AND nb>=3 END
   FROM (SELECT *, CASE WHEN sev=1 THEN 300 WHEN nb=1 THEN 300 WHEN nb=2 THEN 1800 ELSE 3600 END AS tmo FROM
    (SELECT *, CASE WHEN sev=2 AND (lb IS NULL OR t > lb+120*CAST({UNIT} AS BIGINT)) THEN least(bb+1,3) ELSE bb END AS nb FROM
     (SELECT p.*, a.act AS act0, a.sev AS sev0, a.until_us AS until0, a.ev_to AS ev0, a.blocks AS b0, a.seen AS seen0, a.lastb AS lastb0, a.level AS lv0, a.review AS rv0,
       CASE WHEN p.t-a.seen > 86400*CAST({UNIT} AS BIGINT) THEN 0 ELSE a.blocks END AS bb, CASE WHEN p.t-a.seen > 86400*CAST({UNIT} AS BIGINT) THEN NULL ELSE a.lastb END AS lb,
       CASE WHEN a.until_us <= p.t THEN 'nueva' WHEN p.sev > a.sev THEN 'escalada' WHEN p.sev = a.sev AND p.from_us >= a.ev_to THEN 'renovada' ELSE 'mantenida' END AS st
      FROM a JOIN p ON p.entity_ip=a.entity_ip AND p.target=a.target AND p.rn=a.rn+1))))
SELECT event_id, state, act AS in_force, until_us, CAST(level AS INT) AS level, review FROM a"""))


def restrictions(s, d):
    x = proposed(s, d).where("target is not null")
    return x.select("entity_ip", "target", "action", "event_id", "t_us")


LUNIT = UNIT // 2
add("A09_ladder", lambda s, d: A.ladder(restrictions(s, d), LUNIT).select("event_id", "level", "timeout_s", "review"), sql("prop", f"""
WITH RECURSIVE p AS (SELECT entity_ip, target, action, event_id, logged_us AS t, row_number() OVER (PARTITION BY entity_ip, target ORDER BY logged_us, event_id) AS rn FROM prop WHERE target IS NOT NULL),
a AS (SELECT entity_ip, target, rn, event_id, action, t, CASE action WHEN 'BLOCK' THEN 1 ELSE 0 END AS nb, CASE action WHEN 'BLOCK' THEN t END AS lb FROM p WHERE rn=1
  UNION ALL SELECT p.entity_ip, p.target, p.rn, p.event_id, p.action, p.t,
   CASE WHEN p.action='BLOCK' AND (a.lb IS NULL OR p.t-a.t > 86400*CAST({LUNIT} AS BIGINT) OR p.t > a.lb+120*CAST({LUNIT} AS BIGINT)) THEN least(1 + CASE WHEN p.t-a.t > 86400*CAST({LUNIT} AS BIGINT) THEN 0 ELSE a.nb END, 3)
     WHEN p.t-a.t > 86400*CAST({LUNIT} AS BIGINT) THEN 0 ELSE a.nb END,
   CASE WHEN p.action='BLOCK' THEN p.t WHEN p.t-a.t > 86400*CAST({LUNIT} AS BIGINT) THEN NULL ELSE a.lb END
  FROM a JOIN p ON p.entity_ip=a.entity_ip AND p.target=a.target AND p.rn=a.rn+1)
SELECT event_id, CAST(nb AS INT) AS level, CASE WHEN action='LIMIT' THEN 300 WHEN nb=1 THEN 300 WHEN nb=2 THEN 1800 ELSE 3600 END AS timeout_s, action='BLOCK' AND nb>=3 AS review FROM a"""))


def now_of(s, d):
    return table(s, d, "ev").agg(F.max("ts_us")).first()[0]


def a10(s, d):
    x = restrictions(s, d).groupBy("entity_ip", "target").agg(F.max("t_us").alias("seen_us"))
    return A.prune(x, now_of(s, d), UNIT // 8)


add("A10_prune", a10, sql("prop", f"SELECT * FROM (SELECT entity_ip, target, max(logged_us) AS seen_us FROM prop WHERE target IS NOT NULL GROUP BY 1, 2) WHERE (SELECT max(ts_us) FROM ev)-seen_us <= 86400*CAST({UNIT // 8} AS BIGINT)"))


def entries(s, d):
    return restrictions(s, d).withColumn("until_us", F.col("t_us") + F.when(F.col("action") == "BLOCK", F.lit(2 * D)).otherwise(F.lit(D)))


view("ent", "prop", f"SELECT entity_ip, target, action, event_id, logged_us AS t_us, logged_us + CASE action WHEN 'BLOCK' THEN {2 * D} ELSE {D} END AS until_us FROM prop WHERE target IS NOT NULL")
MID = f"((SELECT min(ts_us) FROM ev) + {15 * D})"


def mid(s, d):
    return table(s, d, "ev").agg(F.min("ts_us")).first()[0] + 15 * D


add("A11_active", lambda s, d: A.active(entries(s, d).where(F.col("t_us") <= mid(s, d)), mid(s, d)).select("event_id", "entity_ip", "severity", "until_us"),
    sql("ent", f"SELECT event_id, entity_ip, CASE action WHEN 'BLOCK' THEN 2 ELSE 1 END AS severity, until_us FROM ent WHERE t_us <= {MID} AND until_us > {MID}"))


def a12(s, d):
    allowed = table(s, d, "dec").where("user_id % 9 = 0").select("entity_ip")
    kept, gone = A.retire_allowlisted(entries(s, d), allowed, mid(s, d))
    return kept.select("event_id", F.lit("kept").alias("side")).unionByName(gone.select("event_id", F.lit("retired").alias("side")))


add("A12_retire_allowlisted", a12, sql("ent", f"""WITH al AS (SELECT DISTINCT entity_ip FROM dec WHERE user_id%9=0)
SELECT event_id, 'kept' AS side FROM ent WHERE entity_ip NOT IN (SELECT entity_ip FROM al) UNION ALL SELECT event_id, 'retired' FROM ent WHERE entity_ip IN (SELECT entity_ip FROM al) AND until_us > {MID}"""))


def feed_entries(s, d):
    x = entries(s, d).withColumn("seq", F.regexp_extract("event_id", r"d(\d+)", 1).cast("long"))
    n = F.col("seq")
    x = x.withColumns({
        "scope": F.when(n % 31 == 0, F.lit(None)).when(n % 29 == 0, "all").when(F.col("target") == "dc1", "dns").otherwise("todo"),
        "target": F.when(n % 37 == 0, "mars").otherwise(F.col("target")), "action": F.when(n % 23 == 0, "DROP").otherwise(F.col("action")),
        "entity_ip": F.when(n % 19 == 0, F.concat("entity_ip", F.lit(".9"))).otherwise(F.col("entity_ip")),
        "until_s": F.when(n % 17 > 0, (n % 60) * 70), "event_id": F.when(n % 7 == 0, F.lit("same")).otherwise(F.col("event_id")),
    })
    good = A.entry_id(F.col("entity_ip"), F.col("target"), F.col("scope"), F.col("action"), F.col("event_id"))
    return x.withColumn("id", F.when(n % 13 == 0, "0").otherwise(good)).select("entity_ip", "target", "scope", "action", "until_s", "event_id", "id", "seq")


view("fe", "ent", """SELECT *, CASE WHEN n%13=0 THEN '0' ELSE substr(sha256(concat_ws('|', entity_ip, target, scope, action, event_id)),1,16) END AS id FROM
 (SELECT n AS seq, n, CASE WHEN n%31=0 THEN NULL WHEN n%29=0 THEN 'all' WHEN target='dc1' THEN 'dns' ELSE 'todo' END AS scope, CASE WHEN n%37=0 THEN 'mars' ELSE target END AS target,
   CASE WHEN n%23=0 THEN 'DROP' ELSE action END AS action, CASE WHEN n%19=0 THEN entity_ip||'.9' ELSE entity_ip END AS entity_ip, CASE WHEN n%17>0 THEN (n%60)*70 END AS until_s, CASE WHEN n%7=0 THEN 'same' ELSE event_id END AS event_id
  FROM (SELECT *, CAST(regexp_extract(event_id, 'd(\\d+)', 1) AS BIGINT) AS n FROM ent))""")
add("A13_validate_entries",
    lambda s, d: A.validate_entries(feed_entries(s, d), "srv-dmz", ["10.10.1.8"], F.lit(300), ["seq", "event_id", "until_s"]).groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
    sql("fe", """SELECT CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY r IS NULL, id ORDER BY seq, event_id, until_s) > 1 THEN 'id_duplicado' ELSE r END AS reason, CAST(count(*) AS BIGINT) AS n FROM
  (SELECT *, CASE WHEN target NOT IN ('srv-dmz','dc1') THEN 'destino_desconocido' WHEN scope IS NULL THEN 'alcance_desconocido' WHEN scope<>'todo' THEN 'alcance_no_permitido' WHEN action NOT IN ('BLOCK','LIMIT') THEN 'accion_desconocida'
    WHEN len(string_split(entity_ip,'.'))<>4 THEN 'ip_invalida' WHEN entity_ip='10.10.1.8' THEN 'nunca_bloquear' WHEN until_s IS NULL THEN 'hasta_invalido' WHEN until_s<=300 THEN 'entrada_caducada' WHEN until_s-300>3600 THEN 'hasta_excesivo'
    WHEN id<>substr(sha256(concat_ws('|', entity_ip, target, scope, action, event_id)),1,16) THEN 'id_incoherente' END AS r FROM fe WHERE target<>'dc1') GROUP BY ALL""".replace("SELECT CASE WHEN r IS NULL AND row_number()", "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN r IS NULL AND row_number()", 1)
        .replace("ELSE r END AS reason, CAST(count(*) AS BIGINT) AS n FROM", "ELSE r END AS reason FROM", 1).replace("WHERE target<>'dc1') GROUP BY ALL", "WHERE target<>'dc1')) GROUP BY 1", 1)))


def batches(s, d):
    return table(s, d, "ev").select(
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("target"), F.col("event_id").alias("batch_id"), F.col("ts_us").alias("read_us"),
        F.when(F.col("k") == 7, 1).otherwise(2).alias("version"), F.when(F.col("k") != 9, F.floor(F.col("event_id") / 3) - F.when(F.col("k") % 10 == 3, 20).otherwise(0)).alias("sequence"),
        (F.col("ts_us") + F.when(F.col("k") == 11, F.lit(-5)).otherwise(F.lit(60_000_000))).alias("expires_us"),
        (F.col("ts_us") + F.when(F.col("k") == 13, F.lit(90_000_000)).otherwise(F.lit(0))).alias("generated_us"))


add("A14_validate_batch", lambda s, d: A.validate_batch(batches(s, d), D).select("batch_id", "state", "reason"), sql("ev", """
WITH b AS (SELECT 't'||(user_id%4) AS target, event_id AS id, ts_us, CASE WHEN k=7 THEN 'version_no_soportada' WHEN k=9 THEN 'campos_obligatorios' WHEN k=11 THEN 'feed_caducado' WHEN k=13 THEN 'feed_del_futuro' END AS bad,
  CASE WHEN k<>9 THEN event_id//3 - CASE WHEN k%10=3 THEN 20 ELSE 0 END END AS seq FROM ev),
c AS (SELECT *, max(CASE WHEN bad IS NULL THEN seq END) OVER (PARTITION BY target ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b),
r AS (SELECT id AS batch_id, coalesce(bad, CASE WHEN seq<seen THEN 'secuencia_anterior' WHEN seq=seen THEN 'misma_secuencia' END, '') AS reason FROM c)
SELECT batch_id, CASE reason WHEN '' THEN 'aceptado' WHEN 'misma_secuencia' THEN 'repetido' ELSE 'rechazado' END AS state, reason FROM r"""))


def pictures(s, d):
    e = entries(s, d)
    m = mid(s, d)
    pic = lambda t: e.where((F.col("t_us") <= t) & (F.col("until_us") > t)).groupBy("entity_ip").agg(F.max_by("action", F.struct("t_us", "event_id")).alias("action"), (F.max("until_us") / 1_000_000).cast("long").alias("until_s"))
    return pic(m), pic(m + D)


for n, t in (("pic0", "0"), ("pic1", str(D))):
    view(n, "ent", f"SELECT entity_ip, arg_max(action, (t_us, event_id)) AS action, CAST(max(until_us)//1000000 AS BIGINT) AS until_s FROM ent WHERE t_us <= {MID}+{t} AND until_us > {MID}+{t} GROUP BY 1")


def a15(s, d):
    a, b = pictures(s, d)
    rel = table(s, d, "dec").where("user_id % 50 = 1").select("entity_ip").distinct()
    return A.snapshot_diff(a, b, rel)


add("A15_snapshot_diff", a15, sql("pic0 pic1", """SELECT entity_ip, CASE WHEN a.action IS NULL THEN 'aplicada' WHEN b.action IS NULL THEN 'retirada' ELSE 'cambiada' END AS event, coalesce(b.action, a.action) AS action
 FROM pic0 a FULL JOIN pic1 b USING (entity_ip) WHERE a.action IS NULL OR b.action IS NULL OR a.action<>b.action UNION ALL SELECT DISTINCT entity_ip, 'liberada', '' FROM dec WHERE user_id%50=1"""))


def a16(s, d):
    cur, des = pictures(s, d)
    return A.plan(des, cur, sync=True).select("entity_ip", "op", "want", "want_until")


add("A16_plan", a16, sql("pic0 pic1", """SELECT entity_ip, CASE WHEN b.action IS NULL THEN 'remove' WHEN b.action='LIMIT' AND a.action='BLOCK' THEN 'keep' WHEN b.action='BLOCK' AND a.action='LIMIT' THEN 'replace' WHEN a.action IS NULL THEN 'add'
  WHEN b.until_s <= a.until_s+1 THEN 'keep' ELSE 'extend' END AS op, b.action AS want, b.until_s AS want_until FROM pic0 a FULL JOIN pic1 b USING (entity_ip)"""))

CG = H // 4


def pubs(s, d):
    return table(s, d, "ev").select(F.col("ts_us").alias("published_us"))


view("pubs", "ev", "SELECT ts_us AS published_us FROM ev")
view("cov", "dec pubs", f"""SELECT d.*, CASE WHEN logged_us < lo THEN 'fuera' WHEN logged_us > hi-{D} THEN 'desactualizada' WHEN EXISTS (SELECT 1 FROM (SELECT published_us AS b, lag(published_us) OVER (ORDER BY published_us) AS a FROM pubs) g WHERE b-a > {CG} AND d.logged_us > a AND d.logged_us < b) THEN 'fuera' ELSE 'cubierta' END AS coverage
  FROM dec d, (SELECT min(published_us) AS lo, max(published_us) AS hi FROM pubs)""")


def covered(s, d):
    return A.coverage(dec(s, d), pubs(s, d), now_of(s, d) + 10 * D, CG, D, D, D)


add("A17_coverage", lambda s, d: covered(s, d).select("decision_id", "coverage"), sql("cov", "SELECT decision_id, coverage FROM cov"))


def trail(s, d):
    sig = A.alpha_signal(dec(s, d)).where(F.size("alphas_passed") > 0).select("decision_id", F.array_join("alphas_passed", ",").alias("alphas"))
    kinds = F.element_at(F.array(*map(F.lit, ("nueva", "mantenida", "rechazada", "renovada", "escalada"))), (F.col("k") % 5 + 1).cast("int"))
    m = A.actions_v2(dec(s, d)).where("k % 2 = 0").select("decision_id", kinds.alias("kind"), "action", (F.col("logged_us") + F.col("position")).alias("m_us"))
    return sig, m


view("meas", "acts0 dec", "SELECT decision_id, list_value('nueva','mantenida','rechazada','renovada','escalada')[k%5+1] AS kind, action, a.ord FROM acts0 a JOIN (SELECT decision_id, k FROM dec) USING (decision_id) WHERE k%2=0")


def a18(s, d):
    return A.decision_chain(covered(s, d), *trail(s, d)).select("decision_id", "signal_state", "measure_state", "measure_action", "proposed", "application")


add("A18_decision_chain", a18, sql("cov meas", f"""WITH m AS (SELECT decision_id, max(CASE WHEN kind<>'rechazada' THEN kind END) AS pk, CASE max(CASE WHEN kind<>'rechazada' THEN (CASE action WHEN 'BLOCK' THEN 2 ELSE 1 END) END) WHEN 2 THEN 'BLOCK' WHEN 1 THEN 'LIMIT' END AS pa, any_value(kind) AS lk FROM meas GROUP BY 1),
x AS (SELECT c.decision_id, c.score, coverage, pk, pa, coalesce(pk, lk, CASE WHEN coverage='cubierta' THEN 'no_publicada' ELSE coverage END) AS ms FROM cov c LEFT JOIN m USING (decision_id))
SELECT decision_id, CASE WHEN score < {A.ALPHA_THRESHOLDS['0.05']} THEN 'senal' WHEN score IS NULL THEN 'sin_puntuar' WHEN coverage='cubierta' THEN 'sin_senal' ELSE coverage END AS signal_state, ms AS measure_state, pa AS measure_action,
 pk IS NOT NULL AS proposed, CASE WHEN pk IS NOT NULL THEN 'no_ejecutada' WHEN ms IN ('no_publicada','rechazada') THEN 'no_aplica' ELSE 'desconocido' END AS application FROM x"""))


def a19(s, d):
    sig, m = trail(s, d)
    return A.chain_summary(pubs(s, d), sig, m, now_of(s, d) + 10 * D, CG, D, D, D)


add("A19_chain_summary", a19, sql("pubs dec meas", f"""WITH g AS (SELECT published_us-lag(published_us) OVER (ORDER BY published_us) AS dt, published_us FROM pubs)
SELECT min(published_us) AS from_us, max(published_us) AS to_us, CAST(count(*) FILTER (WHERE dt>{CG}) AS BIGINT) AS gaps, CAST(count(*) AS BIGINT) AS publications, (SELECT CAST(count(*) AS BIGINT) FROM dec WHERE score < {A.ALPHA_THRESHOLDS['0.05']}) AS signals,
 (SELECT CAST(count(DISTINCT decision_id) AS BIGINT) FROM meas) AS decisions_with_measure, false AS fresh, max(published_us)-{D} AS covered_until_us, 'trace stale; '||count(*) FILTER (WHERE dt>{CG})||' gaps in the trace' AS incidents, 'incidencia' AS state FROM g"""))
