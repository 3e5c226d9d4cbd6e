"""Queries Q01-Q20."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.operators import quality as Q
from netlens.operators.core import idiv, materialize
from netlens.plans.adapt import DAY_US as D, sql, table, view
from netlens.plans.q_prep import H
from netlens.plans.registry import add, r6

EDGE, GAP, TOL, LIMIT = 2 * H, 3 * H, 60.0, 4 * H


def cs(s, d):
    return table(s, d, "cs")


def ends(s, d):
    return cs(s, d).agg(F.min("ts_us"), F.max("ts_us")).first()


def periods(s, d):
    """Every signup opens a period of half a day."""
    return cs(s, d).where("event_type = 'signup'").select(F.col("sample_id").alias("period_id"), "component", F.col("ts_us").alias("t0_us"), (F.col("ts_us") + F.lit(12 * H)).alias("t1_us"))


view("per", "cs", f"SELECT sample_id AS period_id, component, ts_us AS t0, ts_us+{12 * H} AS t1 FROM cs WHERE event_type='signup'")
view("lag", "cs", """SELECT *, lag(ts_us) OVER w AS x, lag(pid) OVER w AS pid0, lag(uptime_s) OVER w AS u0, lag(packets) OVER w AS p0, lag(drops) OVER w AS d0 FROM cs WINDOW w AS (PARTITION BY component ORDER BY ts_us, sample_id)""")
view("inc", "lag", """SELECT *, CASE WHEN state='ok' THEN packets-p0 END AS d_packets, CASE WHEN state='ok' THEN drops-d0 END AS d_drops FROM (SELECT *, CASE WHEN uptime_s IS NULL OR packets IS NULL OR drops IS NULL OR u0 IS NULL OR p0 IS NULL OR d0 IS NULL THEN 'missing'
  WHEN pid<>pid0 OR uptime_s<u0 OR packets<p0 OR drops<d0 THEN 'restart' WHEN ts_us=x THEN 'same' ELSE 'ok' END AS state FROM lag WHERE x IS NOT NULL)""")


def incs(s, d):
    return Q.increments(cs(s, d), D)


add("Q01_increments", lambda s, d: incs(s, d).select("sample_id", "state", "d_packets", "d_drops"), sql("inc", "SELECT sample_id, state, d_packets, d_drops FROM inc"))


def measured(s, d):
    return Q.measure_drops(cs(s, d), periods(s, d), ends(s, d)[1], EDGE, GAP, TOL, D)


def meas_sql(per: str) -> str:
    return f"""SELECT p.period_id, p.component, p.t0, p.t1, coalesce(part,0) AS partial_drops, CASE WHEN b IS NULL AND last < t1 AND nw-last > {GAP} THEN 'desactualizada' WHEN a IS NULL OR b IS NULL THEN 'cobertura_insuficiente' WHEN falls>0 THEN 'error_lectura' WHEN miss>0 THEN 'ausente'
  WHEN frozen>0 THEN 'desactualizada' WHEN rest>0 OR gaps>0 THEN 'cobertura_insuficiente' WHEN dd>0 THEN 'descartes' ELSE 'cero_explicito' END AS state, dp, dd FROM
 (SELECT p.*, (SELECT max(ts_us) FROM cs c WHERE c.component=p.component AND ts_us BETWEEN t0-{EDGE} AND t0) AS a, (SELECT min(ts_us) FROM cs c WHERE c.component=p.component AND ts_us BETWEEN t1 AND t1+{EDGE}) AS b, (SELECT max(ts_us) FROM cs c WHERE c.component=p.component) AS last, (SELECT max(ts_us) FROM cs) AS nw FROM {per} p) p
 LEFT JOIN (SELECT period_id, count(*) FILTER (WHERE miss) AS miss, count(*) FILTER (WHERE inr AND fz) AS frozen, count(*) FILTER (WHERE inr AND NOT fz AND NOT sm) AS rest, count(*) FILTER (WHERE inr AND NOT fz AND sm AND (drops<d0 OR packets<p0)) AS falls, count(*) FILTER (WHERE inr AND ts_us-x > {GAP}) AS gaps,
   sum(CASE WHEN inr AND nr AND drops>d0 THEN drops-d0 END) AS part, arg_max(packets, ts_us)-arg_min(packets, ts_us) AS dp, arg_max(drops, ts_us)-arg_min(drops, ts_us) AS dd FROM
  (SELECT q.period_id, l.*, l.x >= q.a AS inr, packets IS NULL OR drops IS NULL OR uptime_s IS NULL AS miss, uptime_s=u0 AND ts_us-x > {int(TOL)}*1000000 AS fz, abs((ts_us/CAST(1000000 AS DOUBLE)-uptime_s)-(x/CAST(1000000 AS DOUBLE)-u0)) <= {TOL} AND uptime_s>=u0 AS sm, abs((ts_us/CAST(1000000 AS DOUBLE)-uptime_s)-(x/CAST(1000000 AS DOUBLE)-u0)) <= {TOL} AS nr
   FROM (SELECT p.*, (SELECT max(ts_us) FROM cs c WHERE c.component=p.component AND ts_us BETWEEN t0-{EDGE} AND t0) AS a, (SELECT min(ts_us) FROM cs c WHERE c.component=p.component AND ts_us BETWEEN t1 AND t1+{EDGE}) AS b FROM {per} p) q JOIN lag l ON l.component=q.component AND l.ts_us BETWEEN q.a AND q.b) GROUP BY 1) g USING (period_id)"""


view("meas2", "per lag", meas_sql("per"))
MO = "CASE WHEN state IN ('cero_explicito','descartes') THEN {c} END"
add("Q02_measure_drops", lambda s, d: measured(s, d).select("period_id", "state", "packets", "drops", "partial_drops"),
    sql("meas2", f"SELECT period_id, state, {MO.format(c='dp')} AS packets, {MO.format(c='dd')} AS drops, CAST(partial_drops AS BIGINT) AS partial_drops FROM meas2"))
PW = 2 * H
view("per3", "cs", f"SELECT component AS period_id, component, max(ts_us)-{PW} AS t0, max(ts_us) AS t1 FROM cs GROUP BY 1")
view("meas3", "per3 lag", meas_sql("per3"))
add("Q03_precondition", lambda s, d: Q.precondition(cs(s, d), ends(s, d)[1], PW, EDGE, GAP, TOL, D), sql("meas3", f"""WITH x AS (SELECT component, CASE WHEN (SELECT max(ts_us) FROM cs)-t1 > {GAP} THEN 'desactualizada' ELSE state END AS state, CAST(partial_drops AS BIGINT) AS partial_drops FROM meas3)
SELECT *, CASE WHEN state='cero_explicito' THEN 'cumple' WHEN state='descartes' OR partial_drops>0 THEN 'no_cumple' ELSE 'no_demostrable' END AS verdict FROM x"""))
view("rcov", "per lag", f"""SELECT p.period_id, p.component, concat_ws('; ', CASE WHEN a IS NULL OR b IS NULL THEN 'not bounded' END, CASE WHEN t0-a > {LIMIT} THEN 'start bound too old' END, CASE WHEN b-t1 > {LIMIT} THEN 'end bound too late' END, CASE WHEN pids>1 THEN 'several pids' END,
  CASE WHEN gaps>0 THEN 'gap between readings' END, CASE WHEN inv>0 THEN 'invalid counters' END, CASE WHEN inv=0 AND pids=1 AND falls>0 THEN 'counter decreases' END) AS reasons, dd FROM
 (SELECT p.*, (SELECT max(ts_us) FROM cs c WHERE c.component=p.component AND ts_us<=t0) AS a, (SELECT min(ts_us) FROM cs c WHERE c.component=p.component AND ts_us>=t1) AS b FROM per p) p LEFT JOIN
 (SELECT period_id, count(DISTINCT pid) AS pids, count(*) FILTER (WHERE x>=a AND ts_us-x > {LIMIT}) AS gaps, count(*) FILTER (WHERE packets IS NULL OR drops IS NULL OR packets<0) AS inv, count(*) FILTER (WHERE x>=a AND (packets<p0 OR drops<d0)) AS falls, arg_max(drops, ts_us)-arg_min(drops, ts_us) AS dd FROM
  (SELECT p.*, (SELECT max(ts_us) FROM cs c WHERE c.component=p.component AND ts_us<=t0) AS a, (SELECT min(ts_us) FROM cs c WHERE c.component=p.component AND ts_us>=t1) AS b FROM per p) q JOIN lag l ON l.component=q.component AND l.ts_us BETWEEN q.a AND q.b GROUP BY 1) g USING (period_id)""")


def coverage(s, d):
    return Q.reading_coverage(cs(s, d), periods(s, d), LIMIT, D)


add("Q04_reading_coverage", lambda s, d: coverage(s, d).select("period_id", F.array_join("reasons", "; ").alias("reasons"), "ok", "kernel_drops"),
    sql("rcov", "SELECT period_id, reasons, reasons='' AS ok, CASE WHEN reasons='' THEN dd END AS kernel_drops FROM rcov"))
add("Q05_classify_period", lambda s, d: Q.classify_period(measured(s, d), coverage(s, d), incs(s, d), GAP, D), sql("meas2 rcov inc", f"""
WITH i AS (SELECT period_id, count(*) FILTER (WHERE inc.state='restart') AS r, count(*) FILTER (WHERE ts_us-x > {GAP}) AS g FROM per JOIN inc ON inc.component=per.component AND ts_us BETWEEN t0 AND t1 GROUP BY 1),
m AS (SELECT m.period_id, m.component, concat_ws('; ', CASE WHEN g>0 THEN 'stretch without samples' END, CASE WHEN r>0 THEN 'restart' END, CASE WHEN state NOT IN ('cero_explicito','descartes') THEN 'sensor '||state END, CASE WHEN reasons<>'' THEN 'readings incomplete' END) AS a,
 CASE WHEN reasons='' AND c.dd>0 THEN 'capture drops' END AS b, CASE WHEN state='descartes' THEN 'sensor drops' END AS c FROM meas2 m LEFT JOIN i USING (period_id) LEFT JOIN rcov c USING (period_id))
SELECT period_id, component, CASE WHEN a<>'' THEN 'C3' WHEN b IS NOT NULL THEN 'C2' WHEN c IS NOT NULL THEN 'C1' ELSE 'C0' END AS period_class, concat_ws('; ', nullif(a,''), b, c) AS motives FROM m"""))
add("Q06_segments", lambda s, d: Q.segments(cs(s, d), D), sql("cs", """
WITH v AS (SELECT * FROM cs WHERE packets IS NOT NULL AND drops IS NOT NULL AND uptime_s IS NOT NULL), l AS (SELECT *, CASE WHEN uptime_s<lag(uptime_s) OVER w OR packets<lag(packets) OVER w OR drops<lag(drops) OVER w THEN 1 ELSE 0 END AS n FROM v WINDOW w AS (PARTITION BY component ORDER BY ts_us, sample_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY component ORDER BY ts_us, sample_id) AS segment FROM l)
SELECT component, CAST(segment AS BIGINT) AS segment, min(ts_us) AS from_us, max(ts_us) AS to_us, arg_max(packets, ts_us)-arg_min(packets, ts_us) AS packets, arg_max(drops, ts_us)-arg_min(drops, ts_us) AS drops,
 round((arg_max(drops, ts_us)-arg_min(drops, ts_us))*CAST(1e6 AS DOUBLE)/nullif(arg_max(packets, ts_us)-arg_min(packets, ts_us),0),3) AS drops_per_million FROM g GROUP BY 1, 2"""))
add("Q07_drop_intensity", lambda s, d: r6(Q.drop_intensity(incs(s, d), 2000)), sql("inc", """
WITH q AS (SELECT component, list_sort(list(d_packets)) AS l FROM inc WHERE state='ok' GROUP BY 1)
SELECT component, CAST(count(*) FILTER (WHERE state='ok') AS BIGINT) AS intervals, CAST(count(*) FILTER (WHERE state='restart') AS BIGINT) AS restarts, CAST(sum(d_packets) AS BIGINT) AS packets, CAST(sum(d_drops) AS BIGINT) AS drops, max(d_packets) AS max_packets, CAST(count(*) FILTER (WHERE d_packets>=2000) AS BIGINT) AS bursts,
 CAST(count(*) FILTER (WHERE d_drops>0) AS BIGINT) AS intervals_with_drops, round(max(d_packets/((ts_us-x)/CAST(1000000 AS DOUBLE))),6) AS max_rate, round(sum(d_drops)*CAST(1e6 AS DOUBLE)/sum(d_packets),3) AS drops_per_million,
 CAST(any_value(l[CAST(floor(0.5*(len(l)-1)) AS BIGINT)+1]) AS DOUBLE) AS p50, CAST(any_value(l[CAST(floor(0.95*(len(l)-1)) AS BIGINT)+1]) AS DOUBLE) AS p95 FROM inc JOIN q USING (component) GROUP BY 1"""))

# --- files and deliveries -------------------------------------------------------------------------
JUMP, RET = 4 * H, 3 * D


def files(s, d):
    x = table(s, d, "ev")
    n = F.col("event_id")
    return x.select(
        F.concat(F.lit("c"), (F.col("user_id") % 9).cast("string")).alias("component"), F.concat(F.lit("live-"), n.cast("string")).alias("file"), F.col("ts_us").alias("start_us"),
        F.when((n % 613 == 0) & (F.col("user_id") % 2 == 0), F.lit(0)).otherwise(F.col("k") + 1).cast("long").alias("records"),
        F.when((n % 701 == 0) & (F.col("user_id") % 9 == 4), "bad header").when((n % 911 == 0) & (F.col("user_id") % 9 == 5), "read failed").alias("error"),
        (F.col("ts_us") + F.lit(H)).alias("read_us"))


view("files", "ev", f"""SELECT 'c'||(user_id%9) AS component, 'live-'||event_id AS file, ts_us AS st, CASE WHEN event_id%613=0 AND user_id%2=0 THEN 0 ELSE k+1 END AS rec, CASE WHEN event_id%701=0 AND user_id%9=4 THEN 'bad header' WHEN event_id%911=0 AND user_id%9=5 THEN 'read failed' END AS err, ts_us+{H} AS rd FROM ev""")


def q08(s, d):
    t0, t1 = ends(s, d)
    return Q.file_chain(files(s, d), t0 + 2 * D, t1 - 3 * D, JUMP, RET, D)


add("Q08_file_chain", q08, sql("files", f"""
WITH t AS (SELECT min(ts_us)+{2 * D} AS t0, max(ts_us)-{3 * D} AS t1 FROM ev), w AS (SELECT component, max(st) FILTER (WHERE st<=t0) AS lo, min(st) FILTER (WHERE st>=t1) AS hi FROM files, t GROUP BY 1),
c AS (SELECT f.*, lead(st) OVER (PARTITION BY component ORDER BY st, file) AS nx, t0, t1 FROM files f JOIN w USING (component), t WHERE st >= coalesce(lo,t0) AND (hi IS NULL OR st <= hi)),
g AS (SELECT component, count(*) AS fc, count(*) FILTER (WHERE st<t1) AS fi, count(*) FILTER (WHERE nx-st > {JUMP}) AS j, max(nx-st) AS mj, count(*) FILTER (WHERE st<t1 AND err='bad header') AS fe, count(*) FILTER (WHERE err='read failed') AS un, count(*) FILTER (WHERE st<t1 AND err IS NULL AND rec=0) AS em, sum(rec) FILTER (WHERE st<t1) AS rec FROM c GROUP BY 1),
r AS (SELECT component, min(rd) AS r0, max(rd) AS r1, max(dr) AS dg FROM (SELECT component, rd, rd-lag(rd) OVER (PARTITION BY component ORDER BY rd) AS dr FROM files) GROUP BY 1),
y AS (SELECT *, NOT (r0 > t0+{RET - JUMP} OR dg > {RET - JUMP} OR r1 < t1+{2 * JUMP}) AS rc FROM w LEFT JOIN g USING (component) LEFT JOIN r USING (component), t)
SELECT component, CAST(fc AS BIGINT) AS files_chain, CAST(fi AS BIGINT) AS files_inside, CAST(j AS BIGINT) AS jumps, mj AS max_jump_us, CAST(fe AS BIGINT) AS format_errors, CAST(un AS BIGINT) AS unchecked, CAST(em AS BIGINT) AS empty, CAST(rec AS BIGINT) AS records, CAST(0 AS BIGINT) AS conflicts, rc AS reading_complete,
 CASE WHEN fe>0 THEN false WHEN NOT rc OR un>0 OR fi=0 THEN NULL ELSE true END AS readable, CASE WHEN NOT rc OR un>0 THEN NULL ELSE NOT (lo IS NULL OR hi IS NULL OR j>0 OR em>0) END AS continuous FROM y"""))


def q09(s, d):
    x = table(s, d, "ev").select(F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("target"), F.col("event_id").alias("rec_id"), "ts_us", "k", "user_id")
    odd = F.col("user_id") % 7
    seq = F.when((F.col("rec_id") % 499 == 0) & (odd == 2), F.lit(None)).otherwise(F.col("rec_id") - F.when((F.col("rec_id") % 800 == 0) & (odd < 2), 400).otherwise(0))
    dl = x.where("k % 3 = 0").select("target", F.col("rec_id").alias("seq"))
    rc = x.where("k % 3 = 0").select("target", "rec_id", "ts_us", seq.alias("seq"), F.when((F.col("k") == 51) & (odd == 3), "rechazado").otherwise("aceptado").alias("state"))
    pb = x.where("k % 3 = 1").select("target", "rec_id", "ts_us", seq.alias("seq"))
    return Q.sequence_check(dl, rc, pb, D)


add("Q09_sequence_check", q09, sql("ev", """
WITH x AS (SELECT 't'||(user_id%7) AS target, event_id AS id, ts_us, k, user_id%7 AS o, CASE WHEN event_id%499=0 AND user_id%7=2 THEN NULL ELSE event_id-CASE WHEN event_id%800=0 AND user_id%7<2 THEN 400 ELSE 0 END END AS seq FROM ev),
a AS (SELECT *, lag(seq) OVER (PARTITION BY target ORDER BY ts_us, id) AS s0 FROM x WHERE k%3=0 AND NOT (k=51 AND o=3)), p AS (SELECT *, lag(seq) OVER (PARTITION BY target ORDER BY ts_us, id) AS s0 FROM x WHERE k%3=1 AND seq IS NOT NULL),
g AS (SELECT target, (SELECT count(*) FROM x d WHERE d.target=t.target AND k%3=0) AS n, (SELECT count(*) FROM x d WHERE d.target=t.target AND k%3=0 AND d.id NOT IN (SELECT seq FROM a WHERE a.target=t.target AND seq IS NOT NULL)) AS na, (SELECT count(*) FILTER (WHERE seq<=s0) FROM a WHERE a.target=t.target) AS dis,
 (SELECT count(*) FILTER (WHERE seq IS NULL) FROM a WHERE a.target=t.target) AS an, (SELECT count(*) FILTER (WHERE seq<s0) FROM p WHERE p.target=t.target) AS rg, (SELECT count(*) FILTER (WHERE seq IS NULL) FROM x q WHERE q.target=t.target AND k%3=1) AS fl FROM (SELECT DISTINCT target FROM x) t),
v AS (SELECT *, na=0 AS da, CASE WHEN dis>0 THEN false WHEN an>0 THEN NULL ELSE true END AS ao, CASE WHEN rg>0 THEN false WHEN fl>0 THEN NULL ELSE true END AS pf FROM g)
SELECT target, CAST(n AS BIGINT) AS n_del, CAST(na AS BIGINT) AS not_accepted, CAST(dis AS BIGINT) AS disorder, CAST(rg AS BIGINT) AS regress, CAST(fl AS BIGINT) AS failed, da AS delivered_accepted, ao AS accepted_in_order, pf AS publisher_forward, da AND ao AND pf AS verdict FROM v"""))


def q10(s, d):
    t0, t1 = ends(s, d)
    n, u = F.col("event_id"), F.col("user_id") % 9
    x = table(s, d, "ev").select(
        F.concat(F.lit("c"), u.cast("string")).alias("component"), n.alias("sample_id"), "ts_us", F.when((u == 1) & (n % 503 == 0), F.lit(None)).otherwise(F.when((u == 2) & (n > 3000), 2).otherwise(1)).alias("pid"),
        (~((u == 3) & (n % 607 == 0))).alias("active"), F.when((u == 4) & (n % 401 == 0), F.lit(None)).otherwise(F.col("k") + F.when(u == 5, 0).otherwise(50)).cast("double").alias("free"),
        F.when((u == 6) & (n % 709 == 0), "r2").otherwise("r1").alias("ruleset"), F.when(u == 7, n).otherwise(F.lit(4)).alias("applied"))
    return Q.polled_checks(x, t0 + D, t1 - D, 11 * H, 20.0, D)


add("Q10_polled_checks", q10, sql("ev", f"""
WITH t AS (SELECT min(ts_us)+{D} AS t0, max(ts_us)-{D} AS t1 FROM ev), x AS (SELECT 'c'||(user_id%9) AS component, ts_us, event_id AS n, user_id%9 AS u, CASE WHEN user_id%9=1 AND event_id%503=0 THEN NULL WHEN user_id%9=2 AND event_id>3000 THEN 2 ELSE 1 END AS pid, NOT (user_id%9=3 AND event_id%607=0) AS act,
 CASE WHEN user_id%9=4 AND event_id%401=0 THEN NULL ELSE k+CASE WHEN user_id%9=5 THEN 0 ELSE 50 END END AS fr, CASE WHEN user_id%9=6 AND event_id%709=0 THEN 'r2' ELSE 'r1' END AS rs, CASE WHEN user_id%9=7 THEN event_id ELSE 4 END AS ap FROM ev),
s AS (SELECT x.*, t0, t1, ts_us-lag(ts_us) OVER (PARTITION BY component ORDER BY ts_us, n) AS g FROM x, t WHERE ts_us BETWEEN t0-{11 * H} AND t1+{11 * H}),
a AS (SELECT component, count(*) FILTER (WHERE ts_us BETWEEN t0 AND t1) AS ins, any_value(t0)-max(ts_us) FILTER (WHERE ts_us<=t0) AS bf, min(ts_us) FILTER (WHERE ts_us>=t1)-any_value(t1) AS af, max(g) AS g, count(DISTINCT pid) AS pids, count(*) FILTER (WHERE NOT act) AS ina, count(*) FILTER (WHERE pid IS NULL) AS np,
 min(fr) FILTER (WHERE ts_us BETWEEN t0 AND t1) AS fm, count(*) FILTER (WHERE ts_us BETWEEN t0 AND t1 AND fr IS NULL) AS nf, count(DISTINCT rs) AS rs, arg_max(ap, ts_us)-arg_min(ap, ts_us) AS na FROM s GROUP BY 1), c AS (SELECT *, coalesce(ins>0 AND bf<={11 * H} AND af<={11 * H} AND g<={11 * H}, false) AS cv FROM a)
SELECT component, cv AS covered, CASE WHEN NOT cv OR np>0 THEN NULL ELSE NOT (pids>1 OR ina>0) END AS same_process, CASE WHEN NOT cv OR nf>0 THEN NULL ELSE fm>=20 END AS disk_free, CASE WHEN NOT cv THEN NULL ELSE NOT (rs<>1 OR na<>0) END AS rules_constant FROM c"""))


def res(s, d):
    """Cumulative resource counters: microseconds of work that grow with time and phase."""
    x = cs(s, d)
    t = F.col("ts_us") - F.lit(1_704_000_000_000_000)
    phase = F.pmod(idiv(t, 2 * D), F.lit(5))
    part = lambda f: (idiv(t, 100) * f + F.col("k") * 1_000_000).cast("long")
    hot = F.when(phase == 2, 95).otherwise(40)
    return x.select("component", "sample_id", "ts_us", "pid", t.alias("total_us"), part(60).alias("busy_us"), part(85).alias("thread_us"), part(30).alias("softirq_us"), part(F.when(F.col("component") == "c1", 96).otherwise(20)).alias("disk_us"),
                    part(12).alias("psi_cpu_us"), part(F.when(F.col("component") == "c1", 15).otherwise(1)).alias("psi_io_us"), part(2).alias("psi_mem_us"), hot.alias("hot"), idiv(t, 40 * H).alias("bytes"), (F.col("k") + 10).cast("double").alias("free"))


LIM = {"cpu": 62.0, "threads": 90.0, "softirq": 40.0, "disk": 90.0}
BASE = 1_704_000_000_000_000
view("res", "cs", f"""SELECT component, sample_id, ts_us, pid, ts_us-{BASE} AS total_us, CAST((ts_us-{BASE})//100*60+CAST(k AS BIGINT)*1000000 AS BIGINT) AS busy_us, CAST((ts_us-{BASE})//100*85+CAST(k AS BIGINT)*1000000 AS BIGINT) AS thread_us, CAST((ts_us-{BASE})//100*30+CAST(k AS BIGINT)*1000000 AS BIGINT) AS softirq_us,
  CAST((ts_us-{BASE})//100*CASE WHEN component='c1' THEN 96 ELSE 20 END+CAST(k AS BIGINT)*1000000 AS BIGINT) AS disk_us, CAST((ts_us-{BASE})//100*12+CAST(k AS BIGINT)*1000000 AS BIGINT) AS psi_cpu_us, CAST((ts_us-{BASE})//100*CASE WHEN component='c1' THEN 15 ELSE 1 END+CAST(k AS BIGINT)*1000000 AS BIGINT) AS psi_io_us,
  CAST((ts_us-{BASE})//100*2+CAST(k AS BIGINT)*1000000 AS BIGINT) AS psi_mem_us, (ts_us-{BASE})//{40 * H} AS bytes, CAST(k+10 AS DOUBLE) AS free FROM cs""")
RN = ["pid", "busy_us", "total_us", "thread_us", "softirq_us", "disk_us", "psi_cpu_us", "psi_io_us", "psi_mem_us"]
view("reslag", "res", "SELECT *, ts_us-x AS dt FROM (SELECT *, lag(ts_us) OVER w AS x, " + ", ".join(f"lag({n}) OVER w AS x_{n}" for n in RN) + " FROM res WINDOW w AS (PARTITION BY component ORDER BY ts_us, sample_id)) WHERE x IS NOT NULL")


def pc(n, by):
    return f"(CASE WHEN {n} >= x_{n} THEN CAST(100 AS DOUBLE)*({n}-x_{n}) END / nullif({by},0))"


PM = 3 * H
SATX = {"cpu": f"{pc('busy_us', '(total_us-x_total_us)')} >= 62 AND {pc('psi_cpu_us', 'dt')} >= 10", "threads": f"CASE WHEN pid=x_pid THEN {pc('thread_us', 'dt')} >= 90 END", "softirq": f"{pc('softirq_us', '(total_us-x_total_us)')} >= 40",
        "disk": f"{pc('disk_us', 'dt')} >= 90 AND {pc('psi_io_us', 'dt')} >= 10", "memory": f"{pc('psi_mem_us', 'dt')} >= 10"}
view("satp", "reslag", " UNION ALL ".join(f"SELECT component, sample_id, x, ts_us, '{r}' AS resource, CASE WHEN dt>0 AND dt<={PM} THEN {e} END AS sat FROM reslag" for r, e in SATX.items()))


def pairs(s, d):
    return Q.saturation(res(s, d), LIM, 10.0, PM, D)


add("Q11_saturation", lambda s, d: pairs(s, d).select("sample_id", "resource", "saturated"), sql("satp", "SELECT sample_id, resource, sat AS saturated FROM satp"))


def sat_eps(s, d, lo, hi):
    return Q.saturation_episodes(pairs(s, d), lo, hi, 30 * 60 * 1_000_000, 0.9, 4 * H, D)


def window(s, d):
    t0, t1 = ends(s, d)
    return sat_eps(s, d, t0 + 10 * D, t0 + 20 * D)


def sat_sql(name: str, lo: str, hi: str) -> None:
    view(f"{name}p", "satp", f"SELECT component, resource, greatest(x, {lo}) AS lo, least(ts_us, {hi}) AS hi, CASE WHEN sat THEN 'S' ELSE 'N' END AS st FROM satp WHERE sat IS NOT NULL AND least(ts_us, {hi}) > greatest(x, {lo})")
    view(f"{name}t", f"{name}p", f"""SELECT * FROM {name}p UNION ALL SELECT component, resource, hi, nl, 'U' FROM (SELECT *, lead(lo) OVER (PARTITION BY component, resource ORDER BY lo, hi) AS nl FROM {name}p) WHERE nl > hi
      UNION ALL SELECT component, resource, {lo}, min(lo), 'U' FROM {name}p GROUP BY 1, 2 HAVING min(lo) > {lo} UNION ALL SELECT component, resource, max(hi), {hi}, 'U' FROM {name}p GROUP BY 1, 2 HAVING max(hi) < {hi}""")
    view(f"{name}r", f"{name}t", f"""SELECT *, sum(n1) OVER (PARTITION BY component, resource ORDER BY lo, hi) AS g1, sum(n2) OVER (PARTITION BY component, resource ORDER BY lo, hi) AS g2 FROM (SELECT *, hi-lo AS len, CASE WHEN lag(st='N') OVER w IS DISTINCT FROM (st='N') THEN 1 ELSE 0 END AS n1, CASE WHEN lag(st) OVER w IS DISTINCT FROM st THEN 1 ELSE 0 END AS n2
      FROM {name}t WINDOW w AS (PARTITION BY component, resource ORDER BY lo, hi))""")
    view(name, f"{name}r", f"""SELECT c.component, c.resource, CAST(cov AS BIGINT) AS covered_us, mh AS max_hole_us, CAST(coalesce(p,0) AS BIGINT) AS proved, CAST(coalesce(dbt,0) AS BIGINT) AS doubtful, cov >= CAST(0.9 AS DOUBLE)*({hi}-{lo}) AND mh <= {4 * H} AS coverage_ok FROM
      (SELECT component, resource, sum(CASE WHEN st<>'U' THEN len ELSE 0 END) AS cov, max(CASE WHEN st='U' THEN len ELSE 0 END) AS mh FROM {name}r GROUP BY 1, 2) c LEFT JOIN
      (SELECT component, resource, sum(pr) AS p, count(*) FILTER (WHERE pr=0 AND unk>0 AND pos >= 1800000000) AS dbt FROM (SELECT s.component, s.resource, s.g1, any_value(pos) AS pos, any_value(unk) AS unk, count(e.g2) AS pr FROM (SELECT component, resource, g1, sum(len) AS pos, sum(CASE WHEN st='U' THEN len ELSE 0 END) AS unk FROM {name}r WHERE st<>'N' GROUP BY 1, 2, 3) s
        LEFT JOIN (SELECT component, resource, g1, g2 FROM {name}r WHERE st='S' GROUP BY 1, 2, 3, 4 HAVING sum(len) >= 1800000000) e ON e.component=s.component AND e.resource=s.resource AND e.g1=s.g1 GROUP BY 1, 2, 3) GROUP BY 1, 2) x USING (component, resource)""")


T0 = "(SELECT min(ts_us) FROM cs)"
sat_sql("satw", f"({T0}+{10 * D})", f"({T0}+{20 * D})")
sat_sql("satb", f"({T0}+{D})", f"({T0}+{6 * D})")
add("Q12_saturation_episodes", window, sql("satw", "SELECT * FROM satw"))


def q13(s, d):
    t0, _ = ends(s, d)
    v = Q.saturation_verdict(window(s, d), sat_eps(s, d, t0 + D, t0 + 6 * D))
    rise = Q.counter_rise(cs(s, d), "drops", t0 + 10 * D, t0 + 14 * D, 4 * H, D)
    return v.join(rise, "component", "left")


add("Q13_saturation_verdict", q13, sql("satw satb", f"""
WITH v AS (SELECT w.component, w.resource, w.proved, w.doubtful, w.coverage_ok, CASE WHEN w.proved>0 THEN (CASE WHEN b.coverage_ok AND b.proved=0 AND b.doubtful=0 THEN false END) WHEN w.coverage_ok AND w.doubtful=0 THEN true END AS value FROM satw w LEFT JOIN satb b USING (component, resource)),
o AS (SELECT component, CASE WHEN count(*) FILTER (WHERE NOT value)>0 THEN false WHEN count(*) FILTER (WHERE value IS NULL)=0 THEN true END AS overall FROM v GROUP BY 1),
t AS (SELECT {T0}+{10 * D} AS a, {T0}+{14 * D} AS b), e AS (SELECT component, arg_min(ts_us, (abs(ts_us-a), ts_us)) FILTER (WHERE abs(ts_us-a)<={4 * H}) AS a, arg_min(ts_us, (abs(ts_us-b), ts_us)) FILTER (WHERE abs(ts_us-b)<={4 * H}) AS b FROM cs, t WHERE drops IS NOT NULL GROUP BY 1),
r AS (SELECT component, CASE WHEN count(*) FILTER (WHERE x>=a AND drops<d0)=0 THEN arg_max(drops, ts_us)-arg_min(drops, ts_us) END AS rise FROM (SELECT c.*, e.a, e.b FROM (SELECT *, lag(ts_us) OVER w AS x, lag(drops) OVER w AS d0 FROM cs WHERE drops IS NOT NULL WINDOW w AS (PARTITION BY component ORDER BY ts_us, sample_id)) c JOIN e USING (component) WHERE ts_us BETWEEN a AND b) GROUP BY 1)
SELECT v.*, overall, rise FROM v JOIN o USING (component) LEFT JOIN r USING (component)"""))
add("Q14_resource_summary", lambda s, d: r6(Q.resource_summary(res(s, d), D)), sql("res", """
WITH l AS (SELECT *, lag(ts_us) OVER w AS x, lag(busy_us) OVER w AS b0, lag(total_us) OVER w AS t0, lag(bytes) OVER w AS y0 FROM res WINDOW w AS (PARTITION BY component ORDER BY ts_us, sample_id)),
m AS (SELECT *, CASE WHEN total_us>t0 AND busy_us>=b0 THEN CAST(100 AS DOUBLE)*(busy_us-b0)/(total_us-t0) END AS sh, CASE WHEN x IS NOT NULL AND bytes=y0 THEN 0 ELSE 1 END AS gr FROM l), n AS (SELECT *, sum(gr) OVER (PARTITION BY component ORDER BY ts_us, sample_id) AS isl FROM m),
st AS (SELECT component, max(d) AS ls FROM (SELECT component, isl, max(ts_us)-min(ts_us) AS d FROM n GROUP BY 1, 2) GROUP BY 1), q AS (SELECT component, list_sort(list(sh) FILTER (WHERE sh IS NOT NULL)) AS v FROM m GROUP BY 1)
SELECT component, CAST(count(*) AS BIGINT) AS samples, CAST(count(DISTINCT pid) AS BIGINT) AS pids, min(free) AS free_min, max(ts_us-x) AS gap_max_us, any_value(ls) AS longest_stall_us, round(any_value(v[CAST(floor(0.5*(len(v)-1)) AS BIGINT)+1]),6) AS cpu_p50, round(any_value(v[CAST(floor(0.95*(len(v)-1)) AS BIGINT)+1]),6) AS cpu_p95
 FROM n JOIN st USING (component) JOIN q USING (component) GROUP BY 1"""))


def q15(s, d):
    t0, t1 = ends(s, d)
    x = table(s, d, "app")
    p = x.where("kind = 'tls'").select(F.concat(F.lit("p"), F.col("entity_ip")).alias("profile"), "entity_ip").distinct()
    return Q.slot_coverage(x, p, t0 + D, t1 - 2 * D, 12 * H)


add("Q15_slot_coverage", q15, sql("app", f"""
WITH t AS (SELECT min(ts_us)+{D} AS t0, max(ts_us)-{2 * D} AS t1 FROM app), n AS (SELECT greatest(1,(t1-t0)//{12 * H}) AS n, t0, t1 FROM t), p AS (SELECT DISTINCT entity_ip FROM app WHERE kind='tls'), e AS (SELECT entity_ip, unnest(range(0, n)) AS slot FROM p, n),
s AS (SELECT DISTINCT entity_ip, least((ts_us-t0)//{12 * H}, n-1) AS slot FROM app, n WHERE ts_us>=t0 AND ts_us<t1) SELECT entity_ip, CAST(slot AS BIGINT) AS slot, 'p'||entity_ip AS profile FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.entity_ip=e.entity_ip AND s.slot=e.slot)"""))
BIN = H // 2


def q16(s, d):
    t0, t1 = ends(s, d)
    x = table(s, d, "app").where("kind = 'tls' and status = 0 and tls_version = ''")
    return Q.burst_episodes(x, t0, t1, BIN, 5, 5, 3, 0.01)


add("Q16_burst_episodes", q16, sql("app cs", f"""
WITH t AS (SELECT min(ts_us) AS t0, max(ts_us) AS t1 FROM cs), n AS (SELECT t0, t1, (t1-t0+{BIN}-1)//{BIN} AS n FROM t), g AS (SELECT least((ts_us-t0)//{BIN}, n-1) AS bin, count(*) AS c FROM app, n WHERE kind='tls' AND tls_version='' AND ts_us>=t0 AND ts_us<t1 GROUP BY 1),
b AS (SELECT r.bin, coalesce(c,0) AS c, n FROM (SELECT unnest(range(0, n)) AS bin, n FROM n) r LEFT JOIN g USING (bin)), nd AS (SELECT greatest(5, ceil(3*greatest(sum(c)/CAST(any_value(n) AS DOUBLE), 0.01)*5-1e-9)) AS need FROM b),
s AS (SELECT bin, n, sum(c) OVER w AS s, sum(CASE WHEN c>0 THEN 1 ELSE 0 END) OVER w AS a FROM b WINDOW w AS (ORDER BY bin ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
h AS (SELECT bin, s, sum(nw) OVER (ORDER BY bin) AS ep FROM (SELECT *, CASE WHEN bin-lag(bin) OVER (ORDER BY bin) <= 4 THEN 0 ELSE 1 END AS nw FROM s, nd WHERE bin <= n-5 AND s>=need AND a>=3)), e AS (SELECT ep, min(bin) AS a, max(bin)+4 AS z, max(s) AS ms FROM h GROUP BY 1)
SELECT CAST(ep AS BIGINT) AS ep, a, z, CAST(ms AS BIGINT) AS max_sum, (SELECT CAST(sum(c) AS BIGINT) FROM b WHERE bin BETWEEN a AND z) AS flows FROM e"""))


def q17(s, d):
    m = materialize(measured(s, d))
    cl = Q.classify_period(m, coverage(s, d), incs(s, d), GAP, D)
    n = F.col("period_id")
    x = m.join(cl.select("period_id", "period_class"), "period_id").select(
        n.alias("case_id"), (n % 5 == 0).cast("int").alias("k_false"), (n % 7 == 0).cast("int").alias("k_null"), (n % 3 == 0).cast("int").alias("s_false"), (n % 11 == 0).cast("int").alias("s_null"), "period_class", F.col("state").alias("sensor_state"),
        "packets", "drops", F.when(n % 13 == 0, F.lit(True)).otherwise(F.col("state").isin(*Q.MEASURED)).alias("s12"))
    return Q.load_verdict(x)


view("cls", "meas2 rcov inc", f"""SELECT m.period_id, CASE WHEN coalesce(g,0)>0 OR coalesce(r,0)>0 OR state NOT IN ('cero_explicito','descartes') OR reasons<>'' THEN 'C3' WHEN c.dd>0 THEN 'C2' WHEN state='descartes' THEN 'C1' ELSE 'C0' END AS cls, state, CASE WHEN state IN ('cero_explicito','descartes') THEN m.dp END AS packets, CASE WHEN state IN ('cero_explicito','descartes') THEN m.dd END AS drops
  FROM meas2 m LEFT JOIN (SELECT period_id, count(*) FILTER (WHERE inc.state='restart') AS r, count(*) FILTER (WHERE ts_us-x > {GAP}) AS g FROM per JOIN inc ON inc.component=per.component AND ts_us BETWEEN t0 AND t1 GROUP BY 1) i USING (period_id) LEFT JOIN rcov c USING (period_id)""")
add("Q17_load_verdict", q17, sql("cls", """
WITH x AS (SELECT *, period_id AS n, state IN ('cero_explicito','descartes') AS me, CASE WHEN period_id%13=0 THEN true ELSE state IN ('cero_explicito','descartes') END AS s12 FROM cls),
b AS (SELECT *, CASE WHEN n%5=0 THEN 'carga insuficiente' WHEN n%7=0 OR n%11=0 THEN 'no demostrable' WHEN n%3=0 THEN 'no estable' ELSE 'estable con carga suficiente' END AS base, concat_ws('; ', CASE WHEN me<>s12 THEN 'S12 against the measurement' END, CASE WHEN cls='C0' AND (state<>'cero_explicito' OR coalesce(drops,1)<>0) THEN 'C0 against the measurement' END,
 CASE WHEN cls='C1' AND (state<>'descartes' OR coalesce(drops,0)=0) THEN 'C1 against the measurement' END, CASE WHEN cls='C2' AND NOT me THEN 'C2 without a measurement' END) AS con FROM x),
v AS (SELECT *, CASE WHEN con<>'' AND base<>'carga insuficiente' THEN 'no demostrable' WHEN cls='C3' AND base='estable con carga suficiente' THEN 'no demostrable' ELSE base END AS ver FROM b)
SELECT n AS case_id, ver AS verdict, ver='estable con carga suficiente' AND con='' AND cls<>'C3' AS enables, con AS contradictions FROM v"""))


def q18(s, d):
    c = cs(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("user_id").alias("case_id"), "n")
    a = c.where("case_id % 4 > 0").select("case_id", (F.col("case_id") % 5 > 0).alias("period_ok"), (F.col("n") > 65).alias("K1"), F.when(F.col("n") % 3 > 0, F.col("n") % 2 == 0).alias("K2"))
    b = c.where("case_id % 3 > 0").select("case_id", F.lit(True).alias("period_ok"), (F.col("n") % 7 > 2).alias("S1"))
    return Q.criteria_table(c.select("case_id"), {"compare": a, "host": b}, {"compare": ["K1", "K2"], "host": ["S1"]})


add("Q18_criteria_table", q18, sql("cs", """WITH c AS (SELECT user_id AS i, count(*) AS n FROM cs GROUP BY 1)
SELECT i AS case_id, 'K1' AS criterion, 'compare' AS source, CASE WHEN i%4>0 AND i%5>0 THEN n>65 END AS value FROM c UNION ALL SELECT i, 'K2', 'compare', CASE WHEN i%4>0 AND i%5>0 AND n%3>0 THEN n%2=0 END FROM c UNION ALL SELECT i, 'S1', 'host', CASE WHEN i%3>0 THEN n%7>2 END FROM c"""))


def q19(s, d):
    n = F.col("sample_id")
    x = cs(s, d).select(
        "component", "sample_id", "ts_us", F.when(n % 400 == 0, F.lit(None)).otherwise(n % 450 > 0).alias("active"), "pid", ((F.col("k") % 90).cast("long") * 60_000_000).alias("ring_jump_us"), F.floor(n / 500).alias("failures"), F.col("drops").alias("kernel_drops"),
        (F.col("ts_us") - F.col("k").cast("long") * 60_000_000).alias("reading_us"), (F.col("k") / 100.0).alias("offset_s"), F.lit(0).alias("applied"), ((n > 9000) & (n % 600 == 0)).cast("int").alias("off_list"), F.lit(0.1).alias("bad_share"))
    c = Q.watch_conditions(x, 88 * 60_000_000, 97 * 60_000_000, 0.985, D)
    return c.select("sample_id", "pauses", "cancels", "state").join(Q.watch_decisions(c, 6 * H, D).select("sample_id", "decision"), "sample_id")


add("Q19_watch_conditions", q19, sql("cs", f"""
WITH l AS (SELECT *, lag(pid) OVER w AS pid0, lag(sample_id//500) OVER w AS f0, lag(drops) OVER w AS d0 FROM cs WINDOW w AS (PARTITION BY component ORDER BY ts_us, sample_id)),
p AS (SELECT component, sample_id, ts_us, concat_ws(',', CASE WHEN sample_id%400=0 OR sample_id%450=0 OR pid<>pid0 THEN 'P1' END, CASE WHEN k/CAST(100 AS DOUBLE) > 0.985 THEN 'P2' END, CASE WHEN k%90 > 88 OR sample_id//500 > f0 THEN 'P3' END, CASE WHEN k > 97 OR (pid=pid0 AND drops>d0) THEN 'P4' END) AS pauses,
 CASE WHEN sample_id>9000 AND sample_id%600=0 THEN 'X3' ELSE '' END AS cancels FROM l), q AS (SELECT *, CASE WHEN cancels<>'' THEN 'cancelar' WHEN pauses<>'' THEN 'pausa' ELSE 'continuar' END AS state FROM p)
SELECT sample_id, pauses, cancels, state, CASE WHEN max(CASE WHEN state='cancelar' THEN 1 ELSE 0 END) OVER w=1 THEN 'cancelar' WHEN state='pausa' OR ts_us-max(CASE WHEN state='pausa' THEN ts_us END) OVER w < {6 * H} THEN 'pausa' ELSE 'continuar' END AS decision FROM q WINDOW w AS (PARTITION BY component ORDER BY ts_us, sample_id)"""))


def q20(s, d):
    x = table(s, d, "http")
    allowed = s.createDataFrame([(f"10.20.0.{i}",) for i in (1, 2, 5)], "ip string")
    return Q.offlist(x, "10.10.1.12", allowed)


add("Q20_offlist", q20, sql("http", "SELECT dest_ip, CAST(count(*) AS BIGINT) AS events, min(ts_us) AS first_us FROM http WHERE src_ip='10.10.1.12' AND dest_ip NOT IN ('10.20.0.1','10.20.0.2','10.20.0.5') GROUP BY 1"))
