"""Queries N01-N10 (N04 is in the streaming catalogue)."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.operators import scan as N
from netlens.operators.core import materialize
from netlens.plans.adapt import DAY_US as D, SCOPE, sql, table, view
from netlens.plans.q_prep import H
from netlens.plans.registry import add

GAP, W, G, K, REF = H // 2, D, 2 * H, 5, 2 * D

view("tcpd", "tcp", f"""SELECT * FROM (SELECT *, lag(ts_us) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, tcp_flags, tcp_seq, ip_length ORDER BY ts_us, arrival) AS p FROM tcp) WHERE p IS NULL OR ts_us - p >= {GAP}""")
view("att0", "tcpd", """SELECT * FROM (SELECT src_ip, src_port, dst_ip, dst_port AS port, ts_us AS syn_us, arrival AS attempt_id,
   row_number() OVER (PARTITION BY src_ip, src_port, dst_ip, dst_port, tcp_seq ORDER BY ts_us, arrival) AS rn FROM tcpd WHERE tcp_flags=2 AND src_ip LIKE '10.10.%') WHERE rn=1""")
view("att1", "att0", "SELECT *, lead(syn_us) OVER (PARTITION BY src_ip, src_port, dst_ip, port ORDER BY syn_us, attempt_id) AS next_us FROM att0")
view("att", "att1 tcpd", """SELECT attempt_id, src_ip, dst_ip, port, syn_us, r.ts_us AS reply_us, r.reply FROM att1 a LEFT JOIN
  (SELECT a.attempt_id AS aid, min(t.ts_us) AS ts_us, arg_min(CASE t.tcp_flags WHEN 18 THEN 'SA' ELSE 'R' END, t.ts_us) AS reply FROM att1 a JOIN tcpd t ON t.tcp_flags IN (18,4) AND t.src_ip=a.dst_ip AND t.dst_ip=a.src_ip
     AND t.src_port=a.port AND t.dst_port=a.src_port AND t.ts_us >= a.syn_us AND (a.next_us IS NULL OR t.ts_us < a.next_us) GROUP BY 1) r ON r.aid=a.attempt_id""")
view("fails", "att", f"""SELECT *, CASE WHEN reply='R' THEN reply_us WHEN reply IS NULL OR reply_us-syn_us>{G} THEN syn_us+{G} END AS fail_us,
  CASE WHEN reply='SA' AND reply_us-syn_us>{G} THEN reply_us END AS end_us FROM att WHERE reply IS DISTINCT FROM 'SA' OR reply_us-syn_us>{G}""")
view("fcnt", "fails", f"""SELECT a.src_ip, a.dst_ip, a.fail_us, a.syn_us, a.port, a.attempt_id, count(DISTINCT b.port) AS n FROM fails a JOIN fails b ON a.src_ip=b.src_ip AND a.dst_ip=b.dst_ip
  AND (b.fail_us, b.syn_us, b.port, b.attempt_id) <= (a.fail_us, a.syn_us, a.port, a.attempt_id) AND b.syn_us > a.fail_us-{W} AND (b.end_us IS NULL OR b.end_us > a.fail_us) GROUP BY ALL""")


def attempts(s, d):
    return N.syn_attempts(table(s, d, "tcp"), SCOPE, GAP, D)


def triggers(s, d):
    return N.scan_triggers(attempts(s, d), K, W, G, REF, 4 * D)


add("N01_syn_attempts", attempts, sql("att", "SELECT * FROM att"))
add("N02_failure_events", lambda s, d: N.failure_events(attempts(s, d), G).select("attempt_id", "fail_us", "end_us"),
    sql("fails", "SELECT attempt_id, fail_us, end_us FROM fails"))
TRIG = f"""n AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY fail_us, syn_us, port, attempt_id) AS rn FROM fcnt WHERE n >= {K}),
walk AS (SELECT src_ip, dst_ip, rn, fail_us AS last, attempt_id, n AS ports, true AS keep FROM n WHERE rn=1
  UNION ALL SELECT n.src_ip, n.dst_ip, n.rn, CASE WHEN n.fail_us-w.last < {REF} THEN w.last ELSE n.fail_us END, n.attempt_id, n.n, n.fail_us-w.last >= {REF}
  FROM walk w JOIN n ON n.src_ip=w.src_ip AND n.dst_ip=w.dst_ip AND n.rn=w.rn+1),
trig AS (SELECT src_ip, dst_ip, last AS trigger_us, ports AS failed_ports, attempt_id FROM walk WHERE keep)"""
add("N03_scan_triggers", lambda s, d: triggers(s, d).select("src_ip", "dst_ip", "trigger_us", "failed_ports", "attempt_id"),
    sql("fcnt", f"WITH RECURSIVE {TRIG} SELECT src_ip, dst_ip, trigger_us, CAST(failed_ports AS INT) AS failed_ports, attempt_id FROM trig"))


def signals(s, d):
    a = materialize(attempts(s, d))  # triggers, tries and failures read it
    return N.scan_signals(a, N.scan_triggers(a, K, W, G, REF, 4 * D), W, G, D)


add("N05_scan_signals",
    lambda s, d: signals(s, d).withColumn("port_sample", F.array_join("port_sample", ",")),
    sql("fcnt att fails", f"""WITH RECURSIVE {TRIG}
SELECT t.src_ip, t.dst_ip, trigger_us, CAST(failed_ports AS INT) AS failed_ports,
 (SELECT CAST(count(*) AS BIGINT) FROM att a WHERE a.src_ip=t.src_ip AND a.dst_ip=t.dst_ip AND a.syn_us > trigger_us-{W} AND a.syn_us <= trigger_us) AS attempts_in_window,
 (SELECT min(syn_us) FROM att a WHERE a.src_ip=t.src_ip AND a.dst_ip=t.dst_ip AND a.syn_us > trigger_us-{W} AND a.syn_us <= trigger_us) AS first_attempt_us,
 (SELECT array_to_string(list_sort(list(DISTINCT port))[1:25], ',') FROM fails f WHERE f.src_ip=t.src_ip AND f.dst_ip=t.dst_ip AND f.fail_us <= trigger_us AND f.fail_us > trigger_us-{W} AND f.syn_us > trigger_us-{W} AND (f.end_us IS NULL OR f.end_us > trigger_us)) AS port_sample,
 substr(sha256(t.src_ip||'>'||t.dst_ip||'|'||CAST(trigger_us // 1000000 AS STRING)||'.'||lpad(CAST(trigger_us % 1000000 AS STRING),6,'0')||'|{N.SIGNAL_VERSION}'),1,16) AS signal_id FROM trig t"""))

ATK = ["10.10.1.13", "10.10.1.14"]


def pair_episodes(s, d):
    return table(s, d, "tcp").where("tcp_flags = 18").select(
        F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), F.col("arrival").alias("episode_id"),
        F.col("ts_us").alias("t0_us"), (F.col("ts_us") + F.lit(D)).alias("t1_us")).where(F.col("src_ip").isin(ATK))


view("peps", "tcp", f"SELECT dst_ip AS src_ip, src_ip AS dst_ip, arrival AS episode_id, ts_us AS t0_us, ts_us+{D} AS t1_us FROM tcp WHERE tcp_flags=18 AND dst_ip IN ('10.10.1.13','10.10.1.14')")


def n06(s, d):
    combos = s.createDataFrame([(w, k, g) for w in (D // 2, D) for k in (3, 5) for g in (H, 3 * H)], "window_us long, k int, grace_us long")
    return N.scan_grid(attempts(s, d), combos, pair_episodes(s, d), ATK, REF, 4 * D, D)


add("N06_scan_grid", n06, sql("att peps", f"""
WITH RECURSIVE c AS (SELECT CAST(w AS BIGINT) AS w, CAST(k AS INT) AS k, CAST(g AS BIGINT) AS g FROM (VALUES ({D // 2}),({D})) a(w), (VALUES (3),(5)) b(k), (VALUES ({H}),({3 * H})) e(g)),
wg AS (SELECT DISTINCT w, g FROM c),
f AS (SELECT att.*, w, g, CASE WHEN reply='R' THEN reply_us ELSE syn_us+g END AS fail_us, CASE WHEN reply='SA' THEN reply_us END AS end_us FROM att, wg WHERE reply IS DISTINCT FROM 'SA' OR reply_us-syn_us>g),
h AS (SELECT a.w, a.g, a.src_ip, a.dst_ip, a.fail_us, a.syn_us, a.port, a.attempt_id, count(DISTINCT b.port) AS n FROM f a JOIN f b ON a.w=b.w AND a.g=b.g AND a.src_ip=b.src_ip AND a.dst_ip=b.dst_ip
  AND (b.fail_us, b.syn_us, b.port, b.attempt_id) <= (a.fail_us, a.syn_us, a.port, a.attempt_id) AND b.syn_us > a.fail_us-a.w AND (b.end_us IS NULL OR b.end_us > a.fail_us) GROUP BY ALL),
n AS (SELECT h.*, k, row_number() OVER (PARTITION BY h.w, h.g, k, src_ip, dst_ip ORDER BY fail_us, syn_us, port, attempt_id) AS rn FROM h JOIN c ON c.w=h.w AND c.g=h.g AND h.n>=c.k),
walk AS (SELECT w, g, k, src_ip, dst_ip, rn, fail_us AS last, attempt_id, true AS keep FROM n WHERE rn=1
  UNION ALL SELECT n.w, n.g, n.k, n.src_ip, n.dst_ip, n.rn, CASE WHEN n.fail_us-x.last < {REF} THEN x.last ELSE n.fail_us END, n.attempt_id, n.fail_us-x.last >= {REF}
  FROM walk x JOIN n ON n.w=x.w AND n.g=x.g AND n.k=x.k AND n.src_ip=x.src_ip AND n.dst_ip=x.dst_ip AND n.rn=x.rn+1),
t AS (SELECT * FROM walk WHERE keep)
SELECT c.w AS window_us, c.k, c.g AS grace_us, CAST(count(t.attempt_id) FILTER (WHERE t.src_ip IN ('10.10.1.13','10.10.1.14')) AS BIGINT) AS attacker_hits,
 CAST(count(t.attempt_id) FILTER (WHERE t.src_ip NOT IN ('10.10.1.13','10.10.1.14')) AS BIGINT) AS legit_hits,
 CAST(count(DISTINCT t.src_ip||t.dst_ip) FILTER (WHERE t.src_ip NOT IN ('10.10.1.13','10.10.1.14')) AS BIGINT) AS legit_pairs,
 (SELECT CAST(count(DISTINCT p.episode_id) AS BIGINT) FROM t q JOIN peps p ON q.src_ip=p.src_ip AND q.dst_ip=p.dst_ip AND q.last BETWEEN p.t0_us AND p.t1_us WHERE q.w=c.w AND q.k=c.k AND q.g=c.g) AS episodes_hit,
 (SELECT CAST(count(DISTINCT q.attempt_id) AS BIGINT) FROM t q JOIN peps p ON q.src_ip=p.src_ip AND q.dst_ip=p.dst_ip AND q.last BETWEEN p.t0_us AND p.t1_us WHERE q.w=c.w AND q.k=c.k AND q.g=c.g) AS hits_inside
FROM c LEFT JOIN t ON t.w=c.w AND t.k=c.k AND t.g=c.g GROUP BY 1, 2, 3"""))


def n07(s, d):
    wg = s.createDataFrame([(D, G), (2 * D, G), (D, 4 * H)], "window_us long, grace_us long")
    return N.scan_margin(attempts(s, d), wg, 4 * D)


add("N07_scan_margin", n07, sql("att", f"""
WITH wg AS (SELECT CAST(w AS BIGINT) AS w, CAST(g AS BIGINT) AS g FROM (VALUES ({D},{G}),({2 * D},{G}),({D},{4 * H})) a(w,g)),
f AS (SELECT att.*, w, g, CASE WHEN reply='R' THEN reply_us ELSE syn_us+g END AS fail_us, CASE WHEN reply='SA' THEN reply_us END AS end_us FROM att, wg WHERE reply IS DISTINCT FROM 'SA' OR reply_us-syn_us>g)
SELECT src_ip, dst_ip, w AS window_us, g AS grace_us, CAST(max(n) AS INT) AS max_ports FROM (SELECT a.w, a.g, a.src_ip, a.dst_ip, a.attempt_id, count(DISTINCT b.port) AS n FROM f a JOIN f b ON a.w=b.w AND a.g=b.g AND a.src_ip=b.src_ip AND a.dst_ip=b.dst_ip
  AND (b.fail_us, b.syn_us, b.port, b.attempt_id) <= (a.fail_us, a.syn_us, a.port, a.attempt_id) AND b.syn_us > a.fail_us-a.w AND (b.end_us IS NULL OR b.end_us > a.fail_us) GROUP BY ALL) GROUP BY ALL"""))


def scan_episodes(s, d):
    """Each reset opens an episode of a day against its target."""
    return table(s, d, "tcp").where("tcp_flags = 4").select(
        F.col("src_ip").alias("dst_ip"), F.col("arrival").alias("episode_id"), F.col("ts_us").alias("t0_us"), (F.col("ts_us") + F.lit(D)).alias("t1_us"))


add("N08_scan_anatomy", lambda s, d: N.scan_anatomy(attempts(s, d), table(s, d, "packets").unionByName(table(s, d, "tcp"), allowMissingColumns=True), scan_episodes(s, d), 4, 12 * H, D),
    sql("att tcp packets", f"""
WITH e AS (SELECT src_ip AS dst_ip, arrival AS episode_id, ts_us AS t0, ts_us+{D} AS t1 FROM tcp WHERE tcp_flags=4),
i AS (SELECT att.*, e.episode_id, t0 FROM att JOIN e ON att.dst_ip=e.dst_ip AND syn_us BETWEEN t0 AND t1),
src AS (SELECT episode_id, arg_max(src_ip, (n, src_ip)) AS src_ip FROM (SELECT episode_id, src_ip, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT i.* FROM i JOIN src USING (episode_id, src_ip)),
per AS (SELECT episode_id, src_ip, dst_ip, any_value(t0) AS t0, count(*) AS new_syns, count(*) FILTER (WHERE reply='SA') AS syn_acks, count(*) FILTER (WHERE reply='R') AS resets, max(syn_us) AS last_us FROM m GROUP BY 1, 2, 3),
p AS (SELECT episode_id, port, min(syn_us) AS s FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY episode_id) AS tot, lead(s, 3) OVER w AS ah FROM p WINDOW w AS (PARTITION BY episode_id ORDER BY s, port)),
z AS (SELECT episode_id, max(tot) AS ports, min(s) AS first_us, min(s) FILTER (WHERE ah-s <= {12 * H}) AS burst_us, min(s) FILTER (WHERE rn=5) AS port5_us, max(s) FILTER (WHERE rn <= greatest(1, floor(tot*0.95))) AS port95_us FROM r GROUP BY 1),
pk AS (SELECT src_ip, dst_ip, dst_port, protocol, ts_us FROM packets UNION ALL SELECT src_ip, dst_ip, dst_port, protocol, ts_us FROM tcp)
SELECT episode_id, per.src_ip, per.dst_ip, CAST(new_syns AS BIGINT) AS new_syns, CAST(syn_acks AS BIGINT) AS syn_acks, CAST(resets AS BIGINT) AS resets, last_us, CAST(ports AS BIGINT) AS ports, first_us, burst_us, port5_us, port95_us,
 (SELECT CAST(count(*) AS BIGINT) FROM pk WHERE pk.src_ip=per.src_ip AND pk.dst_ip=per.dst_ip AND pk.ts_us >= t0 AND pk.ts_us < burst_us) AS discovery_frames,
 (SELECT CAST(count(*) AS BIGINT) FROM pk WHERE pk.src_ip=per.src_ip AND protocol=17 AND dst_port=53 AND pk.ts_us >= t0 AND pk.ts_us < burst_us) AS reverse_lookups
FROM per JOIN z USING (episode_id)"""))


def cats(s, d):
    x = table(s, d, "tcp").where("tcp_flags = 18").select(F.col("dst_ip").alias("src_ip"), F.col("arrival").alias("episode_id"), F.col("ts_us").alias("t0_us"), (F.col("ts_us") + F.lit(6 * H)).alias("t1_us"))
    base = F.explode(F.array(F.lit("HEUR"), F.lit("HIB_0.05"), F.lit("FAST")))
    x = x.withColumn("base", base)
    cat = F.when(F.col("base") == "FAST", F.lit(None)).when(F.col("episode_id") % 5 == 0, "no_evaluable").when((F.col("episode_id") + F.length("base")) % 3 == 0, "oportuna").when(F.col("episode_id") % 2 == 0, "solo_posterior")
    return x.withColumn("category", cat)


view("cats", "tcp", f"""SELECT dst_ip AS src_ip, arrival AS episode_id, ts_us AS t0_us, ts_us+{6 * H} AS t1_us, base,
  CASE WHEN base='FAST' THEN NULL WHEN arrival%5=0 THEN 'no_evaluable' WHEN (arrival+length(base))%3=0 THEN 'oportuna' WHEN arrival%2=0 THEN 'solo_posterior' END AS category FROM tcp, (VALUES ('HEUR'),('HIB_0.05'),('FAST')) b(base) WHERE tcp_flags=18""")
add("N09_with_fast",
    lambda s, d: N.with_fast(cats(s, d), triggers(s, d), D, 3 * H, D).select("episode_id", "base", "category", "fast_category", "combined"),
    sql("fcnt cats", f"""WITH RECURSIVE {TRIG}, f AS (SELECT c.episode_id, c.base, c.category, c.t1_us, (SELECT min(trigger_us)+{3 * H} FROM trig t WHERE t.src_ip=c.src_ip AND trigger_us BETWEEN c.t0_us AND c.t1_us+{D}) AS fu FROM cats c),
 g AS (SELECT *, CASE WHEN fu <= t1_us THEN 'oportuna' WHEN fu IS NOT NULL THEN 'solo_posterior' END AS fc FROM f)
SELECT episode_id, base, category, fc AS fast_category, CASE WHEN category='no_evaluable' THEN category WHEN fc='oportuna' OR category='oportuna' THEN 'oportuna' WHEN fc='solo_posterior' OR category='solo_posterior' THEN 'solo_posterior' ELSE coalesce(category,'sin_senal_rapida') END AS combined FROM g"""))


def n10(s, d):
    t0 = table(s, d, "ev").agg(F.min("ts_us")).first()[0]
    return N.signal_counts(triggers(s, d), (t0 + 5 * D, t0 + 15 * D), ATK)


add("N10_signal_counts", n10, sql("fcnt", f"""WITH RECURSIVE {TRIG}, b AS (SELECT min(ts_us) AS t0 FROM ev)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE trigger_us >= t0+{5 * D} AND trigger_us < t0+{15 * D}) AS BIGINT) AS in_control,
 CAST(count(DISTINCT src_ip||dst_ip) FILTER (WHERE trigger_us >= t0+{5 * D} AND trigger_us < t0+{15 * D}) AS BIGINT) AS control_pairs,
 CAST(count(*) FILTER (WHERE src_ip NOT IN ('10.10.1.13','10.10.1.14')) AS BIGINT) AS off_attacker FROM trig, b"""))
