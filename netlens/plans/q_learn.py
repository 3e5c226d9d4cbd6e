"""Queries L01-L15."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.functions.columns import idiv
from netlens.operators import learn as L
from netlens.operators.core import to_long
from netlens.plans.adapt import DAY_US as D, sql, table, view
from netlens.plans.q_prep import H
from netlens.plans.registry import add, r6

X = ["x1", "x2", "x3", "x6"]
MARGIN = H


def ds(s, d):
    return table(s, d, "ds")


def bounds(s, d):
    t = table(s, d, "ev").agg(F.min("ts_us")).first()[0]
    return t + 3 * D, t + 25 * D


LO, HI = f"((SELECT min(ts_us) FROM ev)+{3 * D})", f"((SELECT min(ts_us) FROM ev)+{25 * D})"


def marked(s, d):
    dec = table(s, d, "dec").withColumn("rule", F.col("rule2"))
    al = table(s, d, "dns").where("rcode = 'NXDOMAIN'").select("src_ip", "dest_ip", "ts_us")
    return L.marks(dec, al, *bounds(s, d))


view("marks", "dec dns", f"""SELECT DISTINCT entity_ip, mark_us FROM (SELECT entity_ip, window_us AS mark_us FROM dec WHERE decision<>'PERMIT' OR rule2<>'' UNION ALL SELECT src_ip, ts_us FROM dns WHERE rcode='NXDOMAIN' UNION ALL SELECT dest_ip, ts_us FROM dns WHERE rcode='NXDOMAIN')
  WHERE mark_us >= {LO} AND mark_us < {HI}""")
add("L01_marks", marked, sql("marks", "SELECT entity_ip, mark_us FROM marks"))
view("clean", "ds marks", f"SELECT * FROM ds r WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.entity_ip=r.entity_ip AND abs(r.ts_us-m.mark_us) <= {MARGIN})")
add("L02_sanitize", lambda s, d: L.sanitize(ds(s, d), marked(s, d), "ts_us", MARGIN).select("row_id", "entity_ip"), sql("clean", "SELECT row_id, entity_ip FROM clean"))


def gold(s, d):
    return ds(s, d).where("partition = 'validation' and eligible and k < 70")


view("gold", "ds", "SELECT * FROM ds WHERE partition='validation' AND eligible AND k<70")
Q = 0.9
view("lim", "gold", " UNION ALL ".join(f"SELECT '{x}' AS feature, quantile_cont({x},{1 - Q}) AS lo, quantile_cont({x},{Q}) AS hi FROM gold" for x in X))
add("L03_limits", lambda s, d: r6(L.limits(gold(s, d), X, Q)), sql("lim", "SELECT feature, round(lo,6) AS lo, round(hi,6) AS hi, round(CASE WHEN hi=lo THEN 1 ELSE hi-lo END,6) AS width FROM lim"))
TOL = 0.02
OUT = "+".join(f"(SELECT CASE WHEN r.{x} > hi+{TOL}*(CASE WHEN hi=lo THEN 1 ELSE hi-lo END) OR r.{x} < lo-{TOL}*(CASE WHEN hi=lo THEN 1 ELSE hi-lo END) THEN 1 ELSE 0 END FROM lim WHERE feature='{x}')" for x in X)
add("L04_outliers", lambda s, d: L.outliers(ds(s, d), L.limits(gold(s, d), X, Q), X, TOL).select("row_id", "outlier_features"), sql("ds lim", f"SELECT row_id, {OUT} AS outlier_features FROM ds r"))


def psi_sql(ref: str, new: str, x: str) -> str:
    cuts = f"(SELECT list_sort(list_distinct(list_value({','.join(f'quantile_cont({x},{i / 10})' for i in range(1, 10))}))) FROM {ref})"
    return f"""SELECT '{x}' AS feature, round(sum((q-p)*ln(q/p)),6) AS psi FROM (SELECT b, greatest(coalesce(r.n,0)/CAST((SELECT count({x}) FROM {ref}) AS DOUBLE),0.0001) AS p, greatest(coalesce(w.n,0)/CAST((SELECT count({x}) FROM {new}) AS DOUBLE),0.0001) AS q FROM
 (SELECT unnest(generate_series(0, len({cuts}))) AS b) LEFT JOIN (SELECT len(list_filter({cuts}, lambda c: c<{x})) AS b, count(*) AS n FROM {ref} WHERE {x} IS NOT NULL GROUP BY 1) r USING (b) LEFT JOIN (SELECT len(list_filter({cuts}, lambda c: c<{x})) AS b, count(*) AS n FROM {new} WHERE {x} IS NOT NULL GROUP BY 1) w USING (b))"""


view("late", "ds", "SELECT * FROM ds WHERE partition='test'")
add("L05_psi", lambda s, d: L.psi(to_long(gold(s, d), [], X), to_long(ds(s, d).where("partition = 'test'"), [], X)), sql("gold late", " UNION ALL ".join(psi_sql("gold", "late", x) for x in X)))
POLICY = {"quantile": Q, "tolerance": TOL, "max_outliers": 2, "min_rows": 50, "psi_reject": 0.5}
view("kept", "clean lim", f"SELECT * FROM (SELECT r.*, {OUT} AS o FROM clean r WHERE eligible) WHERE o < 2")


def l06(s, d):
    _, rec = L.close_lot(ds(s, d), marked(s, d), gold(s, d), X, "ts_us", MARGIN, POLICY)
    return rec


add("L06_close_lot", l06, sql("clean kept gold", f"""WITH p AS ({' UNION ALL '.join(psi_sql('gold', 'kept', x) for x in X)}), n AS (SELECT (SELECT count(*) FROM ds) AS a, (SELECT count(*) FROM ds WHERE eligible) AS b, (SELECT count(*) FROM clean WHERE eligible) AS c, (SELECT count(*) FROM kept) AS k)
SELECT a AS n_input, a-b AS n_not_eligible, b-c AS n_contaminated, c-k AS n_outlier, k AS n_output, (SELECT max(psi) FROM p) AS psi_max, (SELECT arg_max(feature, (psi, feature)) FROM p) AS psi_worst,
 CASE WHEN k<50 THEN 'insuficiente' WHEN (SELECT max(psi) FROM p)>0.5 THEN 'rechazado' ELSE 'aceptado' END AS state FROM n"""))


def l07(s, d):
    lots = ds(s, d).withColumn("lot", idiv(F.col("row_id"), 50))
    dig = L.content_digest(lots, ["lot"], ["row_id"]).select("lot", F.concat_ws(":", "rows", "xor_digest").alias("digest"))
    log = dig.select("lot", F.col("lot").alias("seq"), F.concat(F.lit("lot "), F.col("lot").cast("string")).alias("body"), F.when(F.col("lot") % 9 == 0, "changed").otherwise(F.col("digest")).alias("lot_digest"))
    log = L.append_lineage(log, "seq", "body").withColumn("previous_hash", F.when(F.col("seq") % 14 == 5, "x").otherwise(F.col("previous_hash")))
    return L.verify_lineage(log, "seq", "body", dig.where("lot % 11 <> 3"), 1000)


add("L07_lineage", l07, sql("ds", """WITH l AS (SELECT DISTINCT row_id//50 AS lot FROM ds)
SELECT lot AS seq, lot, 'chain broken' AS problem FROM l WHERE lot%14=5 UNION ALL SELECT lot, lot, 'lot missing' FROM l WHERE lot%11=3 UNION ALL SELECT lot, lot, 'lot altered' FROM l WHERE lot%9=0 AND lot%11<>3"""))


def l08(s, d):
    g, dig = L.make_gold(ds(s, d), "validation", ["row_id", "label"])
    return dig.select("rows", "xor_digest")


add("L08_make_gold", l08, sql("ds", "SELECT CAST(count(*) AS BIGINT) AS rows, bit_xor(CAST('0x'||substr(sha256(row_id||'|'||label),1,15) AS BIGINT)) AS xor_digest FROM ds WHERE partition='validation' AND eligible"))


def l09(s, d):
    return L.limit_influence(ds(s, d), 9000, 0.25, 0.004, "ts_us", "row_id", 5 * D).select("row_id", "entity_ip")




def even(rank: str, total: str, n: str) -> str:
    return f"list_contains(list_transform(range(0, {n}), lambda i: CAST(floor(i*({total}/CAST({n} AS DOUBLE))) AS BIGINT)), {rank})"


view("infl", "ds", f"""SELECT row_id, entity_ip, ts_us FROM (SELECT *, row_number() OVER (PARTITION BY entity_ip ORDER BY ts_us, row_id)-1 AS r, count(*) OVER (PARTITION BY entity_ip) AS t, greatest(1, CAST(floor(CAST(0.004 AS DOUBLE)*(SELECT count(*) FROM ds)) AS BIGINT)) AS n FROM ds)
  WHERE n >= t OR {even('r', 't', 'n')}""")
add("L09_limit_influence", l09, sql("infl", """WITH x AS (SELECT *, row_number() OVER (ORDER BY ts_us, entity_ip, row_id)-1 AS r, count(*) OVER () AS t FROM infl), i AS (SELECT DISTINCT CAST(floor(j*((SELECT count(*) FROM infl)/CAST(3000 AS DOUBLE))) AS BIGINT) AS r FROM (SELECT unnest(range(0,3000)) AS j))
SELECT row_id, entity_ip FROM x WHERE t <= 3000 OR r IN (SELECT r FROM i)"""))


def scores(s, d):
    x = ds(s, d).withColumn("score", -0.3 - F.col("k") / 250.0 - F.col("x6") / 50)
    return x.withColumn("day", idiv(F.col("ts_us"), D))


view("sc", "ds", f"SELECT *, -0.3-k/CAST(250 AS DOUBLE)-x6/50 AS score, ts_us//{D} AS day FROM ds")
THR, PA, RM = -0.6, 0.12, 0.3


def drift_days(s, d):
    x = scores(s, d)
    dec = table(s, d, "dec").withColumn("day", idiv(F.col("logged_us"), D))
    return L.drift(x.where("partition = 'validation'"), x.where("partition = 'test'"), dec, THR, PA, RM)


view("gcut", "sc", f"SELECT list_sort(list_distinct(list_value({','.join(f'quantile_cont(score,{i / 10})' for i in range(1, 10))}))) AS cuts FROM sc WHERE partition='validation'")
view("drift", "sc gcut dec", f"""SELECT d.day, f AS gold_fpr, lot_rows, lar AS lot_anomaly_rate, psi AS psi_scores, ear AS engine_alert_rate, ed AS engine_decisions, psi > {PA} OR lar > {RM} AS signal FROM
 (SELECT day, round(sum((q-p)*ln(q/p)),6) AS psi FROM (SELECT e.day, e.b, greatest(coalesce(r.n,0)/CAST((SELECT count(*) FROM sc WHERE partition='validation') AS DOUBLE),0.0001) AS p, greatest(coalesce(w.n,0)/CAST(l.n AS DOUBLE),0.0001) AS q FROM
   (SELECT day, unnest(generate_series(0,(SELECT len(cuts) FROM gcut))) AS b FROM (SELECT DISTINCT day FROM sc WHERE partition='test')) e LEFT JOIN (SELECT len(list_filter(cuts, lambda c: c<score)) AS b, count(*) AS n FROM sc, gcut WHERE partition='validation' GROUP BY 1) r ON r.b=e.b
   LEFT JOIN (SELECT day, len(list_filter(cuts, lambda c: c<score)) AS b, count(*) AS n FROM sc, gcut WHERE partition='test' GROUP BY 1, 2) w ON w.day=e.day AND w.b=e.b JOIN (SELECT day, count(*) AS n FROM sc WHERE partition='test' GROUP BY 1) l ON l.day=e.day) GROUP BY 1) d
 JOIN (SELECT day, CAST(count(*) AS BIGINT) AS lot_rows, round(count(*) FILTER (WHERE score<{THR})/CAST(count(*) AS DOUBLE),6) AS lar FROM sc WHERE partition='test' GROUP BY 1) l USING (day)
 LEFT JOIN (SELECT logged_us//{D} AS day, round(count(*) FILTER (WHERE decision<>'PERMIT')/CAST(count(*) AS DOUBLE),6) AS ear, CAST(count(*) AS BIGINT) AS ed FROM dec GROUP BY 1) e USING (day), (SELECT round(count(*) FILTER (WHERE score<{THR})/CAST(count(*) AS DOUBLE),6) AS f FROM sc WHERE partition='validation')""")
add("L10_drift", drift_days, sql("drift", "SELECT * FROM drift"))
add("L11_sustained_drift", lambda s, d: L.sustained_drift(drift_days(s, d), 3), sql("drift", "SELECT count(*)>=3 AND bool_and(signal) AS sustained FROM (SELECT * FROM drift ORDER BY day DESC LIMIT 3)"))


def l12(s, d):
    days = drift_days(s, d)
    cand = days.where("signal").select("day")
    today = table(s, d, "ev").agg(F.max("ts_us")).first()[0] // D + 5
    return L.retrain_reason(L.sustained_drift(days, 3), cand, None, today, 7, 3)


add("L12_retrain_reason", l12, sql("drift", f"""WITH s AS (SELECT count(*)>=3 AND bool_and(signal) AS s FROM (SELECT * FROM drift ORDER BY day DESC LIMIT 3)), c AS (SELECT max(day) AS l FROM drift WHERE signal), t AS (SELECT max(ts_us)//{D}+5 AS t FROM ev)
SELECT s AS sustained, l AS last, CASE WHEN s THEN 'sustained drift 3 days' WHEN t-l>=7 THEN 'cadence of 7 days' END AS reason FROM s, c, t"""))


def l13(s, d):
    lots = ds(s, d).groupBy(idiv(F.col("row_id"), 50).alias("lot")).agg(F.when(F.max("k") > 95, "rechazado").when(F.min("k") > 0, "aceptado_a_mano").otherwise("aceptado").alias("state"))
    return L.pending_lots(lots, lots.where("lot % 4 = 1").select("lot"))


add("L13_pending_lots", l13, sql("ds", "SELECT * FROM (SELECT row_id//50 AS lot, CASE WHEN max(k)>95 THEN 'rechazado' WHEN min(k)>0 THEN 'aceptado_a_mano' ELSE 'aceptado' END AS state FROM ds GROUP BY 1) WHERE state<>'rechazado' AND lot%4<>1"))


def l14(s, d):
    x = ds(s, d)
    return L.candidate_rows(x, gold(s, d), x.where("partition = 'test'"), ["row_id"], "ts_us", 0.1, 0.05, "row_id", 5 * D, ["row_id", "entity_ip"])


add("L14_candidate_rows", l14, sql("ds gold", f"""
WITH b AS (SELECT * FROM ds WHERE partition IN ('train','validation') AND eligible AND row_id NOT IN (SELECT row_id FROM gold)), w AS (SELECT * FROM ds WHERE partition='test'),
c AS (SELECT greatest(1, CAST(floor(CAST(0.05 AS DOUBLE)*count(*)) AS BIGINT)) AS n FROM w), x AS (SELECT w.*, row_number() OVER (PARTITION BY entity_ip ORDER BY ts_us, row_id)-1 AS r, count(*) OVER (PARTITION BY entity_ip) AS t, n FROM w, c),
y AS (SELECT * FROM x WHERE n >= t OR {even('r', 't', 'n')}), z AS (SELECT *, row_number() OVER (ORDER BY ts_us, entity_ip, row_id)-1 AS r2, count(*) OVER () AS t2 FROM y), m AS (SELECT CAST(floor(CAST(0.1/0.9 AS DOUBLE)*(SELECT count(*) FROM b)) AS BIGINT) AS n2),
i AS (SELECT DISTINCT CAST(floor(j*((SELECT count(*) FROM y)/CAST((SELECT n2 FROM m) AS DOUBLE))) AS BIGINT) AS r FROM (SELECT unnest(range(0,(SELECT n2 FROM m))) AS j))
SELECT row_id, entity_ip, 'base' AS origin FROM b UNION ALL SELECT row_id, entity_ip, 'new' FROM z, m WHERE t2 <= n2 OR r2 IN (SELECT r FROM i)"""))


def l15(s, d):
    x = scores(s, d).groupBy("campaign_id").agg(
        F.avg(F.when((F.col("label") == "normal") & (F.col("k") % 10 > 0), (F.col("score") < -0.6).cast("double"))).alias("current_fpr"),
        F.avg(F.when(F.col("label") == "normal", (F.col("score") < -0.61).cast("double"))).alias("candidate_fpr"),
        F.avg(F.when((F.col("label") == "anomaly") & (F.col("user_id") < 100), (F.col("score") < -0.6).cast("double"))).alias("current_detection"),
        F.avg(F.when(F.col("label") == "anomaly", (F.col("score") < -0.61).cast("double"))).alias("candidate_detection"))
    return L.verdict(x, 0.0, 0.02).select("campaign_id", "verdict")


add("L15_verdict", l15, sql("sc", """WITH x AS (SELECT campaign_id, avg(CASE WHEN label='normal' AND k%10>0 THEN CAST(score < -0.6 AS DOUBLE) END) AS fa, avg(CASE WHEN label='normal' THEN CAST(score < -0.61 AS DOUBLE) END) AS fc,
 avg(CASE WHEN label='anomaly' AND user_id<100 THEN CAST(score < -0.6 AS DOUBLE) END) AS da, avg(CASE WHEN label='anomaly' THEN CAST(score < -0.61 AS DOUBLE) END) AS dc FROM (SELECT * FROM sc) GROUP BY 1)
SELECT campaign_id, CASE WHEN fa IS NULL OR fc IS NULL THEN 'EVALUACION_INCOMPLETA' WHEN fc>fa THEN 'NO_PROMOVER' WHEN da IS NULL OR dc IS NULL THEN 'EVALUACION_INCOMPLETA' WHEN dc<da-CAST(0.02 AS DOUBLE) THEN 'NO_PROMOVER' ELSE 'PROMOVIBLE' END AS verdict FROM x"""))
