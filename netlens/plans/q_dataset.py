"""Queries B01-B19."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.operators import dataset as B, features as FT
from netlens.plans import q_features  # noqa: F401  (named subqueries)
from netlens.plans.adapt import DAY_US as D, STEP_US as S, sql, table, view
from netlens.plans.q_prep import H, obs
from netlens.plans.registry import add, r6

X = ["x1", "x2", "x3", "x4", "x5"]
BLOCK, GUARDU = D, 2 * H


def ds(s, d):
    return table(s, d, "ds")


def parted(s, d):
    return B.partition_blocks(ds(s, d).drop("partition"), "ts_us", BLOCK, GUARDU)


view("parted", "ds", f"""SELECT * EXCLUDE (partition), CASE WHEN i>0 AND ts_us-t0-i*{BLOCK} < {GUARDU} THEN '{B.GUARD}' ELSE list_value('train','train','validation','train','test')[i%5+1] END AS partition FROM
  (SELECT *, least((ts_us-t0)//{BLOCK}, greatest(1,(t1-t0+{BLOCK}-1)//{BLOCK})-1) AS i FROM ds, (SELECT min(ts_us) AS t0, max(ts_us) AS t1 FROM ds))""")
add("B01_partition_blocks", lambda s, d: parted(s, d).select("row_id", "partition"), sql("parted", "SELECT row_id, partition FROM parted"))
add("B02_partition_report", lambda s, d: B.partition_report(parted(s, d), "ts_us", BLOCK), sql("parted", f"""
SELECT CAST(count(*) AS BIGINT) AS rows, {', '.join(f"CAST(count(*) FILTER (WHERE partition='{p}') AS BIGINT) AS {p}" for p in (*B.SETS, B.GUARD))}, round((max(ts_us)-min(ts_us))/CAST(3600000000 AS DOUBLE),2) AS hours,
 CAST((max(ts_us)-min(ts_us)+{BLOCK}-1)//{BLOCK} AS BIGINT) AS blocks, '' AS empty_sets, '' AS reason FROM parted"""))


def b03(s, d):
    x = ds(s, d).drop("partition")
    return B.check_leak(B.partition_blocks(x, "ts_us", BLOCK, GUARDU // 8), "ts_us", GUARDU, 2 * D).select("row_id", "partition", "prev_partition", (F.col("ts_us") - F.col("prev_ts")).alias("gap_us"))


add("B03_check_leak", b03, sql("ds", f"""WITH p AS (SELECT *, CASE WHEN i>0 AND ts_us-t0-i*{BLOCK} < {GUARDU // 8} THEN NULL ELSE list_value('train','train','validation','train','test')[i%5+1] END AS p FROM
  (SELECT * EXCLUDE (partition), least((ts_us-t0)//{BLOCK}, greatest(1,(t1-t0+{BLOCK}-1)//{BLOCK})-1) AS i FROM ds, (SELECT min(ts_us) AS t0, max(ts_us) AS t1 FROM ds))),
 l AS (SELECT row_id, p, ts_us, lag(p) OVER w AS pp, lag(ts_us) OVER w AS pt FROM p WHERE p IS NOT NULL WINDOW w AS (ORDER BY ts_us, p, row_id))
SELECT row_id, p AS partition, pp AS prev_partition, ts_us-pt AS gap_us FROM l WHERE pp<>p AND ts_us-pt < {GUARDU}"""))


def b04(s, d):
    m = ds(s, d).select("episode_id", "partition").distinct()
    return B.assemble(ds(s, d).drop("partition", "label"), m, "normal").select("row_id", "partition", "label")


add("B04_assemble", b04, sql("ds", "SELECT row_id, partition, 'normal' AS label FROM ds WHERE eligible"))
XC = ", ".join(X)
view("dups", "ds", f"SELECT {XC}, count(*) AS n, count(DISTINCT label) AS labels, count(DISTINCT partition) AS parts FROM ds GROUP BY {XC} HAVING count(*)>1")
VALS = [("rows", "(SELECT count(*) FROM ds)", "true"), ("missing_values", "(SELECT " + "+".join(f"count(*) FILTER (WHERE {x} IS NULL)" for x in X) + " FROM ds)", "v=0"),
        *[(f"missing:{x}", f"(SELECT count(*) FILTER (WHERE {x} IS NULL) FROM ds)", "v=0") for x in X], ("undeclared_constants", "0", "true"),
        ("duplicate_groups", "(SELECT count(*) FROM dups)", "true"), ("duplicate_rows_involved", "(SELECT sum(n) FROM dups)", "true"), ("duplicate_excess", "(SELECT sum(n)-count(*) FROM dups)", "true"),
        ("duplicate_excess_ratio", "round((SELECT sum(n)-count(*) FROM dups)/CAST((SELECT count(*) FROM ds) AS DOUBLE),6)", "v<=0.02"),
        ("duplicates_crossing_label", "(SELECT count(*) FROM dups WHERE labels>1)", "v=0"), ("duplicates_crossing_partition", "(SELECT count(*) FROM dups WHERE parts>1)", "v=0"),
        ("episodes_split", "(SELECT count(*) FROM (SELECT episode_id FROM ds GROUP BY 1 HAVING count(DISTINCT partition)>1))", "v=0"), ("invalid_labels", "0", "true"), ("invalid_partitions", "0", "true")]
add("B05_audit", lambda s, d: B.audit(ds(s, d), X, ["x5"]), sql("dups", " UNION ALL ".join(f"SELECT '{n}' AS \"check\", v AS value, {ok} AS ok FROM (SELECT CAST({e} AS DOUBLE) AS v)" for n, e, ok in VALS)))


def b06(s, d):
    x = ds(s, d).withColumns({"history_s": F.col("k") * 3, "x1": F.col("x1") * 1.2, "x2": F.col("x2") - F.when(F.col("k") == 5, 9).otherwise(0)})
    x = B.validate_rows(x, ["x1", "x2", "x4"], ["x1"], "10.10.1.0/25", ["entity_ip", "window_us"])
    return x.select("row_id", F.array_join("reasons", ";").alias("reasons"))


add("B06_validate_rows", b06, sql("ds", """SELECT row_id, concat_ws(';', CASE WHEN k=5 AND x2-9<0 THEN 'x2: negative' END, CASE WHEN x4 IS NULL THEN 'x4: not finite' END, CASE WHEN x1*CAST(1.2 AS DOUBLE)>1 THEN 'x1: ratio above 1' END,
  CASE WHEN k*3<60 THEN 'history below 60 s' END, CASE WHEN CAST(split_part(entity_ip,'.',4) AS INT)>=128 OR entity_ip NOT LIKE '10.10.1.%' THEN 'outside the network' END, CASE WHEN NOT eligible THEN 'not eligible' END,
  CASE WHEN count(*) OVER (PARTITION BY entity_ip, window_us)>1 THEN 'repeated window' END) AS reasons FROM ds"""))


def gate(s, d):
    """Customers are campaigns, orders their rows; balances and keys disturb the paperwork."""
    c, o = table(s, d, "customer"), table(s, d, "orders")
    key = F.col("c_custkey")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    base = c.join(n, "c_custkey", "left").na.fill(0, ["n"])
    led = base.where(key % 17 > 0).select(key.alias("campaign_id"), F.when(key % 13 == 0, "pilot").otherwise("experiment").alias("purpose"), (F.col("n") + F.when(key % 11 == 0, 1).otherwise(0)).alias("rows_declared"),
                                          F.when(key % 19 == 0, "same").otherwise(key.cast("string")).alias("output_hash"), F.floor(key / 2 + F.when(key % 23 == 0, 0).otherwise(key)).cast("long").alias("cell"))
    man = base.where(key % 29 > 0).select(key.alias("campaign_id"), F.when(key % 31 == 0, "failed").otherwise("completed").alias("status"), (key % 37 > 0).alias("complete"), F.lit(0).alias("failures"),
                                          (key % 41 == 0).cast("int").alias("drops"), F.lit(5).alias("captured"), (F.lit(5) - (key % 43 == 0).cast("int")).alias("parsed"), F.lit(7).alias("records"), F.lit(7).alias("expected"))
    rep = base.select(key.alias("campaign_id"), F.col("n").alias("rows_valid"), F.lit("F").alias("partition"))
    rows = o.select(F.col("o_custkey").alias("campaign_id"), F.col("o_orderstatus").alias("partition"))
    return B.reconcile(led, man, rep, rows)


add("B07_reconcile", lambda s, d: gate(s, d).select("campaign_id", F.array_join("reasons", ";").alias("reasons"), "accepted"), """
WITH b AS (SELECT c_custkey AS c, coalesce(n,0) AS n, np, p0 FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS np, min(o_orderstatus) AS p0 FROM orders GROUP BY 1) ON o_custkey=c_custkey),
l AS (SELECT c, CASE WHEN c%13=0 THEN 'pilot' ELSE 'experiment' END AS purpose, CASE WHEN c%19=0 THEN 'same' ELSE CAST(c AS STRING) END AS oh, CAST(floor(c/CAST(2 AS DOUBLE)+CASE WHEN c%23=0 THEN 0 ELSE c END) AS BIGINT) AS cell FROM b WHERE c%17>0),
co AS (SELECT cell, min(c) AS o FROM l WHERE purpose='experiment' GROUP BY 1), ho AS (SELECT oh, min(c) AS o FROM l WHERE purpose='experiment' GROUP BY 1),
r AS (SELECT b.c, concat_ws(';', CASE WHEN b.c%17=0 THEN 'no ledger' END, CASE WHEN b.c%29=0 THEN 'no manifest' END, CASE WHEN b.c%17>0 AND b.c%13=0 THEN 'not an experiment' END, CASE WHEN b.c%29>0 AND b.c%31=0 THEN 'manifest not completed' END,
 CASE WHEN b.c%29>0 AND (b.c%37=0 OR b.c%41=0) THEN 'evidence incomplete' END, CASE WHEN b.c%29>0 AND b.c%43=0 THEN 'captured and parsed packets differ' END, CASE WHEN b.c%17>0 AND b.c%11=0 THEN 'ledger and rows differ' END,
 CASE WHEN np>1 THEN 'rows in several partitions' END, CASE WHEN p0<>'F' THEN 'partition differs from the report' END, CASE WHEN co.o<>b.c THEN 'cell already claimed' END, CASE WHEN ho.o<>b.c THEN 'output repeated' END) AS reasons
 FROM b LEFT JOIN l ON l.c=b.c LEFT JOIN co ON co.cell=l.cell LEFT JOIN ho ON ho.oh=l.oh)
SELECT c AS campaign_id, reasons, reasons='' AS accepted FROM r""")


def b08(s, d):
    x = ds(s, d)
    acc = x.where("k % 9 < 5").select("campaign_id", "episode_id").distinct().select(F.col("campaign_id").alias("profile"), F.pmod(F.regexp_extract("episode_id", r"(\d+)", 1).cast("int"), F.lit(12)).alias("repetition"))
    return B.cells(x.select(F.col("campaign_id").alias("profile")), 10, acc)


add("B08_cells", b08, sql("ds", """WITH a AS (SELECT profile, repetition FROM (SELECT DISTINCT campaign_id AS profile, episode_id, CAST(regexp_extract(episode_id,'(\\d+)',1) AS INT)%12 AS repetition FROM ds WHERE k%9<5)),
e AS (SELECT profile, CAST(unnest(generate_series(1,10)) AS INT) AS repetition FROM (SELECT DISTINCT campaign_id AS profile FROM ds))
SELECT profile, repetition, 'missing' AS state, CAST(0 AS BIGINT) AS claims FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.profile=e.profile AND a.repetition=e.repetition)
UNION ALL SELECT profile, repetition, 'claimed again', CAST(count(*) AS BIGINT) FROM a GROUP BY 1, 2 HAVING count(*)>1"""))
add("B09_duplicate_vectors", lambda s, d: B.duplicate_vectors(ds(s, d), [*X, "x6"][:4], ["campaign_id", "row_id"]).select("row_id", "first_campaign", "first_partition", "cross_partition"),
    sql("ds", """SELECT row_id, fc AS first_campaign, fp AS first_partition, fp<>partition AS cross_partition FROM (SELECT *, first_value(campaign_id) OVER w AS fc, first_value(partition) OVER w AS fp FROM ds WINDOW w AS (PARTITION BY x1,x2,x3,x4 ORDER BY campaign_id, row_id)) WHERE fc<>campaign_id"""))
add("B10_build_dataset",
    lambda s, d: B.build_dataset(table(s, d, "orders").select(F.col("o_custkey").alias("campaign_id"), "o_orderkey", "o_totalprice"), gate(s, d), ["campaign_id", "o_orderkey", "o_totalprice"]),
    """WITH b AS (SELECT c_custkey AS c, n, np, p0 FROM customer JOIN (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS np, min(o_orderstatus) AS p0 FROM orders GROUP BY 1) ON o_custkey=c_custkey),
l AS (SELECT c_custkey AS c, CASE WHEN c_custkey%19=0 THEN 'same' ELSE CAST(c_custkey AS STRING) END AS oh, CAST(floor(c_custkey/CAST(2 AS DOUBLE)+CASE WHEN c_custkey%23=0 THEN 0 ELSE c_custkey END) AS BIGINT) AS cell FROM customer WHERE c_custkey%17>0),
co AS (SELECT cell, min(c) AS o FROM l WHERE c%13>0 GROUP BY 1), ho AS (SELECT oh, min(c) AS o FROM l WHERE c%13>0 GROUP BY 1)
SELECT o_custkey AS campaign_id, o_orderkey, o_totalprice FROM orders JOIN b ON b.c=o_custkey JOIN l ON l.c=b.c LEFT JOIN co ON co.cell=l.cell LEFT JOIN ho ON ho.oh=l.oh
WHERE b.c%29>0 AND b.c%13>0 AND b.c%31>0 AND b.c%37>0 AND b.c%41>0 AND b.c%43>0 AND b.c%11>0 AND np=1 AND p0='F' AND co.o=b.c AND ho.o=b.c""")
add("B11_repetition_summary", lambda s, d: r6(B.repetition_summary(ds(s, d), X)), sql("ds", " UNION ALL ".join(f"""SELECT '{x}' AS feature, min({x}) AS minimum, max({x}) AS maximum, round(avg({x}),6) AS mean,
 CAST(count(DISTINCT {x}) AS BIGINT) AS distinct_values, CAST(count(*) FILTER (WHERE {x}=0) AS BIGINT) AS zero_rows, CAST(count(*) FILTER (WHERE {x}<>0) AS BIGINT) AS nonzero_rows, CAST(count(DISTINCT CASE WHEN {x}<>0 THEN campaign_id END) AS BIGINT) AS nonzero_campaigns,
 round(quantile_cont({x},0.5),6) AS median FROM ds""" for x in X)))
add("B12_dataset_summary", lambda s, d: B.dataset_summary(ds(s, d), X), sql("ds", " UNION ALL ".join(f"SELECT 'feature' AS section, '{x}' AS name, round(min({x}),6) AS a, round(max({x}),6) AS b, round(avg({x}),6) AS c FROM ds" for x in X)
    + " UNION ALL SELECT 'partition', partition, CAST(count(*) AS DOUBLE), CAST(count(DISTINCT episode_id) AS DOUBLE), NULL FROM ds GROUP BY 2"))


def b13(s, d):
    rows = FT.features(obs(s, d), table(s, d, "app"), None, S, ["packet_count_10s", "unique_dst_ip_ratio_30s", "protocol_diversity_30s"]).where("packet_count_10s > 0")
    total = rows.select("anchor").distinct().count()
    return B.scope_candidates(rows, total // 12)


add("B13_scope_candidates", b13, sql("g3", """
WITH r AS (SELECT entity_ip, a, count(*) FILTER (WHERE here) AS n, CASE WHEN count(*) FILTER (WHERE flow_attempt)=0 THEN 0 ELSE count(DISTINCT peer_ip) FILTER (WHERE flow_attempt)/CAST(count(*) FILTER (WHERE flow_attempt) AS DOUBLE) END AS ud,
  CASE WHEN count(protocol)=0 THEN 0 ELSE count(DISTINCT protocol)/CAST(count(protocol) AS DOUBLE) END AS pd FROM g3 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE here)>0),
t AS (SELECT count(DISTINCT a)//12 AS t FROM r), g AS (SELECT entity_ip, count(*) AS w, quantile_cont(ud,0.5) AS d, quantile_cont(pd,0.5) AS p FROM r GROUP BY 1),
p AS (SELECT entity_ip, w, w/CAST(t AS DOUBLE) AS pr, CASE WHEN w/CAST(t AS DOUBLE)>0.9 THEN 2 ELSE 0 END+CASE WHEN d>0.5 THEN 2 ELSE 0 END+CASE WHEN p>0.05 THEN 1 ELSE 0 END+CASE WHEN split_part(entity_ip,'.',4) IN ('1','2','254') THEN 1 ELSE 0 END AS pts FROM g, t)
SELECT entity_ip, CAST(w AS BIGINT) AS windows, round(pr,3) AS presence, pts AS points, CASE WHEN pts>=3 THEN 'infraestructura_probable' WHEN pts>=1 THEN 'indeterminado' ELSE 'cliente' END AS verdict FROM p"""))
add("B14_reconcile_counts", lambda s, d: B.reconcile_counts(parted(s, d)), sql("parted", f"""SELECT CAST(count(*) AS BIGINT) AS physical, CAST(count(*) FILTER (WHERE NOT eligible) AS BIGINT) AS excluded,
  {', '.join(f"CAST(count(*) FILTER (WHERE eligible AND partition='{p}') AS BIGINT) AS {n}" for p, n in ((B.GUARD, 'guard'), *((x, x) for x in B.SETS)))}, CAST(0 AS BIGINT) AS difference, true AS balanced FROM parted"""))
add("B15_episode_mean", lambda s, d: r6(B.episode_mean(ds(s, d), X)), sql("ds", "SELECT episode_id, " + ", ".join(f"round(avg({x}),6) AS {x}" for x in X) + " FROM ds GROUP BY 1"))
add("B16_collapse", lambda s, d: B.collapse(ds(s, d), X, ["row_id"]).select("row_id", "campaign_id"), sql("ds", f"SELECT row_id, campaign_id FROM (SELECT *, row_number() OVER (PARTITION BY {XC} ORDER BY row_id) AS rn FROM ds) WHERE rn=1"))
add("B17_episode_weights", lambda s, d: r6(B.episode_weights(ds(s, d)).select("row_id", "weight"), 9), sql("ds", "SELECT row_id, round(CAST(1 AS DOUBLE)/count(*) OVER (PARTITION BY episode_id),9) AS weight FROM ds"))


def b18(s, d):
    """Conversations are episodes of a few turns."""
    x = table(s, d, "conversations").select(F.col("conv_id").alias("episode_id"), "turn")
    return B.balance_lcm(x).groupBy("episode_id").agg(F.sum("copies").cast("long").alias("rows"), F.count(F.lit(1)).alias("turns"))


add("B18_balance_lcm", b18, """WITH n AS (SELECT conv_id AS e, count(*) AS n FROM conversations GROUP BY 1)
SELECT e AS episode_id, CAST((SELECT list_reduce(list(DISTINCT n), lambda a, b: lcm(a, b)) FROM n) AS BIGINT) AS rows, CAST(n AS BIGINT) AS turns FROM n""")
CUTS = [100.0, 400.0]
add("B19_duration_distribution", lambda s, d: B.duration_distribution(ds(s, d).withColumn("dur", F.when(F.col("k") < 8, F.lit(0.0)).otherwise(F.col("row_id") % 997 * 1.0)), "dur", CUTS), sql("ds", """
WITH x AS (SELECT 'all' AS population, CASE WHEN k<8 THEN 0 ELSE CAST(row_id%997 AS DOUBLE) END AS v FROM ds UNION ALL SELECT 'train', CASE WHEN k<8 THEN 0 ELSE CAST(row_id%997 AS DOUBLE) END FROM ds WHERE partition='train'),
g AS (SELECT population, list_sort(list(v)) AS l, count(*) AS n, max(v) AS m, count(*) FILTER (WHERE v>100) AS a, count(*) FILTER (WHERE v>400) AS b, count(*) FILTER (WHERE v=0) AS z FROM x GROUP BY 1)
SELECT population, CAST(n AS BIGINT) AS n, m AS max, round(a/CAST(n AS DOUBLE),5) AS above_100_0, round(b/CAST(n AS DOUBLE),5) AS above_400_0, round(z/CAST(n AS DOUBLE),5) AS zero, """ + ", ".join(f"l[CAST(floor({p}*(n-1)) AS BIGINT)+1] AS {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))) + " FROM g"))
