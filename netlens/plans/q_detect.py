"""Queries M01-M19 and X01-X20."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.functions.columns import wilson
from netlens.operators import dataset as B, detect as M, experiments as EX, stats as X
from netlens.plans import q_learn  # noqa: F401  (named subqueries)
from netlens.plans.adapt import sql, table, view
from netlens.plans.q_learn import scores
from netlens.plans.registry import add, r6

DIMS = [f"d{i}" for i in range(64)]
TREES, SAMPLE, SEED = M.TREES, M.SAMPLE, 7


def emb(s, d):
    """Vectors as the model matrix: all dimensions, label = episode, two labels anomalous."""
    x = table(s, d, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(DIMS)]
    part = F.when(F.col("vec_id") % 5 < 3, "train").when(F.col("vec_id") % 5 == 3, "validation").otherwise("test")
    return x.select("vec_id", *cols, F.concat(F.lit("e"), (F.col("label") * 10 + F.col("vec_id") % 4).cast("string")).alias("episode_id"), (F.col("label") >= 8).alias("truth"), part.alias("partition"))


view("emb", "", "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(DIMS)) +
     ", 'e'||(label*10+vec_id%4) AS episode_id, label>=8 AS truth, CASE WHEN vec_id%5<3 THEN 'train' WHEN vec_id%5=3 THEN 'validation' ELSE 'test' END AS partition FROM embeddings")


def train(s, d):
    return emb(s, d).where("partition = 'train' and not truth")


add("M01_scaler", lambda s, d: r6(M.scale(emb(s, d), M.fit_scaler(train(s, d), DIMS), DIMS).select("vec_id", *DIMS)), sql("emb", "WITH t AS (SELECT " + ", ".join(
    f"avg({n}) AS m{n}, stddev_pop({n}) AS s{n}" for n in DIMS) + " FROM emb WHERE partition='train' AND NOT truth) SELECT vec_id, " + ", ".join(f"round(({n}-m{n})/s{n},6) AS {n}" for n in DIMS) + " FROM emb, t"))


def forest(s, d, weight=None, sample=SAMPLE):
    x = emb(s, d)
    t = x.where("partition = 'train' and not truth")
    if weight:
        t = B.episode_weights(t)
    m = M.fit_iforest(t, "vec_id", {"all": DIMS}, TREES, sample, SEED, weight)
    return M.score_iforest(x, m, {"all": DIMS}).withColumnRenamed("score_all", "score")


add("M02_fit_iforest", lambda s, d: M.fit_iforest(emb(s, d).where("partition = 'train' and not truth"), "vec_id", {"all": DIMS}, TREES, SAMPLE, SEED).groupBy("tree").agg(
    F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), F.max("size").alias("rows")))
add("M03_weighted_iforest", lambda s, d: r6(forest(s, d, "weight").select("vec_id", "score")))
add("M04_score_iforest", lambda s, d: r6(forest(s, d).select("vec_id", "score", (F.col("score") - M.OFFSET).alias("decision"))))


def lof(s, d):
    t, q = train(s, d), emb(s, d).where("partition = 'test'")
    return r6(M.score_lof(q, t, M.fit_lof(t, "vec_id", DIMS, 20), "vec_id", DIMS, 20), 5)


DIST = "sqrt(" + "+".join(f"(a.{n}-b.{n})*(a.{n}-b.{n})" for n in DIMS) + ")"
add("M05_lof", lof, sql("emb", f"""
WITH t AS (SELECT * FROM emb WHERE partition='train' AND NOT truth), q AS (SELECT * FROM emb WHERE partition='test'),
tn AS (SELECT * FROM (SELECT a.vec_id AS i, b.vec_id AS j, {DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS rn FROM t a JOIN t b ON a.vec_id<>b.vec_id) WHERE rn<=20),
kd AS (SELECT i, max(d) AS k FROM tn GROUP BY 1), tl AS (SELECT tn.i, 1/(avg(greatest(d,k))+1e-10) AS l FROM tn JOIN kd ON kd.i=tn.j GROUP BY 1),
qn AS (SELECT * FROM (SELECT a.vec_id AS i, b.vec_id AS j, {DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS rn FROM q a, t b) WHERE rn<=20),
ql AS (SELECT qn.i, 1/(avg(greatest(d,k))+1e-10) AS l FROM qn JOIN kd ON kd.i=qn.j GROUP BY 1), nb AS (SELECT qn.i, avg(tl.l) AS l FROM qn JOIN tl ON tl.i=qn.j GROUP BY 1)
SELECT ql.i AS vec_id, round(-nb.l/ql.l,5) AS score FROM ql JOIN nb USING (i)"""))


def robust(s, d):
    mean, inv, _ = M.fit_mahalanobis(train(s, d), "vec_id", DIMS)
    return r6(M.score_mahalanobis(emb(s, d), DIMS, mean, inv).select("vec_id", "score"))


add("M06_robust_covariance", robust)
VAL = "partition = 'validation'"
add("M07_threshold_quantile", lambda s, d: r6(M.threshold_quantile(scores(s, d).where(VAL), ["campaign_id"])), sql("sc", "SELECT campaign_id, round(quantile_cont(score,0.05),6) AS threshold FROM sc WHERE partition='validation' GROUP BY 1"))


def coarse(s, d):
    return scores(s, d).withColumn("score", -F.floor(F.col("k") / 7) / 10.0)


view("csc", "sc", "SELECT * EXCLUDE (score), -floor(k/CAST(7 AS DOUBLE))/10 AS score FROM sc")
add("M08_lower_tail", lambda s, d: M.lower_tail(coarse(s, d), ["partition"], "score", "episode_id", 0.05, "row_id"), sql("csc", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY score, row_id)-1 AS i, CAST(floor(CAST(0.05 AS DOUBLE)*count(*) OVER (PARTITION BY partition)) AS BIGINT) AS kk, count(*) OVER (PARTITION BY partition) AS n FROM csc), t AS (SELECT partition, score AS t FROM r WHERE i=kk)
SELECT partition, any_value(t) AS threshold, CAST(count(*) FILTER (WHERE score<t) AS BIGINT) AS strict_alerts, CAST(count(*) FILTER (WHERE score=t) AS BIGINT) AS ties, any_value(kk) AS k, any_value(n) AS windows,
 CAST(count(DISTINCT episode_id) FILTER (WHERE score<t) AS BIGINT) AS alert_episodes, CAST(count(DISTINCT episode_id) FILTER (WHERE i<kk) AS BIGINT) AS prefix_episodes FROM r JOIN t USING (partition) GROUP BY 1"""))
AL = [0.05, 0.03, 0.01]
add("M09_alpha_table", lambda s, d: r6(M.alpha_table(scores(s, d), AL)), sql("sc", " UNION ALL ".join(f"""SELECT CAST({a} AS DOUBLE) AS alpha, round(any_value(t),6) AS threshold, CAST(count(*) FILTER (WHERE score<t AND label<>'anomaly') AS BIGINT) AS false_alerts, CAST(count(*) FILTER (WHERE label<>'anomaly') AS BIGINT) AS normal,
 CAST(count(*) FILTER (WHERE score<t AND label='anomaly') AS BIGINT) AS detected, CAST(count(*) FILTER (WHERE label='anomaly') AS BIGINT) AS anomalies FROM (SELECT *, (SELECT quantile_cont(score,{a}) FROM sc WHERE partition='validation') AS t FROM sc WHERE partition='test')""" for a in AL)))
add("M10_detection_summary", lambda s, d: M.detection_summary(scores(s, d), ["label"], -0.6), sql("sc", """SELECT label, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE score < -0.6) AS BIGINT) AS detected, round(min(score),4) AS score_min, round(max(score),4) AS score_max,
 round(count(*) FILTER (WHERE score < -0.6)/CAST(count(*) AS DOUBLE),6) AS rate, round(quantile_cont(score,0.5),4) AS score_median FROM sc GROUP BY 1"""))


def m11(s, d):
    st = scores(s, d).where("event_type = 'signup'").groupBy("entity_ip").agg(F.min("ts_us").alias("start_us"))
    return M.first_alert(scores(s, d), st, ["entity_ip"], "ts_us", -0.62)


add("M11_first_alert", m11, sql("sc", """SELECT entity_ip, CAST(count(*) AS BIGINT) AS windows, CAST(count(*) FILTER (WHERE score < -0.62) AS BIGINT) AS alerts, min(ts_us) FILTER (WHERE score < -0.62) AS first_us, any_value(st) AS start_us, min(ts_us) FILTER (WHERE score < -0.62)-any_value(st) AS delay_us
 FROM sc JOIN (SELECT entity_ip, min(ts_us) AS st FROM sc WHERE event_type='signup' GROUP BY 1) USING (entity_ip) WHERE ts_us>=st GROUP BY 1"""))
add("M14_evaluate", lambda s, d: r6(M.evaluate(scores(s, d).withColumn("profile", F.col("campaign_id")), -0.6, "10.10.1.12")), sql("sc", """WITH a AS (SELECT * FROM sc WHERE label='anomaly'), u AS (
 SELECT 'test' AS section, 'all' AS name, count(*) AS w, count(*) FILTER (WHERE score < -0.6) AS d FROM sc WHERE label<>'anomaly' AND partition='test' UNION ALL SELECT 'anomaly','all',count(*),count(*) FILTER (WHERE score < -0.6) FROM a
 UNION ALL SELECT 'source', CASE WHEN entity_ip='10.10.1.12' THEN 'real' ELSE 'legacy' END, count(*), count(*) FILTER (WHERE score < -0.6) FROM a GROUP BY 2 UNION ALL SELECT 'profile', campaign_id, count(*), count(*) FILTER (WHERE score < -0.6) FROM a GROUP BY 2
 UNION ALL SELECT 'episodes','all',count(DISTINCT episode_id),count(DISTINCT episode_id) FILTER (WHERE score < -0.6) FROM a)
SELECT section, name, CAST(w AS BIGINT) AS windows, CAST(d AS BIGINT) AS detected, round(d/CAST(w AS DOUBLE),6) AS rate FROM u"""))
add("M15_seed_stability", lambda s, d: r6(M.seed_stability(emb(s, d).where("partition = 'train' and not truth"), emb(s, d).where(VAL), "vec_id", DIMS, [1, 2, 3], TREES, SAMPLE, 0.05)))


def linear(df):
    return df.withColumn("score", -0.4 - F.col("x6") / 10 - F.col("dur") / 5000)


def m16(s, d):
    x = table(s, d, "ds").withColumn("dur", (F.col("k") * 5).cast("double")).select("row_id", "entity_ip", "x6", "dur")
    return r6(M.substitute_sensitivity(x, "dur", 200.0, [300.0, 600.0, 900.0], linear, {"0.05": -0.52, "0.01": -0.58}, ["10.10.1.12"]))


add("M16_substitute_sensitivity", m16, sql("ds", """WITH x AS (SELECT entity_ip, -0.4-x6/10-CAST(k*5 AS DOUBLE)/5000 AS b, -0.4-x6/10-v.s/5000 AS n, v.s FROM ds, (VALUES (CAST(300 AS DOUBLE)),(600),(900)) v(s) WHERE k*5>=200)
SELECT s AS substitute, a AS alpha, CASE WHEN entity_ip='10.10.1.12' THEN 'attacker' ELSE 'legitimate' END AS party, CAST(count(*) AS BIGINT) AS windows, CAST(count(*) FILTER (WHERE b<u) AS BIGINT) AS alerts_before, CAST(count(*) FILTER (WHERE b>=u AND u>n) AS BIGINT) AS permit_to_alert,
 CAST(count(*) FILTER (WHERE n>=u AND u>b) AS BIGINT) AS alert_to_permit, round(avg(n-b),6) AS mean_delta FROM x, (VALUES ('0.05', CAST(-0.52 AS DOUBLE)),('0.01',-0.58)) t(a,u) GROUP BY 1, 2, 3"""))
add("M19_reject_non_finite", lambda s, d: r6(M.reject_non_finite(scores(s, d)).groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"))),
    sql("sc", "SELECT partition, CAST(count(*) AS BIGINT) AS n, round(min(score),6) AS lowest FROM sc GROUP BY 1"))

# --- statistics --------------------------------------------------------------------------------------------
ZS = f"{X.Z_FRACTION}"


def x01(s, d):
    x = scores(s, d).groupBy("campaign_id").agg(F.count_if(F.col("score") < -0.6).alias("k"), F.count(F.lit(1)).alias("n"))
    w, p = wilson(F.col("k"), F.col("n"), X.Z_FRACTION), wilson(F.col("k"), F.col("n"), X.Z_PERCENT)
    return r6(x.select("campaign_id", w["low"].alias("low"), w["high"].alias("high"), (100 * p["low"]).alias("low_pct")))


def wil(z, sign):
    return f"(k/n+{z}*{z}/(2*n){sign}{z}*sqrt(k/n*(1-k/n)/n+{z}*{z}/(4*n*n)))/(1+{z}*{z}/n)"


ZF, ZP = f"CAST({X.Z_FRACTION} AS DOUBLE)", f"CAST({X.Z_PERCENT} AS DOUBLE)"
add("X01_wilson", x01, sql("sc", f"""SELECT campaign_id, round(greatest(0,{wil(ZF, '-')}),6) AS low, round(least(1,{wil(ZF, '+')}),6) AS high, round(100*greatest(0,{wil(ZP, '-')}),6) AS low_pct
 FROM (SELECT campaign_id, CAST(count(*) FILTER (WHERE score < -0.6) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM sc GROUP BY 1)"""))


def verdicts(s, d):
    x = scores(s, d)
    return x.select("row_id", "episode_id", "campaign_id", (F.col("score") < -0.6).alias("a"), (F.col("k") + F.col("row_id") % 9 > 85).alias("b"), (F.col("x6") > 0.8).alias("c"))


view("vd", "sc", "SELECT row_id, episode_id, campaign_id, score < -0.6 AS a, k+row_id%9 > 85 AS b, x6 > 0.8 AS c FROM sc")


def psql(lo: str, n: str) -> str:
    return f"CASE WHEN {n}=0 OR 2*{lo}={n} THEN 1.0 ELSE least(1.0, 2*list_sum(list_transform(range(0, {lo}+1), lambda i: exp(lgamma({n}+1)-lgamma(i+1)-lgamma({n}-i+1)-{n}*ln(2))))) END"


view("mc", "vd", f"SELECT campaign_id, oa AS only_a, ob AS only_b, oa+ob AS discordant, round({psql('least(oa,ob)', '(oa+ob)')},6) AS p FROM (SELECT campaign_id, count(*) FILTER (WHERE a AND NOT b) AS oa, count(*) FILTER (WHERE b AND NOT a) AS ob FROM vd GROUP BY 1)")
add("X02_mcnemar", lambda s, d: r6(X.mcnemar(verdicts(s, d), ["campaign_id"])), sql("mc", "SELECT campaign_id, CAST(only_a AS BIGINT) AS only_a, CAST(only_b AS BIGINT) AS only_b, CAST(discordant AS BIGINT) AS discordant, p FROM mc"))
view("hm", "mc", """SELECT *, min(CASE WHEN p <= lim THEN 1 ELSE 0 END) OVER (ORDER BY p, campaign_id ROWS UNBOUNDED PRECEDING)=1 AS sig FROM (SELECT *, CAST(0.05 AS DOUBLE)/(count(*) OVER ()-row_number() OVER (ORDER BY p, campaign_id)+1) AS lim FROM mc)""")
add("X03_holm", lambda s, d: r6(X.holm(X.mcnemar(verdicts(s, d), ["campaign_id"]).withColumn("p", F.round("p", 6)), "campaign_id").select("campaign_id", "holm_limit", "significant")),
    sql("hm", "SELECT campaign_id, round(lim,6) AS holm_limit, sig AS significant FROM hm"))
add("X04_clopper_pearson", lambda s, d: r6(X.clopper_pearson(scores(s, d).groupBy("campaign_id").agg(F.count_if(F.col("score") < -0.66).alias("k"), F.count(F.lit(1)).alias("n")), "k", "n")))


def x05(s, d):
    v = verdicts(s, d).withColumnRenamed("c", "alert")
    a = X.to_episode(v, ["episode_id"]).withColumn("rule", F.lit("any"))
    return a.unionByName(X.to_episode(v, ["episode_id"], rule="majority").withColumn("rule", F.lit("majority")))


add("X05_to_episode", x05, sql("vd", "SELECT episode_id, bool_or(c) AS alert, 'any' AS rule FROM vd GROUP BY 1 UNION ALL SELECT episode_id, count(*) FILTER (WHERE c)*2 > count(*), 'majority' FROM vd GROUP BY 1"))


def x06(s, d):
    v = verdicts(s, d)
    long = v.select("row_id", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("alert")) for m in "abc"])))
    return r6(X.compare_all(long, ["a", "b", "c"], ["row_id"]).drop("holm_limit"))


PR = " UNION ALL ".join(f"SELECT '{p}' AS model_a, '{q}' AS model_b, count(*) FILTER (WHERE {p} AND NOT {q}) AS oa, count(*) FILTER (WHERE {q} AND NOT {p}) AS ob FROM vd" for p, q in (("a", "b"), ("a", "c"), ("b", "c")))
add("X06_compare_all", x06, sql("vd", f"""WITH u AS ({PR}), x AS (SELECT *, oa+ob AS n, {psql('least(oa,ob)', '(oa+ob)')} AS p FROM u), y AS (SELECT *, CAST(0.05 AS DOUBLE)/(count(*) OVER ()-row_number() OVER (ORDER BY p, model_a||' vs '||model_b)+1) AS lim FROM x)
SELECT model_a, model_b, model_a||' vs '||model_b AS pair, CAST(oa AS BIGINT) AS only_a, CAST(ob AS BIGINT) AS only_b, CAST(n AS BIGINT) AS discordant, round(p,6) AS p, min(CASE WHEN p<=lim THEN 1 ELSE 0 END) OVER (ORDER BY p, model_a||' vs '||model_b ROWS UNBOUNDED PRECEDING)=1 AS significant FROM y"""))
BLOCKS = [DIMS[i:i + 16] for i in range(0, 64, 16)]
GROUPS = {"all": DIMS, **{f"only_{i}": g for i, g in enumerate(BLOCKS)}, **{f"without_{i}": [n for n in DIMS if n not in g] for i, g in enumerate(BLOCKS)}}
add("X07_ablation", lambda s, d: r6(EX.ablation(emb(s, d), "vec_id", GROUPS, TREES, SAMPLE, SEED, 0.05)))


def x08(s, d):
    x = X.kfold_episodes(emb(s, d).where("not truth"), "episode_id", 5, SEED)
    return x.groupBy("fold", "role").agg(F.count_distinct("episode_id").alias("episodes"))


add("X08_kfold_episodes", x08, sql("emb", """WITH n AS (SELECT count(DISTINCT episode_id) AS n FROM emb WHERE NOT truth), f AS (SELECT CAST(unnest(range(0,5)) AS INT) AS fold), t AS (SELECT fold, n, (n-fold+4)//5 AS te FROM f, n), u AS (SELECT fold, te, n-te AS m FROM t)
SELECT fold, 'test' AS role, CAST(te AS BIGINT) AS episodes FROM u UNION ALL SELECT fold, 'fit', CAST(floor(m*3/CAST(4 AS DOUBLE)) AS BIGINT) FROM u UNION ALL SELECT fold, 'calibrate', CAST(m-floor(m*3/CAST(4 AS DOUBLE)) AS BIGINT) FROM u"""))


view("lng", "emb", "SELECT vec_id, truth, partition, unnest([" + ", ".join(f"'{n}'" for n in DIMS) + "]) AS f, unnest([" + ", ".join(DIMS) + "]) AS v FROM emb")
add("X08_cross_validate", lambda s, d: r6(EX.cross_validate(emb(s, d), "vec_id", DIMS, 5, SEED, 0.05, EX.fold_distance)), sql("lng", f"""
WITH e AS (SELECT episode_id, row_number() OVER (ORDER BY h, episode_id)-1 AS i FROM (SELECT DISTINCT episode_id, CAST('0x'||substr(md5(episode_id||':{SEED}'),1,15) AS BIGINT) AS h FROM emb WHERE NOT truth)), fs AS (SELECT CAST(unnest(range(0,5)) AS INT) AS fold),
k AS (SELECT episode_id, fold, i%5=fold AS te, row_number() OVER (PARTITION BY fold, i%5=fold ORDER BY i) AS p, count(*) OVER (PARTITION BY fold, i%5=fold) AS m FROM e, fs),
r AS (SELECT fold, episode_id, vec_id, CASE WHEN te THEN 'test' WHEN p<=floor(m*3/CAST(4 AS DOUBLE)) THEN 'fit' ELSE 'calibrate' END AS role FROM k JOIN emb USING (episode_id) WHERE NOT truth UNION ALL SELECT fold, episode_id, vec_id, 'anomaly' FROM emb, fs WHERE truth),
mo AS (SELECT fold, f, avg(v) AS m, stddev_pop(v) AS s FROM r JOIN lng USING (vec_id) WHERE role='fit' GROUP BY 1, 2),
z AS (SELECT fold, role, episode_id, vec_id, round(-sum(power((v-m)/CASE WHEN s=0 THEN 1 ELSE s END,2)),6) AS score FROM r JOIN lng USING (vec_id) JOIN mo USING (fold, f) WHERE role<>'fit' GROUP BY ALL),
t AS (SELECT fold, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score)-1 AS i, floor(CAST(0.05 AS DOUBLE)*count(*) OVER (PARTITION BY fold)) AS cut FROM z WHERE role='calibrate') WHERE i=cut),
c AS (SELECT fold, threshold, count(DISTINCT episode_id) FILTER (WHERE role='test') AS te, count(*) FILTER (WHERE role='test') AS n, count(*) FILTER (WHERE role='test' AND score<threshold) AS fa, count(*) FILTER (WHERE role='anomaly') AS a, count(*) FILTER (WHERE role='anomaly' AND score<threshold) AS de FROM z JOIN t USING (fold) WHERE role<>'calibrate' GROUP BY 1, 2)
SELECT fold, round(threshold,6) AS threshold, CAST(te AS BIGINT) AS test_episodes, CAST(n AS BIGINT) AS normal, CAST(fa AS BIGINT) AS false_alerts, CAST(a AS BIGINT) AS anomalies, CAST(de AS BIGINT) AS detected, round(100*fa/CAST(n AS DOUBLE),6) AS fpr_pct, round(100*de/CAST(a AS DOUBLE),6) AS detected_pct FROM c"""))


def x09(s, d):
    v = scores(s, d).where(VAL)
    t = X.bootstrap_threshold(v, "episode_id", "score", 0.05, 1000, SEED)
    return r6(X.bootstrap_summary(t, -0.68))


add("X09_bootstrap_threshold", x09)
view("eff", "lng", """SELECT f AS feature, (m1-m0)/sqrt(((n0-1)*v0+(n1-1)*v1)/(n0+n1-2)) AS d FROM (SELECT f, avg(v) FILTER (WHERE truth) AS m1, avg(v) FILTER (WHERE NOT truth) AS m0, var_samp(v) FILTER (WHERE truth) AS v1, var_samp(v) FILTER (WHERE NOT truth) AS v0, count(*) FILTER (WHERE truth) AS n1, count(*) FILTER (WHERE NOT truth) AS n0 FROM lng GROUP BY 1)""")
add("X10_cohens_d", lambda s, d: r6(X.cohens_d(emb(s, d), DIMS)), sql("eff", "SELECT feature, round(d,6) AS d FROM eff"))
LIM = 0.04
view("rp", "lng", f"SELECT * FROM (SELECT a.f AS feature_a, b.f AS feature_b, corr(a.v, b.v) AS r FROM lng a JOIN lng b USING (vec_id) WHERE a.partition<>'test' AND CAST(substr(a.f,2) AS INT) < CAST(substr(b.f,2) AS INT) GROUP BY 1, 2) WHERE abs(r) > {LIM}")


def pairs(s, d):
    return X.redundant_pairs(emb(s, d).where("partition <> 'test'"), DIMS, LIM)


add("X11_redundant_pairs", lambda s, d: r6(pairs(s, d)), sql("rp", "SELECT feature_a, feature_b, round(r,6) AS r FROM rp"))
add("X12_clusters", lambda s, d: X.clusters(pairs(s, d)), sql("rp", """WITH RECURSIVE e AS (SELECT feature_a AS x, feature_b AS y FROM rp UNION SELECT feature_b, feature_a FROM rp), c(node, reach) AS (SELECT x, x FROM e UNION SELECT c.node, e.y FROM c JOIN e ON c.reach=e.x)
SELECT node, min(reach) AS cluster FROM c GROUP BY 1"""))
add("X13_parameter_grid", lambda s, d: r6(EX.parameter_grid(emb(s, d), "vec_id", DIMS, [256, 128, 32], TREES, SEED)))
add("X14_top_features", lambda s, d: X.top_features(X.cohens_d(emb(s, d), DIMS), [2, 4, 8]).select("feature", "rank", "top_n"), sql("eff", """
WITH r AS (SELECT feature, row_number() OVER (ORDER BY abs(d) DESC, feature) AS rank FROM eff) SELECT feature, CAST(rank AS INT) AS rank, t AS top_n FROM r, (VALUES (2),(4),(8)) v(t) WHERE rank <= t"""))
add("X15_leave_one_episode_out", lambda s, d: r6(EX.leave_one_episode_out(emb(s, d), "vec_id", DIMS, [5, 10, 15, 28], TREES, SAMPLE, SEED)))


def x16(s, d):
    far = lambda df: df.withColumn("score", -sum((F.abs(F.col(n)) for n in DIMS[1:]), F.abs(F.col(DIMS[0]))))
    a = emb(s, d).where("truth")
    return X.dilution(far(a), far(B.episode_mean(a, DIMS)), -6.3)


add("X16_dilution", x16, sql("emb", f"""WITH w AS (SELECT episode_id, -({'+'.join(f'abs({n})' for n in DIMS)}) AS s FROM emb WHERE truth), e AS (SELECT episode_id, -({'+'.join(f'abs(avg({n}))' for n in DIMS)}) AS s FROM emb WHERE truth GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS windows, CAST(count(*) FILTER (WHERE w.s <= -6.3) AS BIGINT) AS windows_hit, CAST(count(*) FILTER (WHERE w.s <= -6.3 AND e.s > -6.3) AS BIGINT) AS windows_lost, (SELECT CAST(count(*) AS BIGINT) FROM e WHERE s <= -6.3) AS episodes_hit FROM w JOIN e USING (episode_id)"""))
add("X17_binary_metrics", lambda s, d: r6(X.binary_metrics(scores(s, d).select("campaign_id", (F.col("label") == "anomaly").alias("truth"), (F.col("score") < -0.6).alias("alert")), ["campaign_id"])), sql("sc", f"""
WITH c AS (SELECT campaign_id, CAST(count(*) FILTER (WHERE label='anomaly' AND score < -0.6) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE label<>'anomaly' AND score < -0.6) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE label='anomaly' AND score >= -0.6) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE label<>'anomaly' AND score >= -0.6) AS DOUBLE) AS tn FROM sc GROUP BY 1),
x AS (SELECT *, tp AS k, tp+fn AS n FROM c)
SELECT campaign_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, round(tn/(tn+fp),6) AS specificity, round(fp/(fp+tn),6) AS fpr, round(2*tp/(2*tp+fp+fn),6) AS f1,
 round((tp+tn)/(tp+tn+fp+fn),6) AS accuracy, round((tp/(tp+fn)+tn/(tn+fp))/2,6) AS balanced_accuracy, round((tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)),6) AS mcc, round(greatest(0,{wil(ZF, '-')}),6) AS recall_low, round(least(1,{wil(ZF, '+')}),6) AS recall_high FROM x"""))


def x18(s, d):
    return r6(X.ranking_metrics(coarse(s, d).select("partition", "score", (F.col("label") == "anomaly").alias("truth")), ["partition"]))


add("X18_ranking_metrics", x18, sql("csc", """WITH x AS (SELECT partition, -score AS s, label='anomaly' AS t FROM csc), g AS (SELECT partition, s, count(*) AS n, count(*) FILTER (WHERE t) AS p FROM x GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY partition ORDER BY s)-n AS below, sum(n) OVER (PARTITION BY partition ORDER BY s DESC) AS above, sum(p) OVER (PARTITION BY partition ORDER BY s DESC) AS tp, sum(p) OVER (PARTITION BY partition) AS pp, sum(n) OVER (PARTITION BY partition) AS nn FROM g)
SELECT partition, CAST(any_value(pp) AS BIGINT) AS p, CAST(any_value(nn-pp) AS BIGINT) AS n, round((sum(p*(below+(n+1)/CAST(2 AS DOUBLE)))-any_value(pp)*(any_value(pp)+1)/CAST(2 AS DOUBLE))/(any_value(pp)*any_value(nn-pp)),6) AS roc_auc, round(sum(p/CAST(pp AS DOUBLE)*tp/above),6) AS average_precision FROM c GROUP BY 1"""))


def x20(s, d):
    # half the rows a tree: a tree that holds every row holds the same rows under any weights
    return X.weight_effect(forest(s, d, None, 128), forest(s, d, "weight", 128), ["vec_id"]).select("rows", "equal")


add("X20_weight_effect", x20, sql("emb", "SELECT CAST(count(*) AS BIGINT) AS rows, false AS equal FROM emb"))
